import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

KEY = b"test key"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.text(max_size=5))
def test_permutation(size, tweak):
    p = pii.Permutation(KEY, tweak, size)
    assert sorted(map(p, range(size))) == list(range(size))
    assert all(p(p(x), back=True) == x for x in range(size))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**40 - 1))
def test_large_permutation(x):
    p = pii.Permutation(KEY, "big", 10**40)
    assert 0 <= p(x) < 10**40 and p(p(x), True) == x


VALUES = {
    "card": ["4041894974608795", "4041-8949-7460-8795", "4111 1111 1111 1111"],
    "phone": ["+1 (988) 555-2485", "(212) 555-0123", "212-555-0123", "+49 151 23456789"],
    "ip": ["152.143.123.131", "0.0.0.0"],
    "email": ["thhein.19@mail5.example.com", "A.b-c@x.org"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "date": ["2020-02-29", "31.12.1999", "05/13/2020", "13/05/2020", "1900-01-01", "31/12/2099"],
}


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_format_and_way_back(kind, value):
    p = pii.Pseudonymizer(KEY)
    text = f"é {value}, and again {value}."
    new, kinds = p.replace(text)
    assert kinds == [kind, kind]
    a, b = re.fullmatch(r"é (.*), and again (.*)\.", new).groups()
    assert a == b != value
    if kind not in ("ip",):
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", a))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value)))
    assert p.replace(new, back=True) == (text, kinds)
    assert p.replace(new)[1] == kinds
    assert pii.Pseudonymizer(b"other").replace(text)[0] != new


@pytest.mark.parametrize("text", ["4041894974608796", "999.1.1.1", "1.2.3.4.5", "01.2.3.4", "2021-02-29", "000-12-3456", "666-12-3456", "DE89370400440532013001", "a@b", "version 10.2.3", "x4041894974608795", "31.13.2020", "1234", ""])
def test_what_fails_the_check_stays(text):
    assert pii.Pseudonymizer(KEY).replace(text) == (text, [])


def test_month_first_dates_are_permuted_among_themselves():
    days = [d for n in range(pii.FIRST, pii.LAST + 1) if (d := dt.date.fromordinal(n)).day > 12]
    assert [pii._unit(i) for i in range(0, len(days), 997)] == days[::997]
    assert all(pii._after12(days[i].toordinal() - pii.FIRST) == i for i in range(0, len(days), 997))
    assert len(days) == pii._after12(pii.LAST - pii.FIRST + 1)


def test_links_across_documents(spark):
    rows = [(1, "pay 4041894974608795 now", 1), (2, "4041894974608795 and 10.0.0.1", 2), (3, None, 3), (3, "", 3), (None, "no numbers " * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_CARD int")
    out = pii.pseudonymize(df, KEY)
    got = out.collect()
    cards = re.findall("[0-9]{16}", " ".join(r.text or "" for r in got))
    assert len(cards) == 2 and len(set(cards)) == 1 and cards[0] != "4041894974608795"
    assert sorted((r.n_card, r.n_ip) for r in got) == [(0, 0), (0, 0), (0, 0), (1, 0), (1, 1)]
    back = pii.pseudonymize(out, KEY, back=True).select("doc_id", "text").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in back))) == sorted(map(str, (r[:2] for r in rows)))
    assert pii.pseudonymize(df.limit(0), KEY).count() == 0
