import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat
from tidemark.llm.template import Const, Show, Template, TemplateError, Text

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "</turn", ">", " ###\n", "\n", "a", "é", "### "]), max_size=12).map("".join)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_read_back(turns):
    text, _ = chat.template().render(messages=({"role": r, "text": t} for r, t in turns))
    assert list(chat.read_turns(iter([text]))) == turns
    assert list(chat.read_turns(iter(text))) == turns
    for r, _ in turns:
        assert chat.unguard(chat.guard(r)) == r


@pytest.mark.parametrize(
    "source, values, want",
    [
        ("a{{ 1 + 2 }}b{{ 'x' ~ 1 | upper }}", {}, "a3bx1"),
        ("{% if a == 1 %}one{% elif a in [] %}{% else %}other{% endif %}" .replace(" in []", " in 'xyz'"), {"a": "y"}, ""),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", {"xs": ["p", "q"]}, "1p, 2q"),
        ("{% set n = 'v' %}{{ n }}{{ m.k }}{{ m['k']|default('d') }}{{ none|default('d') }}", {"m": {"k": 5}}, "v55d"),
        ("x  {%- if true -%}  y  {%- endif %} z", {}, "xy z"),
        ("{{ a if b else c }}{# note #}{{ 'it\\'s' }}{{ 7 % 4 }}{{ 3 < 4 and 2 >= 2 }}", {"c": "C"}, "Cit's3True"),
        ("{{ s.__class__ }}{{ s.upper }}{{ m.items }}", {"s": "x", "m": {}}, ""),
    ],
)
def test_language(source, values, want):
    assert Template(source).render(**values)[0] == want


@pytest.mark.parametrize("source", ["{{ }}", "{{ a|nofilter }}", "{% for x %}{% endfor %}", "{% if a %}", "{% endfor %}", "{{ a() }}", "{{ a ! }}", "{% for x in y %}{% endif %}"])
def test_errors(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_constants_are_folded():
    assert Template("a{{ 1 + 1 }}{% if 1 < 2 %}b{{ 'c'|upper }}{% else %}{{ x }}{% endif %}").tree == (Text("a2bC"),)
    assert Template("{{ ('k' ~ 'l') if x else 2 }}").tree[0].value.args[1] == Const("kl")
    assert isinstance(Template("{{ x }}").tree[0], Show)


def test_generation_marks():
    text, spans = Template("a{% generation %}b{% for x in xs %}{{ x }}{% endfor %}{% endgeneration %}c").render(xs=["1", "22"])
    assert "".join(text[a:b] for a, b in spans) == "b122" and text == "ab122c"


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo ### user ###\n"), (1, 2, "user", None), (1, 3, "assistant", "\\"), (2, 0, "system", "s"), (2, 0, "system", "s"), (2, None, "assistant", ""),
    (3, 0, None, "no role"), (None, 1, "assistant", "no conversation"), (4, 0, "assistant", "long " * 300_000), (4, 1, "assistant", "</turn>"),
]


def test_digests_and_formats(spark):
    want = {}
    for c in {r[0] for r in ROWS}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in ROWS if k == c))
        learned = "".join(x for _, r, x in own if r == "assistant")
        want[c] = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(learned), sha(learned))
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("formatted", chat.F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.digest_conversations(df, rows_at_once=2).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    whole = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert {c: len(r.formatted) for c, r in whole.items()} == {c: r.formatted_chars for c, r in got.items()}
    for c, r in whole.items():
        assert sha("".join(chat.unguard(r.formatted[a:b]) for a, b in r.loss_spans)) == want[c][3]
    assert chat.digest_conversations(df.limit(0)).count() == 0


def test_very_many_turns(spark):
    df = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "'assistant' AS role", "'t' AS text")
    (r,) = chat.digest_conversations(df).collect()
    assert (r.n_turns, r.loss_chars) == (30_000, 30_000)
