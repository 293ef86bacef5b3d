"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass the checks of their kind are replaced by others of
the same format that pass them, too: the values of a format are numbered, a
keyed Feistel network permutes the numbers, and the permuted number is written
in the format. Equal values get equal pseudonyms in all documents, different
ones different pseudonyms, and who has the key can go back.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, free_names, name_of, quoted

ROUNDS = 8
#: The first and last date that count as dates.
FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Permutation:
    """A keyed permutation of the numbers below ``size``: an unbalanced Feistel network, walked until it is in range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.left = math.isqrt(size - 1) + 1
        self.right = -(-size // self.left)
        self.mac = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32)
        self.width = (size.bit_length() + 7) // 8 + 1

    def _round(self, i: int, half: int) -> int:
        h = self.mac.copy()
        h.update(bytes([i]) + half.to_bytes(self.width, "big"))
        out = h.digest()
        while len(out) < self.width + 8:
            h.update(out)
            out += h.digest()
        return int.from_bytes(out, "big")

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._round(i, a)) % self.right
            else:
                a = (a + sign * self._round(i, b)) % self.left
        return a * self.right + b

    def __call__(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


@dataclass(frozen=True)
class Format:
    """One value read: its kind and format, its number among ``size``, and how a number is written in the format."""

    kind: str
    name: str
    size: int
    number: int
    write: Callable[[int], str]


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = sum(v if i % 2 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _symbols(text: str) -> tuple[str, int, int]:
    """Which class each digit or letter has, how many texts have these classes, and the number of this one."""
    shape, size, number = [], 1, 0
    for c in text:
        kind = next((k for k in (_DIGIT, _UPPER, _LOWER) if c in k), None)
        shape.append("d" if kind == _DIGIT else "A" if kind == _UPPER else "a" if kind else c)
        if kind:
            size, number = size * len(kind), number * len(kind) + kind.index(c)
    return "".join(shape), size, number


def _written(shape: str, number: int) -> str:
    out = []
    for s in reversed(shape):
        kind = {"d": _DIGIT, "A": _UPPER, "a": _LOWER}.get(s)
        if kind:
            number, i = divmod(number, len(kind))
            s = kind[i]
        out.append(s)
    return "".join(reversed(out))


def _spread(digits: str, like: str) -> str:
    """``digits`` in place of the digits of ``like``."""
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), like)


def _card(value: str) -> Format | None:
    digits = re.sub("[^0-9]", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1

    def write(x: int) -> str:
        body = f"{x:0{n}d}"
        return _spread(body + luhn_digit(body), value)

    return Format("card", f"card{n}", 10**n, int(digits[:-1]), write)


#: How the digits of cards are grouped where other numbers stand beside them.
_GROUPED = re.compile("[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,4}(?:\\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{4,5}")


def _cards(m: re.Match) -> Iterator[tuple[int, int, Format]]:
    """Card numbers in a run of groups of digits: from its first group as many as can be, else groups as on cards, from left to right, longer ones first."""
    groups = [(g.start(), g.end()) for g in re.finditer("[0-9]+", m[0])]
    i = 0
    while i < len(groups):
        start, digits, ends = groups[i][0], 0, []
        for a, b in groups[i:]:
            digits += b - a
            if digits > 19:
                break
            if digits >= 13:
                ends.append(b)
        found = None
        for k, end in enumerate(reversed(ends)):
            value = m[0][start:end]
            if (i == 0 and k == 0 or _GROUPED.fullmatch(value)) and (found := _card(value)):
                yield m.start() + start, m.start() + end, found
                i = next(j for j, g in enumerate(groups) if g[1] == end)
                break
        i += 1


def _phone(m: re.Match) -> Format:
    digits = re.sub("[^0-9]", "", m[0])
    if m[0][0] == "+":
        keep = 1 if digits[0] in "17" else 2
        n = len(digits) - keep
        return Format("phone", f"phone+{digits[:keep]}:{n}", 10**n, int(digits[keep:]), lambda x: _spread(f"{digits[:keep]}{x:0{n}d}", m[0]))
    area, office = int(digits[:3]) - 200, int(digits[3:6]) - 200
    number = (area * 800 + office) * 10_000 + int(digits[6:])

    def write(x: int) -> str:
        rest, line = divmod(x, 10_000)
        a, o = divmod(rest, 800)
        return _spread(f"{a + 200}{o + 200}{line:04d}", m[0])

    return Format("phone", "phone", 800 * 800 * 10_000, number, write)


def _ssn(m: re.Match) -> Format | None:
    a, g, s = map(int, m[0].split("-"))
    if not 1 <= a <= 899 or a == 666 or not g or not s:
        return None
    number = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1

    def write(x: int) -> str:
        rest, s = divmod(x, 9999)
        a, g = divmod(rest, 99)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    return Format("ssn", "ssn", 898 * 99 * 9999, number, write)


def _ip(m: re.Match) -> Format | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    return Format("ip", "ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), lambda x: ".".join(map(str, x.to_bytes(4, "big"))))


def _iban(text: str) -> Format | None:
    plain = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain) or value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    shape, size, number = _symbols(plain[4:])

    def write(x: int) -> str:
        body = _written(shape, x)
        new = f"{plain[:2]}{98 - value(body + plain[:2] + '00') % 97:02d}{body}"
        it = iter(new)
        return re.sub("[A-Z0-9]", lambda _: next(it), text)

    return Format("iban", f"iban{plain[:2]}{shape}", size, number, write) if 2 <= int(plain[2:4]) <= 98 else None


def _ibans(m: re.Match) -> Iterator[tuple[int, int, Format]]:
    """Account numbers in groups of capitals and digits: from left to right, longer ones first."""
    groups = [(g.start(), g.end()) for g in re.finditer("[A-Z0-9]+", m[0])]
    at = 0
    for i, (start, _) in enumerate(groups):
        if start >= at:
            for _, end in reversed(groups[i:]):
                if found := _iban(m[0][start:end]):
                    yield m.start() + start, m.start() + end, found
                    at = end
                    break


def _email(m: re.Match) -> Format | None:
    local, _, domain = m[0].rpartition("@")
    shape, size, number = _symbols(local)
    return Format("email", f"email{shape}@{domain}", size, number, lambda x: f"{_written(shape, x)}@{domain}") if size > 1 else None


def _day(y: str, m: str, d: str) -> int | None:
    try:
        n = dt.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    return n - FIRST if FIRST <= n <= LAST else None


def _date(n: int, write: Callable[[dt.date], str]) -> Format:
    """A date, permuted among those whose day is above 12, or is not, whatever its spelling: so equal dates in any spelling stay linked, and month first stays legible."""
    d = dt.date.fromordinal(FIRST + n)
    if d.day > 12:
        return Format("date", "date>12", _after12(LAST - FIRST + 1), _after12(n), lambda x: write(_unit(x)))
    months = (LAST - FIRST + 1 - _after12(LAST - FIRST + 1)) // 12
    number = 12 * (12 * (d.year - 1900) + d.month - 1) + d.day - 1
    return Format("date", "date", 12 * months, number, lambda x: write(dt.date(1900 + x // 144, x // 12 % 12 + 1, x % 12 + 1)))


def _iso(m: re.Match) -> Format | None:
    n = _day(*m[0].split("-"))
    return n if n is None else _date(n, dt.date.isoformat)


def _unit(k: int) -> dt.date:
    """The ``k``-th date, from ``FIRST``, whose day is above 12."""
    low, high = 0, LAST - FIRST
    while low < high:
        mid = (low + high) // 2
        if _after12(mid + 1) > k:
            high = mid
        else:
            low = mid + 1
    return dt.date.fromordinal(FIRST + low)


def _after12(n: int) -> int:
    """How many of the first ``n`` dates have a day above 12."""
    if n <= 0:
        return 0
    d = dt.date.fromordinal(FIRST + n - 1)
    months = (d.year - 1900) * 12 + d.month - 1
    return dt.date(d.year, d.month, 1).toordinal() - FIRST - 12 * months + max(0, d.day - 12)


def _slashed(m: re.Match) -> Format | None:
    """Day, month, year; or month, day, year where only that is a date."""
    mark, (a, b, y) = m[1], m[0].split(m[1])
    n = _day(y, b, a)
    if n is not None:
        return _date(n, lambda d: d.strftime(f"%d{mark}%m{mark}%Y"))
    n = _day(y, a, b)
    return n if n is None else _date(n, lambda d: d.strftime(f"%m{mark}%d{mark}%Y"))


def _one(read: Callable[[re.Match], Format | None]) -> Callable[[re.Match], Iterator[tuple[int, int, Format]]]:
    """A match that is one value or none."""

    def each(m: re.Match) -> Iterator[tuple[int, int, Format]]:
        if found := read(m):
            yield m.start(), m.end(), found

    return each


#: The patterns of the kinds; where two begin at one place the first listed counts.
KINDS: tuple[tuple[str, str, Callable[[re.Match], Iterator[tuple[int, int, Format]]]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])", _one(_email)),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _ibans),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _one(_ip)),
    ("iso", r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])", _one(_iso)),
    ("slashed", r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9]|[./][0-9])", _one(_slashed)),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _one(_ssn)),
    ("plus", r"(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?\(?[0-9]\)?){8,13}(?![0-9])", _one(_phone)),
    ("phone", r"(?<![0-9A-Za-z.(+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9-])", _one(_phone)),
    ("card", r"(?<![0-9A-Za-z.-])[0-9]+(?:[ -][0-9]+)*(?![0-9A-Za-z])", _cards),
)
COUNTED = ("email", "iban", "ip", "date", "ssn", "phone", "card")


class Pseudonymizer:
    """Replaces personal data in texts. ``key`` decides the pseudonyms; without it they can't be undone."""

    def __init__(self, key: bytes):
        self.key = key
        self.patterns = [(re.compile(p), f) for _, p, f in KINDS]
        self.digit = re.compile("[0-9]")
        self.permutations: dict[str, Permutation] = {}

    def _permutation(self, f: Format) -> Permutation:
        if len(self.permutations) > 10_000:
            self.permutations.clear()
        if f.name not in self.permutations:
            self.permutations[f.name] = Permutation(self.key, f.name, f.size)
        return self.permutations[f.name]

    def find(self, text: str) -> Iterator[tuple[int, int, Format]]:
        """Values in the text that don't overlap: of those that do, the one that begins first, then the first listed."""
        found = []
        has_digit = self.digit.search(text)
        for order, (p, f) in enumerate(self.patterns):
            if (order == 0 and "@" in text) or (order and has_digit):
                found += [(a, order, b, x) for m in p.finditer(text) for a, b, x in f(m)]
        at = 0
        for a, _, b, x in sorted(found, key=lambda v: v[:2]):
            if a >= at:
                yield a, b, x
                at = b

    def replace(self, text: str, back: bool = False) -> tuple[str, list[str]]:
        """The text with pseudonyms (or, ``back``, the values they stand for), and the kinds replaced."""
        parts, at, kinds = [], 0, []
        for a, b, f in self.find(text):
            parts += [text[at:a], f.write(self._permutation(f)(f.number, back))]
            kinds.append(f.kind)
            at = b
        return "".join([*parts, text[at:]]) if parts else text, kinds


def pseudonymize(docs: DataFrame, key: bytes, *, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_email`` .. ``n_card``: how many values of each kind were replaced.

    A null text stays null and counts nothing. All rows stay, repeated ones
    too, and no rows give none; whole texts are read, however long. All columns
    stay, those with a count's name are replaced; no shuffle. ``text`` is found
    as Spark finds names (upper or lower case alike, unless the session says
    otherwise); if it fits no column or several, that is an error. Values of
    other formats, and those that fail their kind's check (the Luhn digit, the
    calendar, the ranges), stay as they are.
    """

    def start():
        p = Pseudonymizer(key)

        def step(columns):
            texts, counts = [], [[] for _ in COUNTED]
            for t in columns[0].to_pylist():
                new, kinds = p.replace(t, back) if t else (t, [])
                texts.append(new)
                for c, k in zip(counts, COUNTED, strict=True):
                    c.append(kinds.count(k))
            return [pa.array(texts, pa.string()), *counts]

        return step

    text = name_of(docs, text)
    (own,) = free_names(docs, "__text")
    new = [T.StructField(own, T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in COUNTED]]
    out = append_columns(docs, {"text": F.col(quoted(text))}, new, start)
    return out.select(*[F.col(own).alias(c) if c == text else F.col(quoted(c)) for c in out.columns if c != own])
