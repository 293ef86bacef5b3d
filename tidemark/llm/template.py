"""A sandboxed template language, compiled to Python closures.

``{{ expression }}``, ``{% for x in xs %} .. {% endfor %}``, ``{% if a %} ..
{% elif b %} .. {% else %} .. {% endif %}``, ``{% set x = a %}`` and
``{% generation %} .. {% endgeneration %}`` around what a model is to learn.
Expressions have literals, names, ``a.key`` and ``a['key']``, ``not``, ``and``,
``or``, comparisons, ``in``, ``+``, ``~`` (text), ``%``, ``b if a else c`` and filters
(``a|upper``). A name is looked up among the given values only, and ``a.key`` in
mappings only, so a template reaches no Python attribute and calls nothing but
the filters.

The text is parsed to a syntax tree, constant parts of the tree are folded, and
each node becomes a closure. Rendering is lazy: loops take one item ahead, so a
sequence of any length is rendered in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template can't be parsed, or asks for what it may not have."""


# --- Syntax tree ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Show:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- Parsing -------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~%|.()\[\],=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def end(self, value: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def whole(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("?", (test, value, self.whole()))
        return value

    def _left(self, below: Callable, *ops: str) -> Any:
        value = below()
        while op := self.take(*ops):
            value = Op(op, (value, below()))
        return value

    def either(self) -> Any:
        return self._left(self.both, "or")

    def both(self) -> Any:
        return self._left(self.negation, "and")

    def negation(self) -> Any:
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        value = self.total()
        if self.peek("not"):
            self.at += 1
            self.need("in")
            return Op("not", (Op("in", (value, self.total())),))
        op = self.take("==", "!=", "<", "<=", ">", ">=", "in")
        return Op(op, (value, self.total())) if op else value

    def total(self) -> Any:
        return self._left(self.filtered, "+", "-", "~", "%")

    def filtered(self) -> Any:
        value = self.primary()
        while self.take("|"):
            name, args = self.name(), [value]
            if self.take("("):
                while not self.take(")"):
                    args.append(self.whole())
                    self.take(",")
            value = Filter(name, tuple(args))
        return value

    def primary(self) -> Any:
        if self.take("("):
            value = self.whole()
            self.need(")")
        elif self.take("-"):
            return Op("-", (Const(0), self.primary()))
        elif self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        else:
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "num":
                value = Const(int(text))
            elif kind == "str":
                value = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
            elif kind == "name":
                value = Const(_WORDS[text]) if text in _WORDS else Name(text)
            else:
                raise TemplateError(f"unexpected {text!r}")
        while op := self.take(".", "["):
            if op == ".":
                value = Item(value, Const(self.name()))
            else:
                value = Item(value, self.whole())
                self.need("]")
        return value


def parse(source: str) -> tuple:
    """The syntax tree of a template. ``-`` inside a tag's bracket strips the white space beside it."""
    tags: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        before = source[at : m.start()]
        tags.append(("text", (before.lstrip() if strip else before).rstrip() if m[1] or m[4] else before.lstrip() if strip else before))
        if m[2] is not None:
            tags.append(("show", m[2]))
        elif m[5] is not None:
            tags.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(m[3] or m[6])
    tags.append(("text", source[at:].lstrip() if strip else source[at:]))
    tags.reverse()
    body, stop = _block(tags)
    if stop:
        raise TemplateError(f"unexpected {stop!r}")
    return body


def _block(tags: list[tuple[str, str]]) -> tuple[tuple, str]:
    """Nodes up to the tag that ends the block, and that tag."""
    out: list[Any] = []
    while tags:
        kind, text = tags.pop()
        if kind == "text":
            if text:
                out.append(Text(text))
            continue
        if kind == "show":
            e = _Expression(text)
            out.append(Show(e.end(e.whole())))
            continue
        word, _, rest = text.partition(" ")
        e = _Expression(rest)
        if word == "for":
            name = e.name()
            e.need("in")
            items = e.end(e.whole())
            out.append(For(name, items, _closed(tags, "endfor")))
        elif word == "if":
            out.append(_if(tags, e.end(e.whole())))
        elif word == "set":
            name = e.name()
            e.need("=")
            out.append(Set(name, e.end(e.whole())))
        elif word == "generation":
            out.append(Generation(_closed(tags, "endgeneration")))
        else:
            return tuple(out), text
    return tuple(out), ""


def _closed(tags: list[tuple[str, str]], end: str) -> tuple:
    body, stop = _block(tags)
    if stop != end:
        raise TemplateError(f"{end!r} expected, not {stop!r}")
    return body


def _if(tags: list[tuple[str, str]], test: Any) -> If:
    then, stop = _block(tags)
    if stop == "endif":
        return If(test, then, ())
    if stop == "else":
        return If(test, then, _closed(tags, "endif"))
    if stop.startswith("elif "):
        e = _Expression(stop[5:])
        return If(test, then, (_if(tags, e.end(e.whole())),))
    raise TemplateError(f"'endif' expected, not {stop!r}")


# --- Meaning -------------------------------------------------------------------------------------------------------


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, (str, int)) and type(a) is type(b) else _shown(a) + _shown(b)


def _less(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a < b


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _less, ">": lambda a, b: _less(b, a),
    "<=": lambda a, b: a == b or _less(a, b), ">=": lambda a, b: a == b or _less(b, a),
    "in": lambda a, b: isinstance(b, (str, list, tuple, dict)) and (not isinstance(b, str) or isinstance(a, str)) and a in b,
    "+": _plus, "~": lambda a, b: _shown(a) + _shown(b), "not": lambda a: not a,
    "-": lambda a, b: a - b if isinstance(a, int) and isinstance(b, int) else 0,
    "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) and b else 0,
}
FILTERS: dict[str, Callable] = {
    "upper": lambda a: _shown(a).upper(),
    "lower": lambda a: _shown(a).lower(),
    "trim": lambda a: _shown(a).strip(),
    "length": lambda a: len(a) if isinstance(a, (str, list, tuple, dict)) else 0,
    "default": lambda a, b="": b if a is None else a,
    "replace": lambda a, b, c: _shown(a).replace(_shown(b), _shown(c)),
}


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def fold(node: Any, filters: dict[str, Callable]) -> Any:
    """``node`` with its constant parts computed: constant operations, branches never taken, texts side by side."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in node:
            x = fold(x, filters)
            if isinstance(x, Show) and isinstance(x.value, Const):
                x = Text(_shown(x.value.value))
            if isinstance(x, If) and isinstance(x.test, Const):
                parts = x.then if x.test.value else x.other
            else:
                parts = (x,)
            for p in parts:
                if isinstance(p, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + p.text)
                elif not (isinstance(p, Text) and not p.text):
                    out.append(p)
        return tuple(out)
    if isinstance(node, (Const, Name, Text)):
        return node
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        first = args[0]
        if node.op in ("and", "or", "?") and isinstance(first, Const):
            if node.op == "?":
                return args[1] if first.value else args[2]
            return args[1] if bool(first.value) == (node.op == "and") else first
        if node.op in _OPS and all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        args = tuple(fold(a, filters) for a in node.args)
        return Const(filters[node.name](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Filter(node.name, args)
    if isinstance(node, Item):
        of, key = fold(node.of, filters), fold(node.key, filters)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Show):
        return Show(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.items, filters), fold(node.body, filters))
    if isinstance(node, If):
        return If(fold(node.test, filters), fold(node.then, filters), fold(node.other, filters))
    return Generation(fold(node.body, filters))


# --- Closures ------------------------------------------------------------------------------------------------------


def _value(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda scope: _item(of(scope), key(scope))
    args = [_value(a, filters) for a in node.args]
    if isinstance(node, Filter):
        f = filters[node.name]
        return lambda scope: f(*(a(scope) for a in args))
    if node.op == "?":
        test, then, other = args
        return lambda scope: then(scope) if test(scope) else other(scope)
    if node.op in ("and", "or"):
        a, b = args
        return (lambda scope: a(scope) and b(scope)) if node.op == "and" else (lambda scope: a(scope) or b(scope))
    f = _OPS[node.op]
    return lambda scope: f(*(a(scope) for a in args))


def _looped(items: Iterable) -> Iterator[tuple[Any, dict]]:
    it, i = iter(items), 0
    try:
        now = next(it)
    except StopIteration:
        return
    while True:
        try:
            later, last = next(it), False
        except StopIteration:
            later, last = None, True
        yield now, {"index": i + 1, "index0": i, "first": i == 0, "last": last}
        if last:
            return
        now, i = later, i + 1


def _render(node: Any, filters: dict[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, tuple):
        parts = [_render(x, filters) for x in node]

        def block(scope, learn):
            for p in parts:
                yield from p(scope, learn)

        return block
    if isinstance(node, Text):
        text = node.text

        def literal(scope, learn):
            yield text, learn

        return literal
    if isinstance(node, Show):
        value = _value(node.value, filters)

        def show(scope, learn):
            yield _shown(value(scope)), learn

        return show
    if isinstance(node, Set):
        name, value = node.name, _value(node.value, filters)

        def put(scope, learn):
            scope[name] = value(scope)
            yield from ()

        return put
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _render(node.then, filters), _render(node.other, filters)
        return lambda scope, learn: (then if test(scope) else other)(scope, learn)
    if isinstance(node, For):
        name, items, body = node.name, _value(node.items, filters), _render(node.body, filters)

        def loop(scope, learn):
            got = items(scope)
            for x, state in _looped(got if got is not None and not isinstance(got, (str, int)) else ()):
                yield from body(scope | {name: x, "loop": state}, learn)

        return loop
    body = _render(node.body, filters)
    return lambda scope, learn: body(scope, True)


class Template:
    """A compiled template. ``pieces`` yields texts and whether they are to be learned."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = FILTERS | (filters or {})
        self.tree = fold(parse(source), self.filters)
        self._run = _render(self.tree, self.filters)

    def pieces(self, **values: Any) -> Iterator[Piece]:
        return (p for p in self._run(dict(values), False) if p[0])

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the ranges of it that are to be learned (end exclusive; neighbours are kept apart)."""
        out, spans, at = [], [], 0
        for text, learn in self.pieces(**values):
            if learn:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans
