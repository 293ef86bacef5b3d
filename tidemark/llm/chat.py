"""Chat formatting: conversations rendered by a compiled template, and read back.

The default template marks each turn with its role and its end, and puts a
backslash before every control string inside a role or text (and before every
backslash), so whatever a turn says it can neither end itself nor begin another,
and the turns can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions
from tidemark.llm.template import Template

#: What begins a turn (and ends its role), and what ends it.
BEGIN, END = "###", "</turn>"
DEFAULT = (
    "{% for m in messages %}### {{ m.role|guard }} ###\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|guard }}{% endgeneration %}{% else %}{{ m.text|guard }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_CONTROL = re.compile(rf"\\|{BEGIN}|{END}")
_GUARDED = re.compile(rf"\\(\\|{BEGIN}|{END})")
_MARK = re.compile(rf"\\(?:\\|{BEGIN}|{END})|({BEGIN}|{END})")


def guard(text: str | None) -> str:
    """``text`` with a backslash before each backslash and control string."""
    return _CONTROL.sub(r"\\\g<0>", text or "")


def unguard(text: str) -> str:
    return _GUARDED.sub(r"\1", text)


def template(source: str = DEFAULT) -> Template:
    return Template(source, {"guard": guard})


def read_turns(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, read from formatted text that comes in pieces; holds one turn at a time."""
    held: list[str] = []
    tail = ""
    for piece in pieces:
        held.append(piece)
        near, tail = tail + piece, (tail + piece)[1 - len(END) :]
        if END not in near:
            continue
        text, at = "".join(held), 0
        while True:
            marks = []
            for m in _MARK.finditer(text, at):
                if m[1]:
                    marks.append(m)
                    if len(marks) == 3:
                        break
            if len(marks) < 3:
                break
            begin, role_end, end = marks
            if [m[1] for m in marks] != [BEGIN, BEGIN, END]:
                raise ValueError("the text isn't a sequence of turns")
            yield unguard(text[begin.end() + 1 : role_end.start() - 1]), unguard(text[role_end.end() + 1 : end.start()])
            at = end.end()
        held = [text[at:]]
    if "".join(held).strip("\n"):
        raise ValueError("the text ends inside a turn")


class _Digest:
    """Length in code points and SHA-256 of texts, one after another."""

    def __init__(self):
        self.chars, self.sha = 0, hashlib.sha256()

    def add(self, text: str) -> None:
        self.chars += len(text)
        self.sha.update(text.encode("utf-8", "surrogatepass"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _sorted_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns dealt out by conversation and sorted; each conversation is in one task, as a stream."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    slim = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    return slim.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(turns: DataFrame, source: str = DEFAULT, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: ``conv_id``, ``formatted`` and ``loss_spans`` (start, end in code points).

    Turns go by ``turn``, then role, then text; a null turn comes first; null
    roles and texts are empty; the rows without ``conv_id`` are one
    conversation; repeated rows are turns of their own. No rows, no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(source)
        for conv, rows in groupby(_rows(batches), itemgetter(0)):
            formatted, spans = t.render(messages=({"role": r, "text": x} for _, _, r, x in rows))
            spans = [{"start": a, "end": b} for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([conv], kinds.types[0]), pa.array([formatted]), pa.array([spans], kinds.types[2])], schema=kinds)

    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(kind))])
    return _sorted_turns(turns, conv_id, turn, role, text).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digest_conversations(turns: DataFrame, source: str = DEFAULT, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_at_once: int = 2000) -> DataFrame:
    """As ``format_conversations``, but with digests of what is read back from the formatted text.

    Columns: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256``, ``formatted_chars``. Conversations are rendered, read and
    digested as streams, so one of any length needs the memory of one turn.
    Other columns of ``turns`` are left out, whatever their names.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(t: Template, conv: int | None, rows: Iterator[tuple]) -> tuple:
        said, learned, count = _Digest(), _Digest(), {"turns": 0, "chars": 0}

        def formatted() -> Iterator[str]:
            for piece, learn in t.pieces(messages=({"role": r, "text": x} for _, _, r, x in rows)):
                count["chars"] += len(piece)
                if learn:
                    learned.add(unguard(piece))
                yield piece

        for r, x in read_turns(formatted()):
            count["turns"] += 1
            said.add(f"{r}\n{x}\n")
        return conv, count["turns"], said.sha.hexdigest(), learned.chars, learned.sha.hexdigest(), count["chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, out = template(source), []
        for conv, rows in groupby(_rows(batches), itemgetter(0)):
            out.append(digest(t, conv, rows))
            if len(out) == rows_at_once:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return _sorted_turns(turns, conv_id, turn, role, text).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
