"""Conversations as training text: rendered by a compiled template, with the ranges that count for the loss, and read back.

Turns are brought together and sorted by Spark, one shuffle; a task then streams through its
conversations, turn by turn. A long conversation comes out in several parts of about PART_CHARS
code points, so neither a task nor a cell holds one of any length whole.

Strings that mark turns are escaped in the texts: one backslash more after the first character, also
where there are some already, so that the reader can take it away again and no text can pose as a mark.

Defined cases: a null text or role is empty; turns go by number (null first), equal ones by role and
text; turns that repeat are all kept; a null conv_id is a conversation of its own; an empty table
gives no conversation; texts of any length go whole; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import Template

PART_CHARS = 1 << 20
#: Rows and code points that a worker hands on at once.
ROWS, CHARS = 2000, 1 << 22
SLASH = "\\"


class Controls:
    """The strings that mark turns, and the escaping of what looks like one."""

    def __init__(self, marks: Iterable[str]):
        self.marks = tuple(dict.fromkeys(marks))
        if any(len(m) < 2 or SLASH in m for m in self.marks):
            raise ValueError("a mark has two characters at least and no backslash")
        if any(a != b and a in b for a in self.marks for b in self.marks):
            raise ValueError("no mark may lie within another")
        if any(a[i:] == b[: len(a) - i] for a in self.marks for b in self.marks for i in range(1, len(a))):
            raise ValueError("no mark may begin with what one ends with")
        each = "|".join(rf"{re.escape(m[0])}(?=\\*{re.escape(m[1:])})" for m in self.marks)
        self._looks, self._escaped = re.compile(f"({each})"), re.compile("|".join(rf"(?<={re.escape(m[0])})\\(?=\\*{re.escape(m[1:])})" for m in self.marks))

    def escape(self, text: str) -> str:
        return self._looks.sub(r"\1\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub("", text)


@dataclass(frozen=True)
class Style:
    """A template and how its turns are told apart: (role, what stands before the text, what stands behind it); `other` is (before the role, between role and text, behind)."""

    template: str
    turns: tuple[tuple[str, str, str], ...]
    other: tuple[str, str, str]
    marks: tuple[str, ...]

    def controls(self) -> Controls:
        return Controls(self.marks)

    def compiled(self) -> Template:
        return Template(self.template, {"escape": self.controls().escape})

    def reader(self) -> re.Pattern:
        """A turn: one group for the text of each known role, two for another role and its text."""
        known = [f"{re.escape(a)}(.*?){re.escape(b)}" for _, a, b in self.turns]
        a, b, c = map(re.escape, self.other)
        return re.compile("|".join([*known, f"{a}(.*?){b}(.*?){c}"]), re.S)


INST = Style(
    template="""
{%- for m in messages -%}
    {%- if m.role == 'user' -%} {{ '[INST] ' }}{{ m.text | escape }}{{ ' [/INST]' }}
    {%- elif m.role == 'assistant' -%} <s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
    {%- elif m.role == 'system' -%} {{ '[SYS] ' }}{{ m.text | escape }}{{ ' [/SYS]' }}
    {%- else -%} [ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>
    {%- endif -%}
{%- endfor -%}
""",
    turns=(("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"), ("system", "[SYS] ", " [/SYS]")),
    other=("[ROLE]", "[/ROLE]", "</s>"),
    marks=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"),
)

PARTS = "conv_id long, part long, text string, spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def stream(batches, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def in_batches(rows: Iterator[tuple], types: dict[str, pa.DataType], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size; text: the place of the column whose length counts."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 0 if text is None else len(row[text])
        if len(held) >= ROWS or chars >= CHARS:
            yield _batch(held, types)
            held, chars = [], 0
    if held:
        yield _batch(held, types)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def formatted(turns: DataFrame, style: Style = INST, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, spans): each conversation rendered; parts follow each other in a partition, counted from 0."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches):
        template = style.compiled()

        def parts():
            for conv, group in groupby(stream(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, role, text in group)
                for k, (text, spans) in enumerate(template.parts(messages, part_chars)):
                    yield conv, k, text, [{"start": a, "end": b} for a, b in spans]

        yield from in_batches(parts(), {"conv_id": pa.int64(), "part": pa.int64(), "text": pa.string(), "spans": _SPANS}, 2)

    return rows.select("conv_id", "role", "text").mapInArrow(render, PARTS)


def turns_of(text: str, style: Style, pattern: re.Pattern, controls: Controls) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a part; a part that is not made of turns through and through is an error."""
    at, known = 0, len(style.turns)
    for m in pattern.finditer(text):
        if m.start() != at:
            break
        at, k = m.end(), m.lastindex
        yield (style.turns[k - 1][0], controls.unescape(m[k])) if k <= known else (controls.unescape(m[known + 1]), controls.unescape(m[known + 2]))
    if at != len(text):
        raise ValueError(f"no turn begins at {at}")


def in_order(parts: DataFrame) -> DataFrame:
    """Stored parts brought together again."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")


def read_turns(parts: DataFrame, style: Style = INST) -> DataFrame:
    """(conv_id, turn, role, text): the turns of formatted parts, counted from 0; the parts of a conversation follow each other."""

    def read(batches):
        pattern, controls = style.reader(), style.controls()

        def rows():
            for conv, group in groupby(stream(batches, "conv_id", "text"), key=lambda r: r[0]):
                turn = 0
                for _, text in group:
                    for role, said in turns_of(text, style, pattern, controls):
                        yield conv, turn, role, said
                        turn += 1

        yield from in_batches(rows(), {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}, 3)

    return parts.select("conv_id", "text").mapInArrow(read, "conv_id long, turn long, role string, text string")


def read_back(parts: DataFrame, style: Style = INST) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted parts; the parts of a conversation follow each other."""
    types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def read(batches):
        pattern, controls = style.reader(), style.controls()

        def rows():
            for conv, group in groupby(stream(batches, "conv_id", "text", "spans"), key=lambda r: r[0]):
                n, chars, loss_chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for _, text, spans in group:
                    chars += len(text)
                    for role, said in turns_of(text, style, pattern, controls):
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode())
                    for span in spans:
                        said = controls.unescape(text[span["start"] : span["end"]])
                        loss_chars += len(said)
                        loss.update(said.encode())
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from in_batches(rows(), types)

    return parts.select("conv_id", "text", "spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
