"""Fill-in-middle: documents cut into prefix, middle and suffix, and put in another order behind sentinels.

A batch is worked on as one Arrow buffer of UTF-8 bytes. A table gives each byte its class, a second
one says of two adjacent bytes whether a unit begins between them, and a running count of those
places that starts anew with each document turns "unit k of document d" into a position that one
binary search finds for all cuts of all documents. Only the joining of the pieces walks the rows.

Units are code points (the default), bytes, words (with the white space before them) or lines. Cuts
and forms come from numbers that Spark derives from the id, so a document is always cut alike,
whatever batch, task or attempt it is in; there is no shuffle and no state.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a
null id counts as the empty string; rows that repeat get a row each, cut alike; bytes that are no
continuation of a character begin one, whatever they are; an empty table gives no row. Texts of any
length go through whole: a batch is cut at about CHUNK_BYTES, a longer text is a batch of its own.
All columns of the documents go along, whatever they are called, unless they bear the name of a new one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, chunks

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Classes of bytes.
LETTER, CONTINUATION, BLANK, NEWLINE = range(4)
CLASS = np.full(256, LETTER, np.uint8)
CLASS[SPACE] = BLANK
CLASS[0x0A] = NEWLINE
CLASS[0x80:0xC0] = CONTINUATION


def _pairs(begins) -> np.ndarray:
    """Of (class before, class here), as one index of four times the first and the second: whether a unit begins here."""
    return np.array([begins(a, b) for a in range(4) for b in range(4)])


_WHITE = (BLANK, NEWLINE)
UNITS = {
    "char": _pairs(lambda a, b: b != CONTINUATION),
    "byte": _pairs(lambda a, b: True),
    "word": _pairs(lambda a, b: a not in _WHITE and b in _WHITE),
    "line": _pairs(lambda a, b: a == NEWLINE),
}


@dataclass(frozen=True)
class Plan:
    """What decides on cuts and forms. `plain` and `spm` are percentages: of all documents, and of those that are cut."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 10
    spm: int = 20
    seed: str = "1"
    unit: str = "char"

    def __post_init__(self):
        marks = self.sentinels
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}")
        if not all(marks) or any(a != b and a in b for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError("sentinels must be three texts, none empty and none within another")
        if any(a[i:] == b[: len(a) - i] for a in marks for b in marks for i in range(1, len(a))):
            raise ValueError("no sentinel may begin with what one ends with, or a text could not be told from them")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def numbers(id_col: str | Column, seed: str) -> list[Column]:
    """The first four groups of eight hexadecimal digits of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def form(text: Column, h: list[Column], plan: Plan) -> Column:
    marked = F.lit(False)
    for mark in plan.sentinels:
        marked |= F.contains(text, F.lit(mark))
    return F.when((text == "") | marked | (h[2] % 100 >= 100 - plan.plain), PLAIN).when(h[3] % 100 < plan.spm, SPM).otherwise(PSM)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the place where each begins (one more at the end); there are no nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def begins(data: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """Mask of the bytes with which a unit begins; a document's first byte is one."""
    kind = CLASS[data]
    pair = np.zeros(len(data), np.uint8)
    pair[1:] = kind[:-1] << 2
    pair |= kind
    mask = UNITS[unit][pair]
    mask[at[:-1][at[1:] > at[:-1]]] = True
    return mask


class Units:
    """Counts and places of the units of all documents of a batch."""

    def __init__(self, data: np.ndarray, at: np.ndarray, unit: str):
        self.at, self.running = at, np.cumsum(begins(data, at, unit), dtype=np.int64 if len(data) > 1 << 31 else np.int32)
        total = np.zeros(len(at), np.int64)  # what has been counted when a document begins: taking it off starts the count anew
        total[at > 0] = self.running[at[at > 0] - 1]
        self.before, self.count = total[:-1], np.diff(total)

    def place(self, k: np.ndarray) -> np.ndarray:
        """The byte at which unit k (from 0) of each document begins; its end for k = count."""
        found = np.searchsorted(self.running, (self.before + k + 1).astype(self.running.dtype))
        return np.minimum(found, self.at[1:])


def arranged(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, forms: list[str], plan: Plan) -> pa.Array:
    """The output texts: low and high are the places of the two cuts."""
    p, s, m = (x.encode() for x in plan.sentinels)
    view, pieces, ends, total = memoryview(data), [], [0], 0
    for a, b, c, d, kind in zip(at[:-1].tolist(), low.tolist(), high.tolist(), at[1:].tolist(), forms, strict=True):
        if kind == PLAIN:
            pieces.append(view[a:d])
            total += d - a
        else:
            pieces += (p, view[a:b], s, view[c:d], m, view[b:c]) if kind == PSM else (s, view[c:d], p, view[a:b], m, view[b:c])
            total += d - a + len(p) + len(s) + len(m)
        ends.append(total)
    return pa.LargeStringArray.from_buffers(len(forms), pa.py_buffer(np.array(ends, np.int64)), pa.py_buffer(b"".join(pieces)))


def cut(text: pa.Array, h1: pa.Array, h2: pa.Array, kinds: pa.Array, plan: Plan) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: the outputs, the number of units, of those before and of those between the cuts."""
    data, at = buffers(text)
    units = Units(data, at, plan.unit)
    one, two = (np.asarray(h, np.int64) % (units.count + 1) for h in (h1, h2))
    low, high = np.minimum(one, two), np.maximum(one, two)
    return arranged(data, at, units.place(low), units.place(high), kinds.to_pylist(), plan), units.count, low, high - low


def filled_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `output`, `form`, `n` (units) and `prefix_units`, `middle_units` (null where plain)."""
    new = ["output", "form", "n", "prefix_units", "middle_units"]
    others = [c for c in docs.columns if c.lower() not in new]
    text, h = F.coalesce(F.col(text_col).cast("string"), F.lit("")), numbers(id_col, plan.seed)
    narrow = docs.select(*(F.col(f"`{c}`") for c in others), text, h[0], h[1], form(text, h, plan))
    source = narrow.toDF(*(f"c{i}" for i in range(len(others) + 4)))
    *rest, t, h1, h2, kind = source.columns
    schema = T.StructType([*(source.schema[c] for c in rest), T.StructField("output", T.StringType()), T.StructField("form", T.StringType()), *(T.StructField(c, T.LongType()) for c in new[2:])])

    def work(batches):
        for whole in batches:
            size = np.diff(buffers(whole.column(t))[1]).tolist()
            for i, j in chunks(size):
                batch = whole.slice(i, j - i)
                output, n, prefix, middle = cut(batch.column(t), batch.column(h1), batch.column(h2), batch.column(kind), plan)
                plain = np.array([k == PLAIN for k in batch.column(kind).to_pylist()], bool)
                counts = pa.array(n), pa.array(prefix, mask=plain), pa.array(middle, mask=plain)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), output.cast(pa.string()), batch.column(kind), *counts], names=schema.names)

    return source.mapInArrow(work, schema).toDF(*others, *new)


def restored(output: str | Column, kind: str | Column, plan: Plan = Plan()) -> Column:
    """The text that an output of the given form was made from. A text that is cut holds no sentinel, so the first of each is the one that was put there."""
    output, kind = (F.col(x) if isinstance(x, str) else x for x in (output, kind))
    p, s, m = (F.lit(x) for x in plan.sentinels)
    at = lambda mark: F.instr(output, mark)
    between = lambda a, size, b: F.substr(output, a + F.lit(size), b - a - F.lit(size))
    lp, ls, lm = (len(x) for x in plan.sentinels)
    middle = F.substr(output, at(m) + F.lit(lm))
    psm = F.concat(between(at(p), lp, at(s)), middle, between(at(s), ls, at(m)))
    spm = F.concat(between(at(p), lp, at(m)), middle, between(at(s), ls, at(p)))
    return F.when(kind == PLAIN, output).when(kind == PSM, psm).otherwise(spm)
