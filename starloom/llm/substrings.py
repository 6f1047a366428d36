"""Removal of passages of words that a document with a smaller id has, by recompression.

The words of each text are parsed in rounds, as in recompression: first maximal runs of one word
get a name, then in each round the names are split into left and right ones by a bit of the name
and every pair (left, right) gets a name. Names are hashes of what they stand for, so they are
the same in every task and no dictionary has to be shuffled. How a place is parsed depends only on
some words around it; each symbol carries these bounds. Every window of `width` words then
contains, with its bounds, some symbol (its words at least); the one of the highest round, the
leftmost of equals, is the window's anchor. Equal windows have equal anchors, wherever they stand.

Round 1 on Spark groups anchors and keeps those that more than one document has. Only windows with
such an anchor are named (hash of all their words) and meet at their anchor: a window is repeated
if an equal one (same anchor, same 64-bit hash) is in a document with a smaller id. Anchors of very many documents
go a way of their own, by aggregation and a join that Spark splits.

Defined cases: null and empty texts have no words and lose none; texts with fewer words than a
window lose none; equal texts keep only that of the smallest id (if they have a window); rows that repeat id and
text are treated alike, and none is the earlier; a null id is later than all others; an empty
table gives no row; further columns go along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, by_bytes, discard, mix, packed, span_names, spread, trim, word_bounds, word_hashes, written
from .repeats import buckets, covered, first_and_last, prepared

WIDTH, ROUNDS = 50, 9
#: An anchor that so many runs of windows have is not gathered in one task.
HOT = 2000
_NAME = U64(0x9FB21C651E98DF25)


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _NAME + mix(b + U64(0xD6E8FEB86659FD93)))


def parse(words: np.ndarray, first: np.ndarray):
    """Yields, per round, names and bounds (low, high) of all symbols. first: first word of each text, and the total.

    A symbol of round r stands wherever the words from low to high (exclusive) stand; beyond a
    text's edge there is no word, so what depends on the edge has bounds outside the text.
    """
    n = len(words)
    place = np.arange(n)
    head = np.zeros(n + 1, bool)
    head[first] = True  # symbol i begins a text
    yield words, place, place + 1
    # runs of one word
    begin = np.flatnonzero(head[:n] | np.concatenate([[True], words[1:] != words[:-1]]))
    stop = np.append(begin[1:], n)
    names = np.where(stop - begin > 1, pair_name(words[begin], (stop - begin).astype(U64)), words[begin])
    low, high, head = begin - 1, stop + 1, np.append(head[begin], True)
    yield names, low, high
    for r in range(ROUNDS):
        n = len(names)
        left = mix(names + U64(r)) >> U64(63) == 0  # else right
        joins = np.zeros(n, bool)  # with the next
        joins[:-1] = left[:-1] & ~left[1:] & ~head[1:n]
        taken = np.concatenate([[False], joins[:-1]])
        new_low, new_high = low.copy(), high.copy()
        single = ~joins & ~taken
        # a single left symbol has a left one behind it, a single right one a right one before it
        i = np.flatnonzero(single & left)
        new_high[i] = np.where(head[i + 1], high[i] + 1, high[np.minimum(i + 1, n - 1)])
        i = np.flatnonzero(single & ~left)
        new_low[i] = np.where(head[i], low[i] - 1, low[np.maximum(i - 1, 0)])
        i = np.flatnonzero(joins)
        new_high[i] = high[i + 1]
        names = names.copy()
        names[i] = pair_name(names[i], names[i + 1])
        keep = ~taken
        names, low, high, head = names[keep], new_low[keep], new_high[keep], np.append(head[:n][keep], True)
        low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
        yield names, low, high


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and how many each text has."""
    count = np.maximum(0, np.diff(first) - width + 1)
    return spread(first[:-1], count), count


def anchors(words: np.ndarray, first: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The anchor's name of each window."""
    out = np.zeros(len(starts), U64)
    for r, (names, low, high) in enumerate(parse(words, first)):
        at = np.searchsorted(low, starts)
        inside = at < len(low)
        inside[inside] = high[at[inside]] <= starts[inside] + width
        with np.errstate(over="ignore"):
            out[inside] = mix(names[at[inside]] + U64(r + 1) * _NAME)
    return out


def parsed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, at = packed(texts)
    starts, ends = word_bounds(data)
    return word_hashes(data, starts, ends), np.searchsorted(starts, at)


RUN = "key long, __id long, __k long, first int, n int"


def anchor_runs(docs: DataFrame, width: int) -> DataFrame:
    """Runs of windows with one anchor: key, document, first window, how many."""

    def work(batches):
        for batch, texts in by_bytes(batches):
            words, first = parsed(texts)
            starts, count = windows(first, width)
            key = anchors(words, first, starts, width)
            owner = np.repeat(np.arange(len(texts)), count)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            take = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), batch.column("__id").take(take), batch.column("__k").take(take), pa.array((starts[at] - first[owner[at]]).astype(np.int32)), pa.array(np.diff(np.append(at, len(key))).astype(np.int32))], names=["key", "__id", "__k", "first", "n"])

    return docs.select("__id", "__k", "text").mapInArrow(work, RUN)


def named_windows(docs: DataFrame, width: int) -> DataFrame:
    """For each run of a document's list: its windows' hashes, packed. docs: __id, __k, text, runs.

    A run that a document of the same batch with a smaller id has too is repeated as a whole and goes
    on without hashes, so a family of like documents sends a run once a batch.
    """

    def work(batches):
        for batch, texts in by_bytes(batches):
            words, first = parsed(texts)
            runs = batch.column("runs")
            size = np.diff(runs.offsets.to_numpy())
            flat = runs.flatten()
            key, at, n, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            owner = np.repeat(np.arange(len(texts)), size)
            start = spread(at.astype(np.int64) + first[owner], n)
            raw = span_names(words, start, start + width).tobytes()
            end = np.cumsum(n.astype(np.int64)) * 8
            take = pa.array(owner)
            content = [raw[e - 8 * m : e] for e, m in zip(end.tolist(), n.tolist(), strict=True)]
            least: dict[tuple[int, bytes], int] = {}
            ids = batch.column("__id").to_numpy()[owner].tolist()
            for i, x in zip(ids, zip(key.tolist(), content, strict=True), strict=True):
                if i < least.get(x, 1 << 63):
                    least[x] = i
            kept = [x if least[k, x] == i else None for i, k, x in zip(ids, key.tolist(), content, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("__id").take(take), batch.column("__k").take(take), pa.array(at), pa.array(n), pa.array(hot), pa.array(kept, pa.binary())], names=["key", "__id", "__k", "first", "n", "hot", "hashes"])

    return docs.mapInArrow(work, "key long, __id long, __k long, first int, n int, hot boolean, hashes binary")


SPAN = "__k long, first int, last int"


def repeated(key, table):
    """Of one bucket: the windows that an equal window of a smaller id has, as spans of window starts."""
    raw = table.column("hashes").to_pylist()
    n = np.array([len(x) // 8 for x in raw], np.int64)
    rows = np.repeat(np.arange(len(n)), n)
    anchor = table.column("key").to_numpy().view(U64)[rows]
    doc, row_key, first = (table.column(c).to_numpy() for c in ("__id", "__k", "first"))
    name = mix(np.frombuffer(b"".join(raw), U64) ^ mix(anchor))
    order = np.lexsort((doc[rows], name))
    new = np.ones(len(order), bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    least = doc[rows[order]][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc[:0]
    flags = np.zeros(len(order), bool)
    flags[order] = doc[rows[order]] > least
    at = np.cumsum(n) - n
    a, b = first_and_last(flags, at)
    r = rows[a]
    trim()
    return pa.table({"__k": row_key[r], "first": (first[r] + a - at[r]).astype(np.int32), "last": (first[r] + b - at[r]).astype(np.int32)})


def hot_repeated(hot: DataFrame) -> DataFrame:
    """The same for anchors of very many documents: a row per window, partial minima, then a join that can be split."""

    def unpack(batches):
        for batch in batches:
            raw = batch.column("hashes").to_pylist()
            n = np.array([len(x) // 8 for x in raw], np.int64)
            take = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("__id").take(take), batch.column("__k").take(take), pa.array(spread(batch.column("first").to_numpy().astype(np.int64), n).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["key", "__id", "__k", "first", "name"])

    each = hot.mapInArrow(unpack, "key long, __id long, __k long, first int, name long")
    least = written(each.groupBy("key", "name").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most").drop("most"))
    return each.join(least, ["key", "name"]).where("__id > least").select("__k", "first", F.col("first").alias("last"))


def repeats(table: DataFrame, parts: int, width: int, hot: int = HOT) -> DataFrame:
    """(__k, __spans): ranges of starts of repeated windows, for documents that are no copies."""
    source = table.where("not __copy")
    runs = written(anchor_runs(source, width))
    shared = runs.groupBy("key").agg(F.min("__id").alias("low"), F.max("__id").alias("high"), F.count("*").alias("c")).where("low < high").select("key", (F.col("c") > hot).alias("hot"))
    shared = written(shared)  # a plain table on one side lets the join of runs split a frequent key
    lists = runs.join(shared, "key").groupBy("__k").agg(F.collect_list(F.struct("key", "first", "n", "hot")).alias("runs"))
    found = written(named_windows(source.select("__id", "__k", "text").join(lists.hint("shuffle_hash"), "__k"), width))
    discard(runs, shared)
    whole = found.where("hashes is null").select("__k", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    cold = found.where("hashes is not null and not hot").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets(table.sparkSession, parts)))).groupBy("bucket").applyInArrow(repeated, SPAN)
    spans = cold.unionByName(hot_repeated(found.where("hashes is not null and hot"))).unionByName(whole)
    return spans.groupBy("__k").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))


def without_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT, parts: int | None = None) -> DataFrame:
    """The documents with repeated words cut out of `text` (the rest unchanged, white space too), and n_words, n_removed, kept_sha256.

    kept_sha256: of the kept words joined by one space. Columns of these three names are replaced.
    """
    made = ("n_words", "n_removed", "kept_sha256")
    return _cut(docs, width, hot, parts).select(*(_column(c) for c in docs.columns if c not in made), *made)


def _column(name: str) -> Column:
    """A column of the documents as `_cut` has it: whatever their names are, they cannot clash."""
    return F.col("text") if name == "text" else F.col("row")[name].alias(name)


def _cut(docs: DataFrame, width: int, hot: int, parts: int | None) -> DataFrame:
    """row (the other columns as they are), text, n_words, n_removed, kept_sha256."""
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns if c != "text")).alias("row")
    table, parts = prepared(docs.select(row, "doc_id", "text"), parts)
    joined = table.join(repeats(table, parts, width, hot).hint("shuffle_hash"), "__k", "left").select("row", "text", "__copy", "__spans")
    schema = T.StructType([table.schema["row"], table.schema["text"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def cut(batches):
        for batch, texts in by_bytes(batches):
            out, n_words, n_removed, sha = batch.column("text").to_pylist(), [], [], []
            copies, spans = batch.column("__copy").to_pylist(), batch.column("__spans").to_pylist()
            for i, (text, copy, some) in enumerate(zip(texts, copies, spans, strict=True)):
                words, gone = text.split(), 0
                n_words.append(len(words))
                if copy and len(words) >= width:
                    gone, words, out[i] = len(words), [], ""
                elif some:
                    mask = covered([(x["first"], x["last"]) for x in some], width, len(words))
                    gone = int(mask.sum())
                    out[i] = kept_text(text, mask)
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def kept_text(text: bytes, mask: np.ndarray) -> str:
    """The text without the masked words and the white space behind each."""
    starts, ends = word_bounds(np.frombuffer(text + b"\n", np.uint8))
    follow = np.append(starts[1:], len(text))
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    parts, last = [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        parts.append(text[last : starts[a]])
        last = int(follow[b - 1])
    return b"".join([*parts, text[last:]]).decode()


def shortened(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with repeated passages cut out; those that lose all their words go. n_chars follows the text."""
    found = _cut(docs, width, HOT, None).where("n_removed = 0 or n_removed < n_words")
    columns = {c: _column(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"]).alias("n_chars")
    return found.select(*columns.values())
