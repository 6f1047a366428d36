"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

A-Z is lower-cased; words are maximal runs of bytes that are digits, lower-case letters or not
ASCII. A pattern is `window` consecutive words of an item, or all words of a shorter item. For
each pattern length a table gives, for a block of two words, how far the search may move on
without missing an occurrence; where it may not move at all, the block's bucket gives the
patterns that end so, and those whose window hash agrees are compared byte by byte.

Defined cases: null or empty texts, and texts without a word, have no words and hit nothing;
items without words match nothing; equal items each count; rows that repeat get a row each;
a null item_id marks words and is in no item list; an empty benchmark hits nothing; further
columns are ignored.

Scale: documents are scanned in place, without a shuffle. The benchmark goes to the tasks whole
if its texts are under BLOCK_BYTES; a larger one goes in blocks of that size, one after another over the same rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Prefix, by_bytes, keyed, mix, numbered, packed, spread, word_bounds, word_hashes

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Words that one lane of the search goes through.
LANE = 256
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """The words, lower-cased, with one space between."""
    return b" ".join(text.translate(_FOLD).split())


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts: bytes, starts and ends of words, their hashes, first word of each text (and the total)."""
    data, at = packed(texts)
    starts, ends = word_bounds(data)
    return data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, at)


def pairs(hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the block of two words that ends with each of the given words."""
    with np.errstate(over="ignore"):
        return mix(hashes[end - 1] * U64(0x9FB21C651E98DF25) + hashes[end])


class Patterns:
    """Shift table and suffix buckets for patterns of m words."""

    def __init__(self, m: int, texts: list[bytes], owners: list[list[int]]):
        self.m, self.texts, self.owners = m, texts, owners
        _, _, _, words, first = hashed(texts)
        assert (np.diff(first) == m).all()
        self.block = min(2, m)
        self.hash = Prefix(words).span(first[:-1], first[1:])
        self.shift = np.full(1 << 16, m - self.block + 1, np.int64)
        for j in range(self.block, m + 1):
            np.minimum.at(self.shift, (self.blocks(words, first[:-1] + j - 1) >> U64(48)).astype(np.int64), m - j)
        suffix = self.blocks(words, first[1:] - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, self.bucket = np.unique(suffix[self.order], return_index=True)
        self.bucket = np.append(self.bucket, len(suffix))

    def blocks(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        return pairs(words, end) if self.block == 2 else mix(words[end])

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Word places at which a pattern may end; LANE words a lane, all lanes move at once."""
        at = np.arange(0, len(words), LANE)
        stop = np.minimum(at + LANE, len(words))
        at[:1] = self.m - 1
        found = []
        at, stop = at[at < stop], stop[at < stop]
        while len(at):
            step = self.shift[(self.blocks(words, at) >> U64(48)).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate([*found, np.zeros(0, np.int64)])

    def search(self, data, starts, ends, words, prefix, text_of) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences, and the pattern of each."""
        last = self.candidates(words)
        last = last[last >= self.m - 1]
        last = last[text_of[last] == text_of[last - self.m + 1]]
        key = self.blocks(words, last)
        slot = np.minimum(np.searchsorted(self.suffix, key), len(self.suffix) - 1)
        known = self.suffix[slot] == key
        last, slot = last[known], slot[known]
        sizes = self.bucket[slot + 1] - self.bucket[slot]
        pattern = self.order[spread(self.bucket[slot], sizes)]
        first = np.repeat(last - self.m + 1, sizes)
        same = prefix.span(first, first + self.m) == self.hash[pattern]
        first, pattern = first[same], pattern[same]
        raw = data.data
        exact = [raw[s:e] == self.texts[p] for s, e, p in zip(starts[first].tolist(), ends[first + self.m - 1].tolist(), pattern.tolist(), strict=True)]
        exact = np.array(exact, bool)
        return first[exact], pattern[exact]


class Searcher:
    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.ids = [None if i is None else str(i) for i, _ in items]
        owners: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for k, (_, text) in enumerate(items):
            words = folded(text).split()
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                owners[m].setdefault(b" ".join(words[i : i + m]), []).append(k)
        self.sets = [Patterns(m, list(x), list(x.values())) for m, x in sorted(owners.items())]

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: words, spans of words that lie in occurrences (merged), ids of items that occur."""
        data, starts, ends, words, first = hashed([folded(x) for x in texts])
        counts = np.diff(first)
        text_of = np.repeat(np.arange(len(texts)), counts)
        prefix = Prefix(words)
        change, items = np.zeros(len(words) + 1, np.int64), [set() for _ in texts]
        for p in self.sets:
            at, pattern = p.search(data, starts, ends, words, prefix, text_of)
            np.add.at(change, at, 1)
            np.add.at(change, at + p.m, -1)
            for t, k in {*zip(text_of[at].tolist(), pattern.tolist(), strict=True)}:
                items[t].update(self.ids[i] for i in p.owners[k] if self.ids[i] is not None)
        hit = np.cumsum(change)[:-1] > 0
        edge = np.diff(np.concatenate([[0], hit.view(np.int8)]))
        begin = np.flatnonzero((edge == 1) | (hit & np.isin(np.arange(len(hit)), first[:-1])))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        over = np.flatnonzero(np.concatenate([~hit, [True]]))
        stop = over[np.searchsorted(over, begin)] if len(begin) else begin
        for b, e, t in zip(begin.tolist(), stop.tolist(), text_of[begin].tolist(), strict=True):
            spans[t].append((b - int(first[t]), min(e, int(first[t + 1])) - int(first[t])))
        return [(int(n), s, sorted(i)) for n, s, i in zip(counts, spans, items, strict=True)]


RESULT = "id long, k1 long, k2 long, n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def summed(spans: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Words covered by spans that may overlap, and the spans merged."""
    merged: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return sum(e - s for s, e in merged), merged


def rows(batch: pa.RecordBatch, results: list, carried: list[str]) -> pa.RecordBatch:
    covered = [summed(s) for _, s, _ in results]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in carried), pa.array([n for n, _, _ in results], pa.int64()), pa.array([n for n, _ in covered], pa.int64()), pa.array([[{"first": a, "last": b} for a, b in s] for _, s in covered], _SPANS), pa.array([i for _, _, i in results], pa.list_(pa.string()))],
        names=[*carried, "n_words", "n_hit", "spans", "items"],
    )


def searchers(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of the benchmark's items, each about block_bytes at most; blocks are drawn by a hash of id and text, so equal texts are spread too."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    sc = docs.sparkSession.sparkContext
    part = lambda b: items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
    return [sc.broadcast([(r[0], r[1].encode()) for r in part(b).collect()]) for b in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of documents: id, k1, k2 (key of the text), n_words, n_hit, spans of hit words, items that occur. Blocks follow each other over the same rows; nothing is shuffled."""
    found, carried = keyed(docs), ["id", "text", "k1", "k2"]
    parts = searchers(docs, benchmark, window, block_bytes)
    for b, shared in enumerate(parts):

        def work(batches, shared=shared, first=b == 0, kept=[c for c in carried if c != "text" or b + 1 < len(parts)]):  # noqa: B006
            searcher = Searcher(shared.value, window)
            for batch, texts in by_bytes(batches):
                results = searcher.scan(texts)
                if not first:
                    before = zip(*(batch.column(c).to_pylist() for c in ("spans", "items")), strict=True)
                    results = [(n, [*((x["first"], x["last"]) for x in s), *more], sorted({*i, *others})) for (n, more, others), (s, i) in zip(results, before, strict=True)]
                yield rows(batch, results, kept)

        found = found.mapInArrow(work, RESULT if b + 1 == len(parts) else RESULT.replace("id long", "id long, text string", 1))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those that hold a benchmark window; columns unchanged. Dropped where they are scanned, without a shuffle."""
    found, names = numbered(docs.withColumn("text", F.col("text").cast("string")))
    schema, text = found.schema, names["text"]
    for shared in searchers(docs, benchmark, window, block_bytes):

        def work(batches, shared=shared):
            searcher = Searcher(shared.value, window)
            for batch, texts in by_bytes(batches, text):
                yield batch.filter(pa.array([not spans for _, spans, _ in searcher.scan(texts)], pa.bool_()))

        found = found.mapInArrow(work, schema)
    return found.toDF(*docs.columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
