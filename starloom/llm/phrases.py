"""Phrase collocations by generalised suffix automata: phrases whose words meet far more often than by chance.

A shard is some megabytes of text. The states of its automaton over words (all pieces of all its
documents, each language for itself) are the classes of substrings that end at the same places. They
are built from the tree of their suffix links, level by level: a node at depth L is a substring of L
words, its parent the same without its first word, and its count the number of places where it ends;
a chain of nodes with one count is one state. As phrases are short the tree is cut at their depth,
so a shard takes a few sorts of integers, and a state gives all its substrings by its two lengths.

Spark adds the counts up over the shards. Only what may be frequent is handed on: of longer phrases
those made of frequent words, then of frequent pairs (a phrase is never more frequent than its parts). What is
frequent goes to the shards as a filter of bits of a bounded size; it lets too much through, never too little, and the
exact counts over all shards decide. Beyond FILTER_BYTES it grows no more, and only the traffic does.

Links also find what is part of something longer: without its first word (suffix link) or its last
(the link of the mirrored automaton) a phrase gives those it may make superfluous; if any longer phrase does so, one
by one word longer does, because counts only fall along a chain. All joins are by phrase; nothing is
collected but the bits, and a language's list is cut down per task before it comes together.

Defined cases: a null text is empty, a null language `und`; A-Z count as a-z; rows that repeat count
each time; ties go as the contract says; an empty table, or one in which nothing is frequent, gives
no row; texts go whole, a longer one than SHARD_BYTES is a shard of its own; further columns are ignored,
whatever they are called. Words are told apart by their bytes, never by a hash alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, by_bytes, discard, mix, packed, same_words, spread, trim, word_bounds, word_hashes, written

SHARD_BYTES = 3 << 20
FILTER_BYTES = 16 << 20
#: Bits an entry and probes of the filter, and phrases in a batch that a shard gives.
BITS, PROBES, BATCH = 16, 3, 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True


class Words:
    """The words of some texts in their order, with ids that are equal for equal words of a language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        plain, at = packed(texts)
        self.data = LOWER[plain]
        self.starts, self.ends = word_bounds(self.data, SEPARATOR)
        self.names = sorted(set(langs))
        known = {x: i for i, x in enumerate(self.names)}
        self.lang = np.repeat(np.array([known[x] for x in langs], np.int32), np.diff(np.searchsorted(self.starts, at)))
        broken = np.zeros(len(self.starts) + 1, bool)
        broken[0] = True
        broken[np.searchsorted(self.starts, np.flatnonzero(BREAK[self.data]))] = True
        #: Whether a word follows the one before it in the same piece.
        self.follows = ~broken[:-1]
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.names] or [0], U64)
        self.hashes = mix(word_hashes(self.data, self.starts, self.ends) ^ seeds[self.lang]) if len(self.starts) else np.zeros(0, U64)
        self.ids, self.first = self._ids()

    def _ids(self) -> tuple[np.ndarray, np.ndarray]:
        _, first, ids = np.unique(self.hashes, return_index=True, return_inverse=True)
        one, length = first[ids], self.ends - self.starts
        same = (length == length[one]) & (self.lang == self.lang[one])
        i = np.flatnonzero(same)
        room = np.concatenate([self.data, np.zeros(8, np.uint8)])
        same[i] = same_words(self.data, self.starts[i], room, self.starts[one[i]], length[i])
        apart: dict[tuple[int, bytes], int] = {}
        more = []
        for k in np.flatnonzero(~same).tolist():  # words that share a hash with another one
            key = int(self.lang[k]), self.data[self.starts[k] : self.ends[k]].tobytes()
            if key not in apart:
                apart[key] = len(first) + len(more)
                more.append(k)
            ids[k] = apart[key]
        return ids, np.concatenate([first, np.array(more, first.dtype)]) if more else first

    def pairs(self) -> np.ndarray:
        """A hash of each word and the one before it (the first is of no use)."""
        with np.errstate(over="ignore"):
            return mix(np.roll(self.hashes, 1) * U64(0x9FB21C651E98DF25) + self.hashes)

    def phrases(self, ends: np.ndarray, n: int) -> pa.Array:
        """The texts of phrases of n words that end with the given words, one space between two."""
        at = (ends[:, None] + np.arange(1 - n, 1)).ravel()
        length = (self.ends - self.starts)[at].reshape(-1, n)
        length[:, :-1] += 1
        flat = length.ravel()
        text = self.data[spread(self.starts[at], flat)]
        last = np.cumsum(flat).reshape(-1, n)
        text[last[:, :-1].ravel() - 1] = 0x20
        offsets = np.concatenate([[0], last[:, -1]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(text))


@dataclass
class Automaton:
    """States up to a depth: a place where each ends, the lengths of its longest and shortest substring, and how often it ends somewhere."""

    end: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, follows: np.ndarray, depth: int) -> "Automaton":
        """ids: the words; follows: whether each goes on with what stands before it."""
        place = np.arange(len(ids))
        run = place - np.maximum.accumulate(np.where(follows, 0, place)) + 1 if len(ids) else place
        node, at, size = ids.astype(np.int64), place, int(ids.max(initial=-1)) + 1
        end = np.zeros(size, np.int64)
        end[ids] = place
        levels = [(end, np.bincount(ids, minlength=size), np.ones(size, np.int64), np.ones(size, bool))]
        for depth_now in range(2, depth + 1):
            at = at[run[at] >= depth_now]
            if not len(at):
                break
            above = node[at]
            _, first, found, count = np.unique(above * size + ids[at - depth_now + 1], return_index=True, return_inverse=True, return_counts=True)
            link = above[first]
            _, counts, shortest, closed = levels[-1]
            merged = counts[link] == count  # whatever ends where the parent ends goes on like this to the left
            closed[link[merged]] = False
            levels.append((at[first], count, np.where(merged, shortest[link], depth_now), np.ones(len(first), bool)))
            node = np.zeros(len(ids), np.int64)
            node[at] = found
        pick = lambda k: np.concatenate([x[k][x[3]] for x in levels])
        return cls(pick(0), np.concatenate([np.full(int(x[3].sum()), i + 1) for i, x in enumerate(levels)]), pick(2), pick(1))

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """A place where each substring of this length ends, and its count."""
        these = (self.shortest <= length) & (length <= self.longest)
        return self.end[these], self.count[these]


@dataclass
class Filter:
    """A set of 64-bit hashes as bits; may hold more than was put in. The number of its bits is a power of two."""

    bits: np.ndarray  # 64 in each

    @staticmethod
    def probes(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        step = (hashes >> U64(32)) | U64(1)
        with np.errstate(over="ignore"):
            return [(hashes + step * U64(k)) & U64(size - 1) for k in range(PROBES)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in self.probes(hashes, 64 * len(self.bits)):
            out &= (self.bits[p >> U64(6)] >> (p & U64(63))) & U64(1) == 1
        return out


def shards(batches, lang: str = "lang", text: str = "text"):
    """(texts, languages) of about SHARD_BYTES each."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for batch, some in by_bytes(batches, text):
        texts += some
        langs += batch.column(lang).to_pylist()
        size += sum(map(len, some))
        if size >= SHARD_BYTES:
            yield texts, langs
            texts, langs, size = [], [], 0
            trim()
    if texts:
        yield texts, langs


COUNTED = "lang string, phrase string, f long"


def counted(docs: DataFrame, lengths: range, known: Filter | None = None) -> DataFrame:
    """(lang, phrase, f) of every phrase of these lengths that `known` (of words for pairs, of pairs for longer ones) lets through, a row for each shard and phrase. With words comes a row without a phrase, the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(known.bits) if known else None

    def work(batches):
        table = Filter(shared.value) if shared else None
        for texts, langs in shards(batches):
            words = Words(texts, langs)
            if not len(words.ids):
                continue
            names = pa.array(words.names, pa.string())
            if table is None:
                total = np.bincount(words.lang, minlength=len(names))
                yield batch(names, pa.nulls(len(names), pa.string()), total)
                follows = np.zeros(len(words.ids), bool)
            elif lengths.start == 2:
                frequent = table.has(words.hashes[words.first])[words.ids]
                follows = words.follows & frequent & np.roll(frequent, 1)
            else:
                follows = words.follows.copy()
                follows[follows] = table.has(words.pairs()[follows])
            automaton = Automaton.of(words.ids, follows, lengths.stop - 1)
            for n in lengths:
                ends, count = automaton.substrings(n)
                for i in range(0, len(ends), BATCH):
                    e = ends[i : i + BATCH]
                    yield batch(names.take(pa.array(words.lang[e])), words.phrases(e, n), count[i : i + BATCH])

    def batch(lang, phrase, f):
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(f, pa.int64())], names=["lang", "phrase", "f"])

    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, COUNTED)


def summed(found: DataFrame, least: int) -> DataFrame:
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least))


def filter_of(spark: SparkSession, frequent: DataFrame, words: int) -> Filter:
    """The filter of frequent words (or of pairs, if words is 2); its bits are set by Spark and gathered, at most FILTER_BYTES of them."""
    rows = frequent.where("phrase IS NOT NULL").select("lang", "phrase")
    size = min(8 * FILTER_BYTES, 1 << max(16, (BITS * rows.count()).bit_length()))

    def work(batches):
        for batch in batches:
            found = Words([p.encode() for p in batch.column("phrase").to_pylist()], batch.column("lang").to_pylist())
            hashes = found.hashes if words == 1 else found.pairs()[1::2]
            where = np.unique(np.concatenate(Filter.probes(hashes, size)))
            yield pa.RecordBatch.from_arrays([pa.array((where >> U64(6)).astype(np.int64)), pa.array((U64(1) << (where & U64(63))).view(np.int64))], names=["place", "bit"])

    some = rows.mapInArrow(work, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bit")).toPandas()
    bits = np.zeros(size // 64, U64)
    bits[some["place"].to_numpy(np.int64)] = some["bit"].to_numpy(np.int64).view(U64)
    return Filter(bits)


def frequent_phrases(docs: DataFrame, most_words: int = 5, least: int = 100) -> list[DataFrame]:
    """Written tables (lang, phrase, f) of all phrases with f >= least: of words (and, without a phrase, the number of all words), pairs, and longer ones."""
    spark = docs.sparkSession
    words = written(summed(counted(docs, range(1, 2)), least))
    pairs = written(summed(counted(docs, range(2, 3), filter_of(spark, words, 1)), least))
    if most_words < 3:
        return [words, pairs]
    return [words, pairs, written(summed(counted(docs, range(3, most_words + 1), filter_of(spark, pairs, 2)), least))]


def whole(c) -> "F.Column":
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, most_words: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    A phrase of 2 to most_words words with a >= least occurrences has the score of its worst cut into two,
    floor(1000 * a * n / (l * r)); it goes if a longer one has at least `percent` of its occurrences.
    """
    tables = frequent_phrases(docs, most_words, least)
    words, longer = tables[0], tables[1:]
    totals = words.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    candidates = longer[0]
    for t in longer[1:]:
        candidates = candidates.unionByName(t)
    parts = words.where("phrase IS NOT NULL").unionByName(candidates)
    word = F.split("phrase", " ")
    size = F.size(word)
    # what a phrase without its first or its last word is makes superfluous
    linked = F.when(size > 2, F.array(F.array_join(F.slice(word, 2, size - 1), " "), F.array_join(F.slice(word, 1, size - 1), " ")))
    above = candidates.select("lang", F.explode(linked).alias("phrase"), F.col("f").alias("more")).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = candidates.join(above, ["lang", "phrase"], "left").where(F.coalesce(100 * whole(F.col("more")) < percent * whole(F.col("f")), F.lit(True))).select("lang", "phrase", F.col("f").alias("a"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("*", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(word, F.col("k") + 1, size - F.col("k")), " ").alias("rest"))
    part = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", F.expr("CAST(1000 * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    done = written(out)  # what has been counted can go now
    discard(*(t for t in tables if hasattr(t, "scratch")))
    return done
