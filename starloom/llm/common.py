"""Helpers that the text operators share: packed texts, word bounds, hashes, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, shared_dir, written  # noqa: F401

U64 = np.uint64
#: Bytes of text that one numpy step works on; arrays of 8 bytes a byte follow from it.
CHUNK_BYTES = 1 << 21


def release(spark: SparkSession) -> None:
    """Lets the driver's collector find shuffles that nothing refers to any more, so that their files go now and not at its next turn."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: str | Column = "text") -> tuple[Column, Column]:
    """128 bits of a text: two hashes of different seeds (the number comes first, so the second is no function of the first)."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, k1, k2): the two columns that count, and a 128-bit key of the whole text."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
    ).select("id", "text", *(k.alias(c) for k, c in zip(text_key(), ("k1", "k2"), strict=True)))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns named by their places, and the new name of each; for batches whose columns may be called anything."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def splits(df: DataFrame, bytes_col: str, target: int = 12 << 20, least: int = 12) -> int:
    """How many partitions give each about `target` bytes of the column; one cheap pass over it."""
    total = df.agg(F.sum(F.octet_length(bytes_col).cast("long"))).first()[0] or 0
    return max(least, -(-total // target))


def held_out() -> "F.Column":
    """crc32 of the id's text modulo 3 is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and extended by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64) if have is None else have
        with np.errstate(over="ignore"):
            while len(have) < n:
                have = np.concatenate([have, have * (have[-1] * U64(base))])
        _POWERS[base] = have
    return have[:n]


class Prefix:
    """Prefix polynomial hashes of a sequence of 64-bit symbols; any span's hash in O(1)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(symbols * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> "Prefix":
        return cls(_BYTE[data])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed: equal for equal spans, whatever their place."""
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def fixed(self, k: int) -> np.ndarray:
        """Of every span of k symbols, in order."""
        n = max(0, len(self.sums) - k)
        with np.errstate(over="ignore"):
            return (self.sums[k : k + n] - self.sums[:n]) * self.inverse[:n]


def span_names(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of spans of symbols, from two polynomial hashes. The second is over mixed symbols, so what two symbols differ by in the first says nothing of it, and no order of them (Thue and Morse's, say) makes both vanish."""
    out = mix(Prefix(symbols).span(start, end))
    with np.errstate(over="ignore"):
        return mix(out * U64(0x9FB21C651E98DF25) + mix(Prefix(mix(symbols ^ U64(0x5851F42D4C957F2D))).span(start, end)))


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Strings as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(lengths: list[int], limit: int = 0):
    """Ranges (from, to) of items whose lengths sum to about `limit`; one item at least."""
    limit = limit or CHUNK_BYTES
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a newline after each, and the place where each begins (one more at the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that are not in `space`; data ends with one that is."""
    edge = space[data]
    change = np.flatnonzero(np.diff(edge.view(np.int8), prepend=1))
    return change[0::2], change[1::2]


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Longer words are hashed and compared one at a time.
LONG_WORD = 64


def octets(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words. Words of up to eight bytes and one length never collide. Longer ones, eight bytes at a time, go through two states that take the bytes in differently, so no half of a word can be chosen to make up for the other."""
    length, eight = ends - starts, octets(data)
    out = mix(mix(length.astype(U64)) ^ (eight[starts] & _FIRST[np.minimum(length, 8)]))
    more = np.flatnonzero((length > 8) & (length <= LONG_WORD))
    if len(more):
        on, k = np.arange(len(more)), 8
        one, two = out[more], mix(eight[starts[more]] * U64(0xC2B2AE3D27D4EB4F) + length[more].astype(U64))
        with np.errstate(over="ignore"):
            while len(on):
                at = more[on]
                block = eight[starts[at] + k] & _FIRST[np.minimum(length[at] - k, 8)]
                one[on] = mix(one[on] * U64(0x9FB21C651E98DF25) ^ block)
                two[on] = mix((two[on] ^ (two[on] >> U64(29))) + block * U64(0x9E3779B97F4A7C15))
                k += 8
                on = on[length[more[on]] > k]
            out[more] = mix(one + mix(two) * U64(0x165667B19E3779F9))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(length[i]))
    return out


def same_words(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Byte by byte: whether each word of `data` is the one of the same length in `other`, which has room for eight bytes more."""
    same, x, y = np.ones(len(starts), bool), octets(data), np.ndarray((len(other) - 7,), "<u8", other, strides=(1,))
    on, k = np.arange(len(starts)), 0
    while len(on) and k < LONG_WORD:
        same[on] &= (x[starts[on] + k] ^ y[others[on] + k]) & _FIRST[np.minimum(length[on] - k, 8)] == 0
        k += 8
        on = on[length[on] > k]
    for i in on.tolist():
        same[i] = np.array_equal(data[starts[i] : starts[i] + length[i]], other[others[i] : others[i] + length[i]])
    return same


def trim() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it likes
            ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches, text: str = "text"):
    """Record batches cut so that each holds about CHUNK_BYTES of text, with the texts as bytes. What the worker has used goes back to the system at the end."""
    for batch in batches:
        texts = binaries(batch.column(text))
        for i, j in chunks([len(x) for x in texts]):
            yield batch.slice(i, j - i), texts[i:j]
    batch = texts = None
    trim()


class Growing:
    """An array that is only added to; its room doubles."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more) + 8
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(2 * need - self.size, self.room.dtype)])
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class WordTable:
    """Ids of distinct words, found by 64-bit hashes and confirmed by the words' bytes; `encode` gives packed 32-bit ids for a list of words.

    Bounded: when it would hold more than `most` words or `most_bytes` of them it starts anew, so only
    speed depends on it. A word whose hash is that of another is kept apart, by its bytes.
    """

    def __init__(self, encode, most: int = 1_500_000, most_bytes: int = 48 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.row = np.zeros(0, U64), np.zeros(0, np.int32)  # sorted; the place of each key's word in what follows
        self.start, self.count, self.text_at, self.text_size = Growing(np.int64), Growing(np.int32), Growing(np.int64), Growing(np.int64)
        self.packed, self.text = Growing(np.uint32), Growing(np.uint8)
        self.apart: dict[bytes, tuple[int, int]] = {}

    @property
    def ids(self) -> np.ndarray:
        return self.packed.values

    def append(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes and keeps the ids: where each word's start, and how many."""
        found = self.encode(words)
        count = np.fromiter(map(len, found), np.int32, len(found)) // 4
        start = self.packed.size + np.cumsum(count, dtype=np.int64) - count
        self.packed.extend(np.frombuffer(b"".join(found), np.uint32))
        return start, count

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """keys: sorted, none of them known."""
        start, count = self.append(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        text_at = self.text.size + np.cumsum(size) - size
        row = np.arange(self.start.size, self.start.size + len(words), dtype=np.int32)
        self.text.extend(np.frombuffer(b"".join(words), np.uint8))
        for column, values in ((self.start, start), (self.count, count), (self.text_at, text_at), (self.text_size, size)):
            column.extend(values)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, at, keys), np.insert(self.row, at, row)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word start in `ids`, and how many they are."""
        hashes = word_hashes(data, starts, ends)
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        unique, first = ranked[fresh], order[fresh]
        raw = data.tobytes()
        words = lambda which: [raw[s:e] for s, e in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        if self.text.size > self.most_bytes or len(self.apart) > self.most:
            self.clear()
        for again in (False, True):
            at = np.searchsorted(self.keys, unique)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == unique[known]
            new = np.flatnonzero(~known)
            if not len(new):
                break
            if len(self.keys) + len(new) > self.most and not again:
                self.clear()
                new = np.arange(len(unique))
            self.learn(unique[new], words(first[new]))
        slot = np.empty(len(hashes), np.int64)
        slot[order] = self.row[at][np.cumsum(fresh) - 1]
        start, count = self.start.room[slot], self.count.room[slot]
        length = ends - starts
        same = self.text_size.room[slot] == length
        i = np.flatnonzero(same)
        same[i] = same_words(data, starts[i], self.text.room, self.text_at.room[slot[i]], length[i])
        if not same.all():
            other = np.flatnonzero(~same)
            alone = words(other)
            new = list({w for w in alone if w not in self.apart})
            self.apart.update(zip(new, zip(*self.append(new), strict=True), strict=True))
            start[other], count[other] = zip(*(self.apart[w] for w in alone), strict=True)
        return start, count

    def flat(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The ids of all words, one after another."""
        return self.ids[spread(start, count)]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    count = count.astype(np.int64)
    out = np.repeat(start - (np.cumsum(count) - count), count)
    out += np.arange(len(out))
    return out


def per_item(values: np.ndarray, item_at: np.ndarray) -> np.ndarray:
    """Sums of values over the consecutive ranges that begin at item_at (which ends with the total length)."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[item_at])
