"""Removal of byte strings that a document with a smaller id has, by a hash-compared suffix sort.

Texts are UTF-8 bytes. Three steps narrow down what has to be sorted, none of them loses a match:

1. Content-defined chunks, each with the next width-1 bytes: equal to one in a document with a
   smaller id, all windows that start in it are repeated. The smallest id that has a window keeps
   it outside such chunks, so what is decided here can be left out below.
2. The anchor of a window is the least of its GRAM-byte strings (by hash, leftmost of equals).
   Equal windows have equal anchors, so only those that stand in two documents go on; anchors are
   exchanged as sorted arrays, one for each group of documents and bucket.
3. Runs of windows with a shared anchor meet at the anchor's bucket. There their suffixes are
   sorted: a merge sort whose comparisons find the longest common extension by binary search over
   prefix polynomial hashes. Neighbours that agree over `width` bytes are compared byte by byte, and
   the smallest id of each class of equal suffixes keeps its copy. Runs of an anchor that is too
   frequent for one bucket are cut into pieces, windows whose anchor stands at like offsets, and
   each piece goes to the bucket of the bytes that all its windows share: equal windows still meet,
   and all go through the sort. Only anchors beyond VERY_HOT runs, whose pieces are single windows,
   are settled by aggregation and a join that Spark splits.

Within a group of documents runs of equal bytes are told apart at once: only that of the smallest
id goes on, the others are repeated as a whole.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than a window lose
none; equal texts keep only that of the smallest id (if it has a window); rows that repeat id and text are
treated alike; a null id is later than all others; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Prefix, binaries, chunks, mix, packed, release, spread, written
from .repeats import buckets, covered, first_and_last, prepared

WIDTH, GRAM = 50, 24
CHUNK_BITS, CHUNK_GRAM = 9, 32
GROUPS = 4
#: An anchor with more runs does not meet in one bucket, and one with so many times more is not sorted.
HOT, VERY_HOT = 2000, 64
#: Offsets of the anchor in a window that one piece of a frequent run covers.
PIECE = 7
CHUNK = "a long, b long, __id long, __k long, __g int, first int, n int"
SPAN = "__g int, __k long, first int, last int"


def chunk_rows(table: DataFrame, width: int) -> DataFrame:
    """Content-defined chunks that have windows: 128-bit key of the chunk and the width-1 bytes behind it."""

    def work(batches):
        for batch in batches:
            texts = binaries(batch.column("text"))
            for i, j in chunks([len(x) for x in texts]):
                a, b, owner, first, n = [], [], [], [], []
                data, at = packed(texts[i:j])
                ends = np.flatnonzero(mix(Prefix.of_bytes(data).fixed(CHUNK_GRAM)) >> U64(64 - CHUNK_BITS) == 0) + CHUNK_GRAM
                for t in range(i, j):
                    raw, base = texts[t], int(at[t - i])
                    if len(raw) < width:
                        continue
                    lo, hi = np.searchsorted(ends, [base + CHUNK_GRAM, base + len(raw) - width + 1])
                    edges = [0, *(ends[lo:hi] - base).tolist(), len(raw) - width + 1]
                    for s, e in zip(edges[:-1], edges[1:], strict=True):
                        if e > s:
                            name = xxhash.xxh3_128_intdigest(raw[s : e + width - 1])
                            a.append(name >> 64)
                            b.append(name & 0xFFFFFFFFFFFFFFFF)
                            owner.append(t)
                            first.append(s)
                            n.append(e - s)
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, U64).view(np.int64)), pa.array(np.array(b, U64).view(np.int64)), *(batch.column(c).take(take) for c in ("__id", "__k", "__g")), pa.array(first, pa.int32()), pa.array(n, pa.int32())], names=["a", "b", "__id", "__k", "__g", "first", "n"])

    return table.select("__id", "__k", "__g", "text").mapInArrow(work, CHUNK)


def decided_chunks(table: DataFrame, width: int) -> DataFrame:
    rows = written(chunk_rows(table, width))
    least = rows.groupBy("a", "b").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most").drop("most")
    return written(rows.join(least, ["a", "b"]).where("__id > least").select("__g", "__k", "first", (F.col("first") + F.col("n") - 1).alias("last")))


class Group:
    """The texts of a group of documents and, for each window that is not decided, its anchor."""

    def __init__(self, table: pa.Table, decided: pa.Table, width: int):
        self.ids, self.keys = table.column("__id").to_numpy(), table.column("__k").to_numpy()
        self.texts = binaries(table.column("text").combine_chunks())
        spans: dict[int, list[tuple[int, int]]] = {}
        for k, a, b in zip(*(decided.column(c).to_pylist() for c in ("__k", "first", "last")), strict=True):
            spans.setdefault(k, []).append((a, b))
        self.parts = []
        for i, j in chunks([len(x) for x in self.texts]):
            data, at = packed(self.texts[i:j])
            size = np.diff(at) - 1
            count = np.maximum(0, size - width + 1)
            open_ = np.ones(int(count.sum()), bool)
            begin = np.cumsum(count) - count
            for t in range(i, j):
                for a, b in spans.get(int(self.keys[t]), ()):
                    open_[begin[t - i] + a : begin[t - i] + b + 1] = False
            grams = mix(Prefix.of_bytes(data).fixed(GRAM))
            ranked = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
            span, least = width - GRAM + 1, ranked
            step = 1
            while 2 * step <= span:
                least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
                step *= 2
            if span > step:
                least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
            start = spread(at[:-1], count)[open_]
            owner = np.repeat(np.arange(i, j), count)[open_]
            anchor = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])
            run = np.flatnonzero(new)
            self.parts.append((data, at, i, grams[anchor[run]], owner[run], start[run], np.diff(np.append(run, len(start))), anchor[run]))


def anchor_arrays(table: DataFrame, decided: DataFrame, parts: int, width: int) -> DataFrame:
    """For each group and bucket: its distinct anchors, sorted, and which of them more than one of its documents has."""

    def work(left, right):
        g = Group(left, right, width)
        key = np.concatenate([np.zeros(0, U64), *(p[3] for p in g.parts)])
        doc = g.ids[np.concatenate([np.zeros(0, np.int64), *(p[4] for p in g.parts)])]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        several = (np.minimum(np.diff(np.append(at, len(key))), 0x7FFF) | (several.astype(np.int64) << 15)).astype(np.uint16)  # runs, and whether in several documents
        key = key[at]
        bucket = (key % U64(parts)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, key, several = bucket[order], key[order], several[order]
        edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        return pa.table({
            "bucket": pa.array(bucket[edge[:-1]]),
            "g": pa.array(np.full(len(edge) - 1, left.column("__g")[0].as_py() if left.num_rows else 0, np.int32)),
            "keys": pa.array([key[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            "several": pa.array([several[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
        })

    return grouped(table, decided).applyInArrow(work, "bucket int, g int, keys binary, several binary")


def grouped(table: DataFrame, other: DataFrame):
    return table.select("__g", "__id", "__k", "text", "__copy").groupBy("__g").cogroup(other.groupBy("__g"))


def shared_anchors(hot: int):
    """Of one bucket: for each group, its anchors that another document has too, and how frequent those are: 0, 1 above `hot` runs, 2 far above."""

    def work(key, table):
        keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
        every = np.concatenate(keys)
        tally = np.frombuffer(b"".join(table.column("several").to_pylist()), np.uint16)
        order = np.argsort(every, kind="stable")
        ranked, runs, several = every[order], (tally[order] & 0x7FFF).astype(np.int64), tally[order] >> 15
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(every) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(every)))
        shared, often = np.zeros(len(every), bool), np.zeros(len(every), np.uint8)
        if len(at):
            shared[order] = np.repeat((size > 1) | (np.maximum.reduceat(several, at) > 0), size)
            total = np.add.reduceat(runs, at)
            often[order] = np.repeat((total > hot).astype(np.uint8) + (total > VERY_HOT * hot), size)
        ends = np.cumsum([len(x) for x in keys]).tolist()
        pick = [(every[a:b][shared[a:b]].tobytes(), often[a:b][shared[a:b]].tobytes()) for a, b in zip([0, *ends], ends, strict=False)]
        return pa.table({"__g": table.column("g"), "keys": pa.array([x for x, _ in pick], pa.binary()), "often": pa.array([x for _, x in pick], pa.binary())})

    return lambda key, table: work(key, table)


RUN = "bucket int, key long, level byte, __id long, __k long, __g int, first int, n int, bytes binary"


def smallest(ids: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Which of the runs no run of the same bytes and a smaller id is among."""
    least: dict[bytes, int] = {}
    for i, x in zip(ids.tolist(), contents, strict=True):
        if i < least.get(x, 1 << 63):
            least[x] = i
    return np.fromiter((least[x] == i for i, x in zip(ids.tolist(), contents, strict=True)), bool, len(contents))


def pieces(start: int, n: int, anchor: int, step: int, width: int):
    """Cuts the run of n windows from `start` where the anchor's offset in the window is a multiple of `step`: first window, windows, range of the bytes that
    every window of such offsets has, number of the piece."""
    offset, last = anchor - start, anchor - start - n + 1
    while offset >= last:
        p = offset // step
        low = max(last, p * step)
        yield anchor - offset, offset - low + 1, (anchor - p * step, anchor - p * step - step + 1 + width), p
        offset = low - 1


def shared_runs(table: DataFrame, feed: DataFrame, slots: int, width: int) -> DataFrame:
    """Runs of open windows with a shared anchor, each with the bytes that it covers. feed: decided spans and shared anchors.

    A run whose bytes a document of the same group with a smaller id has is repeated as a whole: it
    goes on without its bytes and key, so a family of like documents sends a run once a group.
    """

    def work(left, right):
        shared, often = (np.frombuffer(b"".join(x for x in right.column(c).to_pylist() if x), t) for c, t in (("keys", U64), ("often", np.uint8)))
        order = np.argsort(shared)
        shared, often = shared[order], often[order]
        g = Group(left, right.filter(pa.compute.is_valid(right.column("__k"))), width)
        tables, contents = [], []
        for data, at, base, key, owner, start, n, anchor in g.parts:
            slot = np.minimum(np.searchsorted(shared, key), max(0, len(shared) - 1))
            on = np.flatnonzero(shared[slot] == key) if len(shared) else np.zeros(0, np.int64)
            level, raw = often[slot[on]], data.data
            cold, hot = on[level == 0], on[level > 0]
            contents += [raw[s : s + m + width - 1].tobytes() for s, m in zip(start[cold].tolist(), n[cold].tolist(), strict=True)]
            rows, places, sizes, slots_of = [], [], [], []
            for r, s, m, a, step in zip(hot.tolist(), start[hot].tolist(), n[hot].tolist(), anchor[hot].tolist(), np.where(level[level > 0] == 1, PIECE, 1).tolist(), strict=True):
                for first, count, name, seed in pieces(s, m, a, step, width):
                    rows.append(r)
                    places.append(first)
                    sizes.append(count)
                    slots_of.append(xxhash.xxh3_64_intdigest(raw[name[0] : name[1]], seed) % slots)
                    contents.append(raw[first : first + count + width - 1].tobytes())
            every = np.concatenate([cold, np.array(rows, np.int64)])
            begin = np.concatenate([start[cold], np.array(places, np.int64)])
            tables.append(pa.table({
                "bucket": pa.array(np.concatenate([(mix(key[cold]) % U64(slots)).astype(np.int32), np.array(slots_of, np.int32)])), "key": pa.array(key[every].view(np.int64)), "level": pa.array(often[slot[every]].astype(np.int8)), "__id": pa.array(g.ids[owner[every]]), "__k": pa.array(g.keys[owner[every]]),
                "__g": pa.array(np.full(len(every), left.column("__g")[0].as_py() if left.num_rows else 0, np.int32)), "first": pa.array((begin - at[owner[every] - base]).astype(np.int32)), "n": pa.array(np.concatenate([n[cold], np.array(sizes, np.int64)]).astype(np.int32)),
            }))
        if not tables:
            return pa.table({f.name: pa.array([], f.type) for f in _RUN})
        out = pa.concat_tables(tables).combine_chunks()
        whole = ~smallest(out.column("__id").to_numpy(), contents)
        out = out.set_column(1, "key", pa.compute.if_else(pa.array(whole), pa.scalar(None, pa.int64()), out.column("key")))
        return out.append_column("bytes", pa.array([None if w else x for w, x in zip(whole.tolist(), contents, strict=True)], pa.binary()))

    return grouped(table, feed).applyInArrow(work, RUN)


_RUN = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("level", pa.int8()), ("__id", pa.int64()), ("__k", pa.int64()), ("__g", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])


class SuffixSorter:
    """Sorts suffixes by their first `width` bytes; each comparison is a binary search over prefix hashes."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width, self.hash = data, width, Prefix.of_bytes(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes at a and b, at most width."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width, np.int64)
        low[self.hash.span(a, a + self.width) == self.hash.span(b, b + self.width)] = self.width
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash.span(a, a + mid) == self.hash.span(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        e = self.extension(a, b)
        inside = e < self.width
        e = np.minimum(e, self.width - 1)
        return np.where(inside, self.data[a + e] < self.data[b + e], or_equal)

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The suffixes in order. Runs come from the first eight bytes; within equal ones runs are merged by doubling."""
        head = np.zeros(len(at), U64)
        for k in range(8):
            head = (head << U64(8)) | self.data[at + k].astype(U64)
        order = np.argsort(head, kind="stable")
        at, head = at[order], head[order]
        begin = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(at)))
        some = size > 1
        begin, size = begin[some], size[some]
        step = 1
        while len(size):
            on = size > step
            begin, size = begin[on], size[on]
            if not len(size):
                break
            base, n = np.repeat(begin, size), np.repeat(size, size)
            local = spread(np.zeros(len(size), np.int64), size)
            run = local // step
            other = (run ^ 1) * step
            low = np.minimum(other, n)
            high = np.minimum(other + step, n)
            start, second = low.copy(), (run & 1).astype(bool)
            mine = at[base + local]
            active = np.flatnonzero(low < high)
            while len(active):  # rank of each suffix in the run that it is merged with
                mid = (low[active] + high[active]) >> 1
                theirs = at[base[active] + mid]
                late = second[active]
                before = np.empty(len(active), bool)
                before[late] = self.below(theirs[late], mine[active][late], True)
                before[~late] = self.below(theirs[~late], mine[active][~late], False)
                low[active] = np.where(before, mid + 1, low[active])
                high[active] = np.where(before, high[active], mid)
                active = active[low[active] < high[active]]
            pair = (run >> 1) * 2 * step
            at[base + pair + (local - run * step) + (low - start)] = mine
            step *= 2
        return at

    def equal_to_next(self, at: np.ndarray) -> np.ndarray:
        """Which sorted suffixes agree with the next one; equal hashes are compared byte by byte."""
        same = self.hash.span(at[:-1], at[:-1] + self.width) == self.hash.span(at[1:], at[1:] + self.width)
        i = np.flatnonzero(same)
        for a in range(0, len(i), 1 << 16):
            j = i[a : a + (1 << 16)]
            x = at[j, None] + np.arange(self.width)
            y = at[j + 1, None] + np.arange(self.width)
            same[j] = (self.data[x] == self.data[y]).all(axis=1)
        return same


def repeated_suffixes(width: int):
    def work(key, table):
        raw = table.column("bytes").to_pylist()
        doc, count = table.column("__id").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(x, len(place)) for x in raw], np.int64)  # equal runs are sorted once
        least_of = np.full(len(place), np.iinfo(np.int64).max)
        np.minimum.at(least_of, which, doc)
        data, begin = packed(list(place))
        n = np.diff(begin) - width
        at = spread(begin[:-1], n)
        owner = np.repeat(np.arange(len(place)), n)
        sorter = SuffixSorter(data, width)
        ranked = sorter.sort(at.copy())
        same = sorter.equal_to_next(ranked)
        inverse = np.empty(len(data), np.int64)
        inverse[at] = np.arange(len(at))
        source = inverse[ranked]
        group = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(least_of[owner[source]], group) if len(at) else at
        per_window = np.empty(len(at), np.int64)
        per_window[source] = np.repeat(least, np.diff(np.append(group, len(at))))
        first_window = np.cumsum(n) - n
        window = spread(first_window[which], count)
        rows = np.repeat(np.arange(len(raw)), count)
        flags = doc[rows] > per_window[window]
        base = np.cumsum(count) - count
        a, b = first_and_last(flags, base)
        r = rows[a]
        first = table.column("first").to_numpy()
        return pa.table({"__g": table.column("__g").combine_chunks().take(pa.array(r)), "__k": table.column("__k").combine_chunks().take(pa.array(r)), "first": pa.array((first[r] + a - base[r]).astype(np.int32)), "last": pa.array((first[r] + b - base[r]).astype(np.int32))})

    return lambda key, table: work(key, table)


def hot_suffixes(windows: DataFrame) -> DataFrame:
    """Single windows of anchors beyond all measure: partial minima, then a join that can be split (one side of it is a written table)."""
    least = written(windows.groupBy("bytes").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most").drop("most"))
    return windows.join(least, "bytes").where("__id > least").select("__g", "__k", "first", F.col("first").alias("last"))


def without_repeated_bytes(docs: DataFrame, width: int = WIDTH, hot: int = HOT, parts: int | None = None, with_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first byte, end), and with_bytes the kept bytes."""
    table, parts = prepared(docs.select("doc_id", "text"), parts, GROUPS)
    release(docs.sparkSession)
    source = table.where("not __copy")
    decided = decided_chunks(source, width)
    shared = anchor_arrays(source, decided, parts, width).groupBy("bucket").applyInArrow(shared_anchors(hot), "__g int, keys binary, often binary")
    feed = decided.unionByName(written(shared), allowMissingColumns=True)
    del shared
    release(docs.sparkSession)
    runs = written(shared_runs(source, feed, buckets(docs.sparkSession, parts), width))
    del feed
    release(docs.sparkSession)
    cold = runs.where("key is not null and level < 2").groupBy("bucket").applyInArrow(repeated_suffixes(width), SPAN)
    whole = runs.where("key is null").select("__g", "__k", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    spans = written(cold.unionByName(hot_suffixes(runs.where("key is not null and level = 2"))).unionByName(whole).unionByName(decided))

    def cut(left, right):
        found: dict[int, list[tuple[int, int]]] = {}
        for k, a, b in zip(*(right.column(c).to_pylist() for c in ("__k", "first", "last")), strict=True):
            found.setdefault(k, []).append((a, b))
        out = []
        for doc, k, copy, text in zip(left.column("doc_id").to_pylist(), left.column("__k").to_pylist(), left.column("__copy").to_pylist(), binaries(left.column("text").combine_chunks()), strict=True):
            n = len(text)
            if copy and n >= width:
                gone = [(0, n)]
            elif k in found:
                edge = np.diff(np.concatenate([[0], covered(found[k], width, n).view(np.int8), [0]]))
                gone = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
            else:
                gone = []
            ends = [0, *(b for _, b in gone)]
            kept = b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in gone), n], strict=True))
            out.append({"doc_id": doc, "n_bytes": n, "n_removed": n - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"first": a, "end": b} for a, b in gone]} | ({"kept": kept} if with_bytes else {}))
        return pa.Table.from_pylist(out, result)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), *([("kept", pa.binary())] if with_bytes else [])])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,end:long>>" + (", kept binary" if with_bytes else "")
    return table.select("__g", F.col("doc_id").cast("long").alias("doc_id"), "__k", "text", "__copy").groupBy("__g").cogroup(spans.groupBy("__g")).applyInArrow(cut, schema)
