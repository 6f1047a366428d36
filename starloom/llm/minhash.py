"""Near-duplicate documents by min-max hashing of word shingles, links confirmed on full sets.

Each permutation is evaluated once and gives two signature values, its minimum and its maximum
over the set; four values (two permutations) make a band. Equal sets are one node from the start.
Nodes that share a band meet at a pivot, links are confirmed by the sizes of intersection and
union of the whole sets, and connected components are taken over confirmed links.

A bucket's nodes are compared with its smallest node first. Buckets whose nodes that leaves apart
make families (nodes that such buckets connect). In a family every node outside the largest
component is held against all nodes, by counting shared shingles over an inverted index, in
blocks of bounded size; only links between components come out, no pairs. So no candidate is
left out, and no rows are made for pairs within a group.

With 32 bands of 4, a pair at similarity 0.85 shares no band with probability 6e-11 (5e-8 at 0.8).

Defined cases: null and empty texts, and texts without words, have an empty set and no links; a
text with fewer words than a shingle is one shingle; rows that repeat get a row each; a null id
is the smallest of nothing (its component is named by the others, or null); an empty table gives
no row; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_bytes, discard, keyed, mix, packed, spread, text_key, trim, word_bounds, word_hashes, written

PERMUTATIONS, ROWS = 64, 4
_MULTIPLY = (mix(np.arange(1, PERMUTATIONS + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(1001, PERMUTATIONS + 1001, dtype=U64)) >> U64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and where each text's begin."""
    data, at = packed([x.lower() for x in texts])
    starts, ends = word_bounds(data)
    words, first = word_hashes(data, starts, ends), np.searchsorted(starts, at)
    count = np.diff(first)
    size = np.minimum(count, k)  # words in each of a text's shingles
    shingles = np.where(count > 0, count - size + 1, 0)
    start = spread(first[:-1], shingles)
    owner = np.repeat(np.arange(len(texts)), shingles)
    length = size[owner]
    value = np.zeros(len(start), U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            on = length > j
            value[on] = mix(value[on] * U64(0x9FB21C651E98DF25) + words[start[on] + j])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def bands(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(set, band) for non-empty sets: 64-bit keys of the bands of the min-max signature."""
    low = (values >> U64(32)).astype(np.uint32)
    begin = at[:-1]
    out = np.empty((len(begin), 2 * PERMUTATIONS // ROWS), U64)
    with np.errstate(over="ignore"):
        for b in range(out.shape[1]):
            key = np.full(len(begin), b, U64)
            for p in range(b * ROWS // 2, (b + 1) * ROWS // 2):
                h = low * _MULTIPLY[p] + _ADD[p]
                for end in (np.minimum, np.maximum):
                    key = mix(key * U64(0x9FB21C651E98DF25) + end.reduceat(h, begin).astype(U64))
            out[:, b] = key
    return out


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each non-empty set."""
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), at[:-1]) + np.diff(at).astype(U64))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row: id, k1, k2, n (set size), node (key of the set, null if empty), bands."""

    def work(batches):
        for batch, texts in by_bytes(batches):
            values, at = shingle_sets(texts, k)
            n = np.diff(at)
            some = n > 0
            node, keys = np.zeros(len(n), np.int64), np.zeros((0, 1), np.int64)
            if some.any():
                begin = np.append(at[:-1][some], at[-1])
                node[some] = set_keys(values, begin).view(np.int64)
                keys = bands(values, begin).view(np.int64)
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(some * keys.shape[1], out=offsets[1:])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "k1", "k2")), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=~some), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["id", "k1", "k2", "n", "node", "bands"])

    return keyed(docs).mapInArrow(work, "id long, k1 long, k2 long, n long, node long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, shingles as packed 64-bit words) of one row for each wanted (id, k1, k2, node); shuffles texts once."""

    def work(batches):
        for batch, texts in by_bytes(batches):
            values, at = shingle_sets(texts, k)
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(at), pa.int64()), pa.array([raw[8 * s : 8 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["node", "n", "shingles"])

    w = wanted.select(F.col("id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "node")
    rows = keyed(docs).join(w.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & F.col("k1").eqNullSafe(F.col("_k1")) & F.col("k2").eqNullSafe(F.col("_k2")))
    return rows.select("node", "text").mapInArrow(work, "node long, n long, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union. One row in hand at a time; a node with many pairs is split by the skew join."""

    def work(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    sized = pairs.join(x.select("a", "na"), "a").join(y.select("b", "nb"), "b").where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).select("a", "b")
    return sized.join(x.select("a", "sa"), "a").join(y.select("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


class Union:
    """Disjoint sets of small integers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


#: Edges that one task contracts at a time.
EDGES = 1_000_000


def contracted(edges: DataFrame, most: int) -> DataFrame:
    """(u, v): stars that join what the edges join, by disjoint sets over at most so many edges at a time."""

    def work(batches):
        sets, n = Union(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                for a, b in zip(part.column("u").to_pylist(), part.column("v").to_pylist(), strict=True):
                    sets.join(a, b)
                n += part.num_rows
                if n >= most:
                    yield stars(sets)
                    sets, n = Union(), 0
        if n:
            yield stars(sets)

    def stars(sets: Union) -> pa.RecordBatch:
        found = [(x, r) for x in list(sets.up) if (r := sets.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(work, "u long, v long")


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node reachable.

    Tasks contract `most` edges each to stars. What one task holds is settled then; more goes on in
    large-star and small-star rounds, aggregations and joins on nodes, written to the shared folder.
    Star-shaped graphs, which the pivots give, settle in two or three rounds.
    """
    whole = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    tasks = max(1, -(-whole.count() // most))
    e = written(contracted(whole.coalesce(tasks), most))
    discard(whole)
    seen, settled = None, tasks == 1
    while not settled:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        last, e = e, written(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        discard(last)
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        settled, seen = mark == seen, mark
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def linked(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links that join different components. Rows: pool (only rows of one pool are compared), side (0: compared with those of side 1), node, root, shingles."""
    pool, side, node, root = (table.column(c).to_numpy() for c in ("pool", "side", "node", "root"))
    raw = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    size = np.array([len(x) for x in raw], np.int64)
    ask, have = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    keyed_by_pool = lambda i: mix(np.concatenate([raw[k] for k in i]) ^ np.repeat(mix(pool[i].view(U64)), size[i]))
    if not len(ask) or not len(have):
        return [], []
    index, owner = keyed_by_pool(have), np.repeat(np.arange(len(have)), size[have])
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    begin, tokens = np.cumsum(size[ask]) - size[ask], keyed_by_pool(ask)
    low, high = np.searchsorted(index, tokens, "left"), np.searchsorted(index, tokens, "right")
    work = np.add.reduceat(high - low, begin)
    sets, a, b, at = Union(), [], [], 0
    while at < len(ask):
        upto = at + max(1, int(np.searchsorted(np.cumsum(work[at:]), 1_000_000)))
        upto = min(upto, at + max(1, 2_000_000 // len(have)), len(ask))
        x, y = begin[at], begin[upto - 1] + size[ask[upto - 1]]
        count = high[x:y] - low[x:y]
        who = np.repeat(np.arange(upto - at), size[ask[at:upto]])
        shared = np.bincount(np.repeat(who, count) * len(have) + owner[spread(low[x:y], count)], minlength=(upto - at) * len(have))
        hit = np.flatnonzero(shared)
        i, j, n = ask[at + hit // len(have)], have[hit % len(have)], shared[hit]
        good = (100 * n >= percent * (size[i] + size[j] - n)) & (root[i] != root[j])
        for i, j in zip(i[good].tolist(), j[good].tolist(), strict=True):
            if sets.join(int(root[i]), int(root[j])):
                a.append(int(node[i]))
                b.append(int(node[j]))
        at = upto
    return a, b


#: Nodes of a family that one task compares: so many outside the largest component, with so many of all.
ASKED, HELD = 128, 384


def family_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows: key, node, root, low of buckets that hold several components. Confirmed links (a, b) between components, enough of them to join all that any link joins."""
    family = components(rows.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "family")
    members = written(rows.select("node", "root").distinct().join(family, "node"))
    sizes = members.groupBy("family", "root").count().groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("n"), (F.sum("count") - F.max("count")).alias("m"))
    placed = members.join(sizes, "family").withColumns({"asked": F.ceil(F.col("m") / ASKED).cast("int"), "held": F.ceil(F.col("n") / HELD).cast("int")})
    h = F.xxhash64("node", F.lit(17))
    ask = placed.where("root <> main").select("family", F.pmod(h, F.col("asked")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("q"), F.lit(0).alias("side"), "node", "root")
    have = placed.select("family", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("p"), F.pmod(h, F.col("held")).cast("int").alias("q"), F.lit(1).alias("side"), "node", "root")
    pooled = ask.unionByName(have).select(F.xxhash64("family", "p", "q").alias("pool"), "side", "node", "root").join(sets.select("node", "shingles"), "node")
    slots = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(key, table):
        a, b = linked(table, percent)
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pooled.withColumn("slot", F.pmod("pool", F.lit(slots))).groupBy("slot").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of documents: id, k1, k2 (key of the text), n_shingles, component_id (the smallest id of its group)."""
    rows = written(signatures(docs, k))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "k1", "k2")).alias("r"), F.min("id").alias("least_id"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", "r.id", "r.k1", "r.k2", "least_id", "bands"))
    # a bucket of one node is of no use; the count is aggregated before it is shuffled
    spread_out = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread_out.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = written(spread_out.join(shared.select("key", "low"), "key").select("key", "node", "low"))
    wanted = buckets.select("node").distinct().join(nodes.select("node", "id", "k1", "k2"), "node")
    sets = written(full_sets(docs, wanted, k))
    links = [written(confirmed(buckets.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), sets, percent))]
    roots = components(links[0])
    labelled = written(buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    apart = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("node").alias("low")).where("r0 < r1").select("key", "low")
    links.append(written(family_links(labelled.join(apart, "key"), sets, percent)))
    roots = components(reduce(DataFrame.unionByName, links))
    discard(buckets, sets, labelled, *links)
    classes = nodes.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = classes.join(named, "root").select("node", "component_id")
    return rows.select("id", "k1", "k2", "n", "node").join(found, "node", "left").select("id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


#: Up to so many rows of three numbers the rows to drop go to where the texts are; above it texts move.
FEW_GONE = 300_000


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose group has a smaller id; of rows that repeat an id and a text all stay. Columns unchanged."""
    gone = written(near_duplicates(docs, k, percent).where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct())
    few = gone.count() <= FEW_GONE
    a, b = text_key(docs["text"])
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (a == gone["__k1"]) & (b == gone["__k2"])
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), same, "left_anti")
