"""Exact top-k search by BM25: an inverted index in shards, block-max WAND in each, exact merges.

Terms are words as the decontamination operator folds them (A-Z lower-cased; digits, letters and
what is not ASCII). A query counts each distinct term once. score = sum of idf * tf * (K1 + 1) /
(tf + K1 * (1 - B + B * length / mean length)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with N,
df and mean length of the whole table in every shard, so scores of different shards compare.

A shard keeps, for each term, its postings in document order, documents being ordered so that
like ones are neighbours, the greatest impact of the term and that in each block of BLOCK documents.
A query comes with the score that a result has to reach. Queries are answered many at a time, those
of like length together. One whose terms' maxima stay below its score leaves the shard alone. In the
others the postings of rare terms are added up; with them and the block maxima of the frequent terms
(a matrix product, queries times blocks) a block gets a bound, and where it stays below the score the
block is skipped. In the rest the frequent terms are added by a second product, queries times documents,
for all queries that need one of a few neighbouring blocks. How many terms are frequent is chosen
by what both ways cost. Where there is no score to reach yet, the most promising blocks give one. These
sums are of 24 bits, so what reaches the score within their error is scored again from the document's terms.

Shards are asked in rounds, a few first, then four times as many each time. After a round each
query's k-th best score so far is handed to the next one, where a shard gives only documents that
reach it, and the shards of a task hand it on to each other. So the rows that come out grow with the
number of queries and the number of rounds (a logarithm), not with queries times shards.

Ties: of scores that agree to nine digits the smaller doc_id first, null ids last. Documents without any query term are no results.
Defined cases: null and empty texts have no terms, as documents and as queries; rows that repeat
are results of their own; an empty table gives no row; further columns are ignored.

Bounds: queries go to the tasks in blocks of QUERY_BYTES of terms, one pass over the index each; a
block is all that the driver holds, and its broadcast is dropped behind it. A shard holds about SHARD_BYTES of text
and SHARD_DOCS documents at most. Queries times documents grow with the square of the input by nature; a pair costs
some tens of nanoseconds where its block is looked into, and little else.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, binaries, chunks, mix, spread, trim, written
from .decontaminate import folded, hashed

K1, B = 1.2, 0.75
BLOCK = 64
SHARD_BYTES, SHARD_DOCS, QUERY_BYTES = 24 << 20, 1 << 16, 64 << 20
#: Frequent terms by which documents are ordered.
GUIDES = 64
#: Bounds are compared with so much room for rounding.
SLACK = 1 - 1e-9
#: Scores that agree to so many digits are ties.
DIGITS, TIE = 9, 1e-9
#: Terms of a shard that at least one document in LEAST_SHARE has may be rows of a matrix, and how many of them; cells of it that cost as much as one posting.
LEAST_SHARE, FREQUENT, FREQUENT_BYTES, PRODUCT = 100, 1024, 32 << 20, 1000
#: Queries answered together, and bytes of their scores; postings added up in one step; blocks scored together.
BATCH, BATCH_BYTES, CHUNK, GROUP = 512, 8 << 20, 1 << 16, 8
#: Bytes of shard files that a task takes, about one shard.
TASK_BYTES = 16 << 20
#: Shards of the first round, at least.
FIRST_SHARDS = 3

INDEX = "shard long, level int, docs binary, lengths binary, terms binary, counts binary, postings binary, tfs binary"
_INDEX = pa.schema([("shard", pa.int64()), ("level", pa.int32()), *((c, pa.binary()) for c in ("docs", "lengths", "terms", "counts", "postings", "tfs"))])


def short(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n, of 16 bits where that will do; they are sorted in linear time."""
    return x.astype(np.uint16) if n <= 1 << 16 else x


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, tf) of all texts, by text then term, and each text's number of words."""
    terms, owners, tfs, lengths = [], [], [], []
    for i, j in chunks([len(x) for x in texts]):
        _, _, _, words, first = hashed([folded(x) for x in texts[i:j]])
        owner = np.repeat(np.arange(i, j), np.diff(first))
        order = np.argsort(words)
        order = order[np.argsort(short(owner[order] - i, j - i), kind="stable")]
        w, o = words[order], owner[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        terms.append(w[at])
        owners.append(o[at])
        tfs.append(np.diff(np.append(at, len(w))))
        lengths.append(np.diff(first))
    join = lambda x, t: np.concatenate([*x, np.zeros(0, t)]).astype(t)
    return join(terms, U64), join(owners, np.int64), join(tfs, np.int64), join(lengths, np.int64)


def level_of(shard: int) -> int:
    """Every fourth shard, by a hash, is of level 1 or more, every fourth of these of level 2 or more, and so on."""
    h = int(mix(np.array([shard], U64))[0])
    return next((k for k in range(16) if h >> (2 * k) & 3), 16)


def shard_row(shard: int, ids: list[int | None], texts: list[bytes]) -> dict:
    """One shard's index as packed arrays."""
    term, owner, tf, length = term_counts(texts)
    vocabulary, inverse, df = np.unique(term, return_inverse=True, return_counts=True)
    guides = np.argsort(-df, kind="stable")[:GUIDES]
    rank = np.full(len(vocabulary), GUIDES)
    rank[guides] = np.arange(len(guides))
    # a document's guide is the one it has most often
    on = np.flatnonzero(rank[inverse] < GUIDES)
    best = np.full(len(texts), GUIDES, np.int64)
    order = np.lexsort((rank[inverse[on]], -tf[on], owner[on]))
    o = owner[on][order]
    head = np.ones(len(o), bool)
    head[1:] = o[1:] != o[:-1]
    best[o[head]] = rank[inverse[on]][order][head]
    placed = np.lexsort((length, best))
    place = np.empty(len(texts), np.int64)
    place[placed] = np.arange(len(texts))
    order = np.argsort(inverse * len(texts) + place[owner])
    missing = np.iinfo(np.int64).max
    return {
        "shard": shard, "level": level_of(shard), "docs": np.array([missing if i is None else i for i in ids], np.int64)[placed].tobytes(), "lengths": length[placed].astype(np.int32).tobytes(), "terms": vocabulary.tobytes(),
        "counts": df.astype(np.int32).tobytes(), "postings": place[owner[order]].astype(np.int32).tobytes(), "tfs": np.minimum(tf[order], 0xFFFFFFFF).astype(np.uint32).tobytes(),
    }


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index, one row a shard; documents are indexed where they are read, without a shuffle."""

    def work(batches):
        ids, texts, size, shard = [], [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text")), strict=True):
                if texts and (size + len(x) > shard_bytes or len(texts) == SHARD_DOCS):
                    yield pa.RecordBatch.from_pylist([shard_row(shard, ids, texts)], _INDEX)
                    ids, texts, size, shard = [], [], 0, shard + 1
                ids.append(i)
                texts.append(x)
                size += len(x)
        if texts:
            yield pa.RecordBatch.from_pylist([shard_row(shard, ids, texts)], _INDEX)
        ids = texts = None
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, INDEX)


def document_frequencies(shards: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def work(batches):
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(counts, np.int32).astype(np.int64))], names=["term", "n"])

    return shards.select("terms", "counts").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each distinct term once."""

    def work(batches):
        for batch in batches:
            term, owner, _, _ = term_counts(binaries(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(owner)), pa.array(term.view(np.int64))], names=["query_id", "term"])

    return queries.mapInArrow(work, "query_id long, term long").distinct()


class Asked:
    """Queries as tasks take them: the distinct terms of all, ascending, with their idf; each query's terms as places among these; and the score that a result of each has to reach."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, first: np.ndarray, floors: np.ndarray):
        self.terms, at, place = np.unique(terms, return_index=True, return_inverse=True)
        self.idf, self.place, self.first, self.floors = idf[at], place.astype(np.int32), first, floors


class Shard:
    """A shard ready for queries: impacts of all postings, and their maxima by term and by block."""

    def __init__(self, row: dict, mean: float):
        self.ids = np.frombuffer(row["docs"], np.int64)
        length = np.frombuffer(row["lengths"], np.int32)
        self.terms = np.frombuffer(row["terms"], U64)
        self.doc = np.frombuffer(row["postings"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["tfs"], np.uint32).astype(float)
        norm = K1 * (1 - B + B * length / mean) if mean else np.ones(len(length))
        self.impact = tf * (K1 + 1) / (tf + norm[self.doc])
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.start = np.append(0, np.cumsum(self.counts))
        self.term = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        block = self.doc // BLOCK
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (self.term[1:] != self.term[:-1])
        at = np.flatnonzero(new)
        self.blocks = -(-len(self.ids) // BLOCK)
        self.entry_start = np.append(at, len(block))  # an entry is a term's part of a block
        self.entry_block = block[at]
        self.entry_max = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.term_entry = np.searchsorted(self.term[at], np.arange(len(self.counts) + 1))
        self.term_max = np.maximum.reduceat(self.entry_max, self.term_entry[:-1]) if len(self.counts) else np.zeros(0)

    def weigh(self, asked: Asked) -> None:
        """What postings and maxima add to a score (a query has a term once, so that is the same for all queries), the postings by document, and the frequent terms as rows of a matrix."""
        at = np.minimum(np.searchsorted(asked.terms, self.terms), max(0, len(asked.terms) - 1))
        here = asked.terms[at] == self.terms if len(asked.terms) else np.zeros(len(self.terms), bool)
        self.slot = np.full(len(asked.terms), -1, np.int32)  # of each asked term
        self.slot[at[here]] = np.flatnonzero(here)
        idf = np.zeros(len(self.terms))
        idf[here] = asked.idf[at[here]]
        value = idf[self.term] * self.impact
        self.packed = np.stack([self.doc.astype(np.int32), value.astype(np.float32).view(np.int32)], 1).ravel().view(np.int64)  # place and value side by side
        self.most = idf * self.term_max
        by_doc = np.argsort(short(self.doc, len(self.ids)), kind="stable")  # terms of a document in their order, so scores add up alike in every shard
        self.doc_term, self.doc_value = self.term[by_doc], value[by_doc]
        self.doc_count = np.bincount(self.doc, minlength=len(self.ids))
        self.doc_start = np.cumsum(self.doc_count) - self.doc_count
        width = self.blocks * BLOCK
        some = np.flatnonzero(here & (self.counts * LEAST_SHARE >= len(self.ids)))
        self.frequent = some[np.argsort(-self.counts[some], kind="stable")][: min(FREQUENT, FREQUENT_BYTES // (4 * max(1, width)))]
        self.rank = np.full(len(self.terms), len(self.frequent), np.int32)
        self.rank[self.frequent] = np.arange(len(self.frequent))
        self.scores = np.zeros((len(self.frequent), width), np.float32)
        self.maxima = np.zeros((len(self.frequent), self.blocks), np.float32)
        for r, t in enumerate(self.frequent.tolist()):
            a, b, x, y = self.start[t], self.start[t + 1], self.term_entry[t], self.term_entry[t + 1]
            self.scores[r, self.doc[a:b]] = value[a:b]
            self.maxima[r, self.entry_block[x:y]] = idf[t] * self.entry_max[x:y]
        self.mark = np.zeros(len(self.terms), bool)

    def exact(self, slot: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The scores of documents for one query's terms."""
        count = self.doc_count[docs]
        at = spread(self.doc_start[docs], count)
        self.mark[slot] = True
        on = self.mark[self.doc_term[at]]
        self.mark[slot] = False
        return np.bincount(np.repeat(np.arange(len(docs)), count)[on], self.doc_value[at[on]], len(docs))

    def rare(self, slot: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Queries x documents: what postings add up to. Query q has the terms slot[first[q]:first[q + 1]]."""
        out = np.zeros((len(first) - 1, self.blocks * BLOCK), np.float32)
        count, n, i = self.counts[slot], len(self.ids), 0
        at = np.append(0, np.cumsum(count))[first]
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            packed = self.packed.take(spread(self.start[slot[first[i] : first[j]]], count[first[i] : first[j]]), mode="clip")
            doc, value, ends = packed.view(np.int32)[::2].astype(np.int64), packed.view(np.float32)[1::2].astype(float), (at[i : j + 1] - at[i]).tolist()
            for q in range(i, j):
                a, b = ends[q - i], ends[q - i + 1]
                if a < b:
                    out[q, :n] = np.bincount(doc[a:b], value[a:b], n)
            i = j
        return out

    def answers(self, asked: Asked, low: int, high: int, k: int, floors: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
        """Of the queries low to high: by query the ids and scores of its documents that reach its floor (where it has none, of at least the k best), and the number of blocks looked into. After `weigh`."""
        query = np.repeat(np.arange(low, high), np.diff(asked.first[low : high + 1]))
        slot = self.slot[asked.place[asked.first[low] : asked.first[high]]]
        on = np.flatnonzero(slot >= 0)
        query, slot = query[on], slot[on]
        near = np.bincount(query - low, self.most[slot], high - low)
        near = (near > 0) & (near >= (floors[low:high] - TIE) * SLACK)
        on = np.flatnonzero(near[query - low])
        query, slot = query[on], slot[on]
        some = low + np.flatnonzero(near)
        if not len(some):
            return {}, 0
        first = np.searchsorted(query, np.append(some, high))
        row = np.repeat(np.arange(len(some)), np.diff(first))
        # as many frequent terms go through the matrix as that is cheaper than adding up their postings
        rank = self.rank[slot]
        adds = np.bincount(rank, minlength=len(self.frequent) + 1)[:-1] * self.counts[self.frequent]
        rows = int(np.argmin(np.append(0, np.cumsum(len(some) * len(self.ids) / PRODUCT - adds))))
        frequent = rank < rows
        weight = np.zeros((len(some), rows), np.float32)
        weight[row[frequent], rank[frequent]] = 1
        rare = self.rare(slot[~frequent], np.append(0, np.cumsum(~frequent))[first])
        bound = weight @ self.maxima[:rows] + rare.reshape(len(some), self.blocks, BLOCK).max(2)
        exact = 1 - (np.diff(first) + 8) * 2.0**-22  # sums of so many numbers of 24 bits
        reach = (floors[some] - TIE) * exact
        for r in np.flatnonzero(floors[some] <= 0).tolist():  # the most promising blocks give a score to reach
            top = np.argsort(-bound[r], kind="stable")[: 3 + -(-k // BLOCK)] * BLOCK
            best = np.concatenate([rare[r, b : b + BLOCK] + weight[r] @ self.scores[:rows, b : b + BLOCK] for b in top.tolist()])
            reach[r] = (float(np.partition(best, -k)[-k]) - TIE) * exact[r] ** 2 if len(best) >= k else 0
        reach = np.maximum(reach, 1e-30)
        need, total = bound >= reach[:, None], rare
        for b in range(0, self.blocks, GROUP):
            r = np.flatnonzero(need[:, b : b + GROUP].any(1))
            if len(r):
                a = slice(b * BLOCK, (b + GROUP) * BLOCK)
                total[r, a] += weight[r] @ self.scores[:rows, a]
        for r in np.flatnonzero(floors[some] <= 0).tolist():
            if k <= len(self.ids):
                reach[r] = max(reach[r], (float(np.partition(total[r], -k)[-k]) - TIE) * exact[r] ** 2)
        r, d = np.nonzero(total >= reach[:, None])
        out, ends = {}, np.flatnonzero(np.diff(r, prepend=-1, append=len(some))).tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            q = int(r[a])
            score = self.exact(slot[first[q] : first[q + 1]], d[a:b])
            good = (score > 0) & (score >= floors[some[q]] - TIE)
            if good.any():
                out[int(some[q])] = self.ids[d[a:b][good]], score[good]
        return out, int(need.sum())

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best of those that reach `floor`, best first, and how many of the shard's blocks were skipped, for a single query. terms ascend."""
        asked = Asked(terms, idf, np.array([0, len(terms)]), np.array([floor]))
        self.weigh(asked)
        found, looked = self.answers(asked, 0, 1, k, asked.floors)
        return *leading(*found.get(0, (np.zeros(0, np.int64), np.zeros(0))), k), self.blocks - looked


def leading(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, best first; of scores that agree to DIGITS the smaller id."""
    keep = np.lexsort((ids, -np.round(scores, DIGITS)))[:k]
    return ids[keep], scores[keep]


RESULT = "query_id long, doc_id long, score double"
_NO_ID = np.iinfo(np.int64).max


def shard_results(shards: DataFrame, shared, mean: float, k: int) -> DataFrame:
    """Of each task: for every query the k best of its shards, of those that reach the query's score. shared: broadcast ids of queries (an Arrow array) and what is asked."""

    def work(batches):
        names, asked = shared.value
        floors, best = asked.floors.copy(), {}
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.slice(row, 1).to_pylist()[0], mean)
                shard.weigh(asked)
                step = max(1, min(BATCH, BATCH_BYTES // (4 * BLOCK * max(1, shard.blocks))))
                for low in range(0, len(floors), step):
                    found, _ = shard.answers(asked, low, min(low + step, len(floors)), k, floors)
                    for q, (ids, scores) in found.items():
                        if q in best:
                            ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                        best[q] = ids, scores = leading(ids, scores, k)
                        if len(ids) >= k:
                            floors[q] = max(floors[q], float(scores.min()))
                shard = None
        some = sorted(best)
        for i in range(0, len(some), 4096):
            part = some[i : i + 4096]
            owner = np.repeat(part, [len(best[q][0]) for q in part])
            docs, scores = (np.concatenate([best[q][c] for q in part]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(docs, mask=docs == _NO_ID), pa.array(scores)], names=["query_id", "doc_id", "score"])
        best = None
        trim()

    return shards.mapInArrow(work, RESULT)


def packed_queries(weighted: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """On the driver: ids of queries, those with few terms first, their terms and idf one after another, and where each query's begin (and the total)."""
    table = weighted.select("query_id", "terms.term", "terms.idf").toArrow().combine_chunks()
    table = table.take(np.lexsort((np.array(table.column("query_id").to_numpy()), pa.compute.list_value_length(table.column("term")).to_numpy())))
    flat = lambda c, t: pa.compute.list_flatten(table.column(c)).to_numpy().astype(t)
    count = pa.compute.list_value_length(table.column("term")).to_numpy().astype(np.int64)
    ids = table.column("query_id").combine_chunks()
    return ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks), flat("term", np.int64).view(U64), flat("idf", float), np.append(0, np.cumsum(count))


@contextmanager
def setting(spark: SparkSession, key: str, value: int):
    """A setting of the session while something runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rounds(levels: dict[int, int], first: int = FIRST_SHARDS) -> list[list[int]]:
    """levels: shards of each level. The levels of each round: the highest together until they have `first` shards, then one at a time."""
    out, size = [[]], 0
    for level in sorted(levels, reverse=True):
        if size >= first:
            out.append([])
        out[-1].append(level)
        size += levels[level]
    return [x for x in out if x]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, doc_id, score. queries: query_id, text (one text for an id)."""
    spark = docs.sparkSession
    with setting(spark, "spark.sql.files.maxRecordsPerFile", 1):  # a shard a file, so that shards are dealt to tasks one by one
        shards = written(index(docs, shard_bytes), ["level"])

    def totals(batches):
        for batch in batches:
            n = [np.frombuffer(x, np.int32) for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("level"), pa.array([len(x) for x in n], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in n], pa.int64())], names=["level", "n", "words"])

    sums = shards.select("level", "lengths").mapInArrow(totals, "level int, n long, words long").groupBy("level").agg(F.count("*"), F.sum("n"), F.sum("words")).collect()  # a row per level
    n, words = sum(r[2] for r in sums), sum(r[3] for r in sums)
    turns = rounds({r[0]: r[1] for r in sums})
    asked = query_terms(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")))
    idf = document_frequencies(shards).select("term", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = written(asked.join(idf, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms")))
    size = weighted.agg(F.sum(F.size("terms").cast("long") * 16)).first()[0] or 0
    parts, found = max(1, -(-size // query_bytes)), []
    for p in range(parts):
        some = weighted if parts == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
        names, terms, idf, first = packed_queries(some)
        floors, mine = np.zeros(len(names)), []
        for levels in turns:
            shared = spark.sparkContext.broadcast((names, Asked(terms, idf, first, floors)))
            with setting(spark, "spark.sql.files.maxPartitionBytes", TASK_BYTES):
                mine.append(written(shard_results(shards.where(F.col("level").isin(levels)), shared, words / n if n else 0.0, k)))
            shared.unpersist()
            if levels is not turns[-1]:
                kth = ranked(reduce(DataFrame.unionByName, mine), k).groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toArrow()  # a row for each query of the block
                reached = dict(zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist(), strict=True))
                floors = np.array([reached.get(q, 0.0) for q in names.to_pylist()])
        found += mine
    if not found:
        found = [spark.createDataFrame([], RESULT)]
    return ranked(reduce(DataFrame.unionByName, found), k).select("query_id", "rank", "doc_id", "score")
