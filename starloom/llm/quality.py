"""Document quality by histogram gradient-boosted trees over statistics of the text.

The statistics are taken from whole texts in numpy, many texts at once. Training bins each of them
by quantiles, sums gradients and Hessians into histograms, and grows trees of fixed depth level by
level on the logistic loss; a tree is laid out as a full binary tree in arrays (feature, threshold,
leaf value), so that all texts go down a level in one indexing step.

Labels are learnt from a sample bounded by SAMPLE_ROWS, picked by a hash over all labelled rows;
held-out documents are never among them. Ids, sources and languages are no inputs.

Defined cases: null and empty texts have all statistics 0 and get the score of such a text; without
labels of both kinds every score is the share of label 1 (0.5 without labels); a document labelled twice counts
twice; rows that repeat get a row each; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, held_out, mix, packed, per_item, word_bounds, word_hashes

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 10
NAMES = ["log_bytes", "log_words", "word_length", "long_words", "short_words", "upper", "digit", "point", "symbol", "pipe", "high", "lines", "short_lines", "repeated_lines", "distinct_words", "top_word", "repeated_pairs", "sentence_ends", "title_words", "plain_words", "word_spread", "code_marks"]


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, LOWER, DIGIT = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_class("abcdefghijklmnopqrstuvwxyz"), byte_class("0123456789")
POINT, SYMBOL, PIPE, CODE, STOP = byte_class(".,;:!?'\"()-"), byte_class("#$%&*@^~+=_<>\\/`"), byte_class("|"), byte_class("{}[]<>;="), byte_class(".!?")
HIGH = np.arange(256) >= 128


def repeats_per(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: distinct keys, and the count of the most frequent."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[at], size)
    return np.bincount(o[at], minlength=n), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """(text, statistic)."""
    n = len(texts)
    data, at = packed(texts)
    size = np.diff(at) - 1
    starts, ends = word_bounds(data)
    first = np.searchsorted(starts, at)
    words = np.diff(first)
    length = ends - starts
    owner = np.repeat(np.arange(n), words)
    hashes = word_hashes(data, starts, ends)
    distinct, top = repeats_per(hashes, owner, n)
    same = owner[1:] == owner[:-1]
    pair_owner = owner[1:][same]
    with np.errstate(over="ignore"):
        pair = mix(hashes[:-1][same] * np.uint64(3) + hashes[1:][same])
    pairs = np.bincount(pair_owner, minlength=n)
    distinct_pairs, _ = repeats_per(pair, pair_owner, n)
    newline = np.flatnonzero(data == 10)  # the last one of a text is the packing's
    line_start = np.concatenate([[0], newline[:-1] + 1])
    line_owner = np.searchsorted(at, line_start, side="right") - 1
    line_length = newline - line_start
    lines = np.bincount(line_owner, minlength=n)
    full = line_length > 0
    distinct_lines, _ = repeats_per(word_hashes(data, line_start[full], newline[full]), line_owner[full], n)
    full_lines = np.bincount(line_owner[full], minlength=n)
    bytes_, count = np.maximum(1, size), np.maximum(1, words)
    share = lambda mask: per_item(mask[data], at) / bytes_
    of_words = lambda flag: np.bincount(owner[flag], minlength=n) / count
    mean = np.bincount(owner, length, n) / count
    square = np.bincount(owner, length.astype(float) ** 2, n) / count
    low = LOWER | HIGH
    plain = per_word(low[data], starts, ends) == length
    columns = [
        np.log1p(size), np.log1p(words), mean, of_words(length > 14), of_words(length <= 3), share(UPPER), share(DIGIT), share(POINT), share(SYMBOL), share(PIPE), share(HIGH),
        lines / count * (size > 0), np.bincount(line_owner[full & (line_length < 20)], minlength=n) / np.maximum(1, full_lines), 1 - distinct_lines / np.maximum(1, full_lines) - (full_lines == 0), distinct / count, top / count,
        1 - distinct_pairs / np.maximum(1, pairs) - (pairs == 0), of_words(STOP[data[ends - 1]]), of_words(UPPER[data[starts]]), of_words(plain), np.sqrt(np.maximum(0, square - mean**2)), share(CODE),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def per_word(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[ends] - sums[starts]


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (tree, inner node)
    threshold: np.ndarray
    leaf: np.ndarray  # (tree, leaf)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        inner = (1 << depth) - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    share = float(y.mean()) if len(y) else 0.5
    none = Trees(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros((0, (1 << DEPTH) - 1), np.int64), np.zeros((0, (1 << DEPTH) - 1)), np.zeros((0, 1 << DEPTH)))
    if len(y) == 0 or share in (0.0, 1.0):
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # value <= edge k is in a bin up to k
    flat = binned + np.arange(x.shape[1]) * BINS
    margin, trees = np.full(len(y), none.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf)
        for depth in range(DEPTH):
            base, width = (1 << depth) - 1, x.shape[1] * BINS
            index = ((node - base)[:, None] * width + flat).ravel()
            sums = [np.bincount(index, np.repeat(w, x.shape[1]), (1 << depth) * width).reshape(1 << depth, x.shape[1], BINS) for w in (g, h, np.ones(len(y)))]
            left = [np.cumsum(s, axis=2) for s in sums]
            all_ = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + RIDGE) + (all_[0] - left[0]) ** 2 / (all_[1] - left[1] + RIDGE) - all_[0] ** 2 / (all_[1] + RIDGE)
            gain[(left[2] < LEAST_ROWS) | (all_[2] - left[2] < LEAST_ROWS)] = 0
            best = gain.reshape(1 << depth, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                j, cut = divmod(b, BINS)
                if gain[k, j, cut] > 1e-9 and cut < len(edges[j]):
                    feature[base + k], threshold[base + k] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - ((1 << DEPTH) - 1)
        value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + RIDGE)
        margin = margin + value[leaf]
        trees.append((feature, threshold, value))
    return Trees(none.base, *(np.stack(z) for z in zip(*trees, strict=True)))


def statistics_of(rows: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """The columns and `x`, the packed statistics of `text`."""

    def work(batches):
        for batch, texts in by_bytes(batches):
            x = statistics(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([r.tobytes() for r in x], pa.binary())], names=[*columns, "x"])

    return rows.select(*columns, "text").mapInArrow(work, f"{schema}, x binary")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learns from labelled rows that are not held out; the sample of labels is small, so it goes to where the texts are."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    chosen = F.broadcast(known)  # about sample_rows rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = statistics_of(texts, ["doc_id", "quality"], "doc_id long, quality int").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[2])))
    x = np.array([np.frombuffer(r[2]) for r in rows]).reshape(len(rows), len(NAMES))
    return boost(x, np.array([r[1] for r in rows], float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; scans in place, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch, texts in by_bytes(batches):
            score = shared.value.scores(statistics(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
