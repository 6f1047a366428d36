"""Language by cross-parsing: which language's labelled text explains a text in the fewest phrases.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is
cut greedily into the longest phrases that occur in that sample (a symbol that never occurs is a
phrase of its own). phrases * log2(sample length) / text length estimates the cross entropy; the
smallest wins, the first by name of equals.

Symbols: letters, lower-cased; every run of other characters is one space. Up to PLAIN letters in the
samples have a symbol each. With more letters the commonest ones have, and each other letter is a word
of fixed length over DIGITS further symbols, so no two letters that were met are alike. Letters that
no sample has share one symbol, which no automaton knows. Texts are parsed whole, in segments of SEGMENT symbols that all advance at once through dense tables; a segment's end
closes a phrase.

Defined cases: null texts and texts without a letter are `und` with score 0; if no row is
labelled everything is; a table with one language gives it with score 1; rows that repeat get a
row each; an empty table gives no row; further columns are ignored.

Bounds: per language SAMPLE_DOCS documents of at most SAMPLE_DOC_CHARS, chosen by a hash over all
labelled rows (longer ones are cut), and of these SAMPLE_SYMBOLS letters and spaces; the tables are SIGMA * 2 * SAMPLE_SYMBOLS * 4
bytes a language, times the length of a letter's code where letters have words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, held_out, numbered, per_item, trim

SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_SYMBOLS = 48, 20_000, 20_000
SIGMA, SEGMENT = 64, 512
PLAIN, DIGITS = SIGMA - 2, 16
UNDETERMINED = "und"
_NEW = np.uint32(1 << 31)


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # code point -> letter's number; 0 is no letter
    codes: np.ndarray  # (letter's number, place) -> symbol
    sizes: np.ndarray  # letter's number -> length of its code
    table: np.ndarray  # (language, state, symbol) -> next state, with _NEW set where a phrase begins
    base: np.ndarray  # first state of each language
    cost: np.ndarray  # bits a phrase


def letters() -> np.ndarray:
    """Code point -> lower-cased letter's code point, 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: transitions of each state; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return go


def dense(go: list[dict[int, int]], base: int) -> np.ndarray:
    """Rows of next states; a missing transition begins a phrase with the symbol, or stands alone at the start."""
    table = np.empty((len(go), SIGMA), np.uint32)
    alone = np.uint32(base) | _NEW
    root = np.full(SIGMA, alone, np.uint32)
    for c, s in go[0].items():
        root[c] = np.uint32(base + s) | _NEW
    table[:] = root
    for s, row in enumerate(go[1:], 1):
        for c, t in row.items():
            table[s, c] = base + t
    return table


def squeeze(symbols: np.ndarray) -> np.ndarray:
    """Which symbols stay when runs of 0 become one."""
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    return keep


def alphabet(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their lengths of the letters by how common they are; number 0 is the space, the last is for letters not met."""
    n = len(counts)
    plain = n if n <= PLAIN else PLAIN - DIGITS
    width = 1
    while DIGITS**width < n - plain:
        width += 1
    codes, sizes = np.zeros((n + 2, width), np.uint8), np.ones(n + 2, np.int64)
    codes[1 : plain + 1, 0] = np.arange(1, plain + 1)
    for place in range(width):
        codes[plain + 1 : n + 1, place] = plain + 1 + np.arange(n - plain) // DIGITS ** (width - 1 - place) % DIGITS
    sizes[plain + 1 : n + 1] = width
    codes[n + 1, 0] = SIGMA - 1
    return codes, sizes


def coded(numbers: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the letters, and where each letter's begin (and the end)."""
    if codes.shape[1] == 1:
        return codes[numbers, 0], np.arange(len(numbers) + 1)
    at = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(sizes[numbers], out=at[1:])
    return codes[numbers][np.arange(codes.shape[1]) < sizes[numbers][:, None]], at


def train(samples: dict[str, list[str]]) -> Model:
    fold = letters()
    code = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    texts = {lang: fold[code("\n".join(x))] for lang, x in sorted(samples.items())}
    texts = {lang: x[squeeze(x)][:SAMPLE_SYMBOLS] if len(x) else x for lang, x in texts.items()}
    counts = Counter(int(c) for x in texts.values() for c in x if c)
    met = [c for c, _ in counts.most_common()]
    codes, sizes = alphabet(counts)
    number = np.full(0x110000, len(met) + 1, np.int32)
    number[0] = 0
    number[met] = np.arange(1, len(met) + 1)
    classes = number[fold]
    tables, base, cost, languages, total = [], [], [], [], 0
    for lang, x in texts.items():
        if not (x > 0).any():
            continue
        s, _ = coded(number[x], codes, sizes)
        table = dense(automaton(s.tolist()), total)
        tables.append(table)
        languages.append(lang)
        base.append(total)
        cost.append(np.log2(len(s) + 1))
        total += len(table)
    return Model(languages, classes, codes, sizes, np.concatenate(tables).ravel() if tables else np.zeros(0, np.uint32), np.array(base, np.uint32), np.array(cost))


def fit(docs: DataFrame) -> Model:
    """Learns from rows with text and lang that are not held out.

    Of each language the SAMPLE_DOCS texts that come first by a hash of id and text: keys are grouped and
    ranked, then only their texts are fetched, each once. So every language is learnt, however its rows
    repeat an id or a text, and what comes to the driver is SAMPLE_DOCS texts a language.
    """
    text = F.col("text").cast("string")
    labelled = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", F.xxhash64(F.lit(11), "text", F.col("doc_id").cast("long")).alias("u"), F.substring("text", 1, SAMPLE_DOC_CHARS).alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    chosen = labelled.groupBy("lang", "u").count().withColumn("nth", order).where(F.col("nth") <= SAMPLE_DOCS).select("lang", "u").collect()
    samples: dict[str, list[tuple]] = {}
    if chosen:
        keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, u long"))  # SAMPLE_DOCS rows a language
        for r in labelled.join(keys, ["lang", "u"]).groupBy("lang", "u").agg(F.min("text").alias("text")).collect():
            samples.setdefault(r["lang"], []).append((r["u"], r["text"]))
    return train({lang: [t for _, t in sorted(x)] for lang, x in samples.items()})


def phrases(model: Model, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(language, text): phrases that each text needs. at: where each text's symbols begin, and the end."""
    size = np.diff(at)
    lanes = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), lanes)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = at[owner] + k * SEGMENT
    length = np.minimum(SEGMENT, at[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    n_lang = len(model.languages)
    state = np.repeat(model.base[:, None], len(owner), axis=1)
    count = np.zeros((n_lang, len(owner)), np.uint32)
    alive = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
    for t in range(int(length[0]) if len(length) else 0):
        n = alive[t]
        here = symbols[start[:n] + t]
        nxt = model.table[(state[:, :n] << np.uint32(6)) | here]
        count[:, :n] += nxt >> np.uint32(31)
        state[:, :n] = nxt & ~_NEW
    out = np.zeros((n_lang, len(size)), np.int64)
    for i in range(n_lang):
        out[i] = np.bincount(owner, count[i], len(size)).astype(np.int64)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    joined = "\n".join(x or "" for x in texts) + "\n"
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x or "") + 1 for x in texts], out=at[1:])
    symbols = model.classes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    has = per_item(symbols > 0, at) > 0
    keep = squeeze(symbols)
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    symbols, begin = coded(symbols[keep], model.codes, model.sizes)
    at = begin[kept[at]]
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    bits = phrases(model, symbols, at) * model.cost[:, None] / np.maximum(1, np.diff(at))
    best = np.argmin(bits, axis=0)
    ranked = np.sort(bits, axis=0)
    second = ranked[1] if len(ranked) > 1 else np.full(len(texts), np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(np.isinf(second), 1.0, second / (ranked[0] + second))
    score = np.where(has, np.nan_to_num(score), 0.0)
    return [model.languages[i] if h else UNDETERMINED for i, h in zip(best.tolist(), has.tolist(), strict=True)], score


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, k (hash of the text), held_out, lang_pred, score for every row; scans in place, no shuffle."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in chunks([len(x or "") for x in texts], 1 << 20):
                pred, score = predict(shared.value, texts[i:j])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "k", "held_out", "lang_pred", "score"])
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out")).select("doc_id", F.xxhash64("text").alias("k"), "held_out", "text")
    return rows.mapInArrow(work, "doc_id long, k long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose language is determined, with `lang` as predicted; other columns unchanged."""
    from pyspark.sql.types import StringType

    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source, names = numbered(docs.withColumn("text", F.col("text").cast("string")).withColumn("lang", F.col("lang").cast(StringType())))
    text, lang, every = names["text"], names["lang"], [*names.values()]

    def work(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, j in chunks([len(x or "") for x in texts], 1 << 20):
                pred, _ = predict(shared.value, texts[i:j])
                part = batch.slice(i, j - i)
                columns = [pa.array(pred, pa.string()) if c == lang else part.column(c) for c in every]
                yield pa.RecordBatch.from_arrays(columns, names=every).filter(pa.array([p != UNDETERMINED for p in pred], pa.bool_()))
        trim()

    return source.mapInArrow(work, source.schema).toDF(*docs.columns)
