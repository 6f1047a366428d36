"""Trained operators and the pipeline against plain loops; odd tables."""

import math
import random
import re
from functools import reduce
from operator import add

import numpy as np
import pytest

W = re.compile(rb"[^\x20\x09-\x0d]+")


def plain_statistics(text):
    words, n = W.findall(text), max(1, len(text))
    count = max(1, len(words))
    lines = text.split(b"\n")
    full = [x for x in lines if x]
    pairs = list(zip(words[:-1], words[1:], strict=True))
    share = lambda chars: sum(c in chars for c in text) / n
    letters = set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
    upper = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    mean, square = sum(map(len, words)) / count, sum(len(w) ** 2 for w in words) / count
    return [
        math.log1p(len(text)), math.log1p(len(words)), mean, sum(len(w) > 14 for w in words) / count, sum(len(w) <= 3 for w in words) / count, share(upper), share(b"0123456789"), share(b".,;:!?'\"()-"), share(b"#$%&*@^~+=_<>\\/`"), share(b"|"), sum(c >= 128 for c in text) / n,
        len(lines) / count if text else 0.0, sum(len(x) < 20 for x in full) / max(1, len(full)), 1 - len(set(full)) / len(full) if full else 0.0, len(set(words)) / count, max(map(words.count, set(words)), default=0) / count,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0, sum(w[-1] in b".!?" for w in words) / count, sum(w[0] in upper for w in words) / count, sum(set(w) <= letters for w in words) / count, math.sqrt(max(0.0, square - mean**2)), share(b"{}[]<>;="),
    ]


def plain_scores(x, y, trees, depth, bins, rate, ridge, least_rows):
    """Scores of the rows after boosting, one row, feature and bin at a time."""
    rows, features = len(x), len(x[0])
    edges = [sorted({float(np.quantile([r[j] for r in x], q)) for q in np.linspace(0, 1, bins + 1)[1:-1]}) for j in range(features)]
    of = [[sum(e < r[j] for e in edges[j]) for j in range(features)] for r in x]
    p = sum(y) / rows
    margin = [math.log(p / (1 - p))] * rows
    for _ in range(trees):
        prob = (1 / (1 + np.exp(-np.array(margin)))).tolist()  # to the last bit, as equal gains are decided by it
        g, h = [a - b for a, b in zip(prob, y, strict=True)], [a * (1 - a) for a in prob]
        groups = [list(range(rows))]
        for _ in range(depth):
            below = []
            for members in groups:
                best, cut = 1e-9, None
                for j in range(features):
                    sums = [[0.0, 0.0, 0] for _ in range(bins)]
                    for i in members:
                        s = sums[of[i][j]]
                        s[0], s[1], s[2] = s[0] + g[i], s[1] + h[i], s[2] + 1
                    every = [reduce(add, (s[k] for s in sums)) for k in range(3)]  # sum() would round otherwise than numpy
                    a = [0.0, 0.0, 0]
                    for b in range(len(edges[j])):
                        a = [v + w for v, w in zip(a, sums[b], strict=True)]
                        if a[2] >= least_rows and every[2] - a[2] >= least_rows:
                            gain = a[0] * a[0] / (a[1] + ridge) + (every[0] - a[0]) * (every[0] - a[0]) / (every[1] - a[1] + ridge) - every[0] * every[0] / (every[1] + ridge)
                            if gain > best:
                                best, cut = gain, (j, b)
                left = [i for i in members if cut is None or of[i][cut[0]] <= cut[1]]
                below += [left, [i for i in members if i not in set(left)]]
            groups = below
        for members in groups:
            if members:
                value = -rate * reduce(add, (g[i] for i in members)) / (reduce(add, (h[i] for i in members)) + ridge)
                for i in members:
                    margin[i] += value
    return [1 / (1 + math.exp(-m)) for m in margin]


def some_texts(r, n):
    pick = ["alpha", "Beta", "gamma.", "12", "x=1;", "{}", "wörter", "Supercalifragilistic", "the", "a", "|", "end!"]
    return [("\n" if r.random() < 0.3 else " ").join(" ".join(r.choices(pick[: r.randrange(2, 13)], k=r.randrange(1, 9))) for _ in range(r.randrange(1, 6))).encode() for _ in range(n)]


def test_quality_statistics():
    from starloom.llm.quality import NAMES, statistics

    texts = [b"", b" ", b"\n\n", "é ß".encode(), b"a\na\nb", *some_texts(random.Random(1), 60)]
    got = statistics(texts)
    for text, row in zip(texts, got.tolist(), strict=True):
        assert row == pytest.approx(plain_statistics(text), abs=1e-9), (text, NAMES)


def test_quality_scores(spark, monkeypatch):
    from starloom.llm import quality as Q

    monkeypatch.setattr(Q, "TREES", 4)
    monkeypatch.setattr(Q, "DEPTH", 3)
    monkeypatch.setattr(Q, "BINS", 12)
    r = random.Random(2)
    texts = some_texts(r, 160)
    x = Q.statistics(texts)
    y = [int((b"the" in t) ^ (r.random() < 0.2)) for t in texts]
    assert Q.boost(x, np.array(y, float)).scores(x).tolist() == pytest.approx(plain_scores(x.tolist(), y, 4, 3, 12, Q.RATE, Q.RIDGE, Q.LEAST_ROWS), abs=1e-9)
    docs = spark.createDataFrame([*((i, t.decode()) for i, t in enumerate(texts)), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, v) for i, v in enumerate(y)), (0, y[0]), (None, 1), (5, None)], "doc_id long, quality int")
    got = {a.doc_id: a for a in Q.quality(docs, labels).collect()}
    used = [i for i in [*range(160), 0] if not got[i].held_out]
    want = plain_scores([x[i].tolist() for i in sorted(used)], [y[i] for i in sorted(used)], 4, 3, 12, Q.RATE, Q.RIDGE, Q.LEAST_ROWS)
    assert [got[i].score for i in sorted(used)] == pytest.approx(want, abs=1e-6)
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1 and all(a.predicted == (a.score >= 0.5) for a in got.values())


def symbols(text):
    """Lower-case letters, every run of others one space, none in front."""
    return re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text)).lstrip(" ")


def plain_phrases(text, sample, segment):
    count = 0
    for at in range(0, len(text), segment):
        part, i = text[at : at + segment], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i : i + n + 1] in sample:
                n += 1
            i, count = i + n, count + 1
    return count


def test_language_phrases(spark):
    from starloom.llm.langid import SEGMENT, languages, train

    r = random.Random(3)
    word = lambda chars: "".join(r.choices(chars, k=r.randrange(1, 7)))
    chars = {"a": "abcdeé", "b": "cdefgß", "c": "xyzabc"}
    prose = lambda k, n: "".join(word(chars[k]) + r.choice([" ", ", ", "\n", " 12 "]) for _ in range(n))
    samples = {k: [prose(k, 60) for _ in range(3)] for k in chars}
    model = train(samples)
    texts = [None, "", "12 -- 3", "Ωmega", "a", *(prose(r.choice("abc"), r.randrange(1, 400)) for _ in range(40)), "  A b" * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in languages(docs, model).collect()}
    sample = {k: symbols("\n".join(v)) for k, v in samples.items()}
    for i, t in enumerate(texts):
        s = symbols((t or "") + "\n")
        if not s.strip():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        bits = sorted((plain_phrases(s, x, SEGMENT) * math.log2(len(x) + 1) / len(s), k) for k, x in sample.items())
        assert got[i].lang_pred == bits[0][1] and got[i].score == pytest.approx(bits[1][0] / (bits[0][0] + bits[1][0]))


def test_equal_languages_give_the_first_by_name(spark):
    from starloom.llm.langid import languages, train

    docs = spark.createDataFrame([(1, "abc abd"), (2, "zzz")], "doc_id long, text string")
    assert {(x.lang_pred, x.score) for x in languages(docs, train({"q": ["abc abd"], "p": ["abc abd"]})).collect()} == {("p", 0.5)}


def words(text):
    return W.findall((text or "").encode())


def kept_of_near_copies(rows):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    return [r for k, r in enumerate(rows) if r[0] == min(x[0] for x, g in zip(rows, group, strict=True) if g == group[k])]


def cut_passages(rows):
    seen = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])] = min(i, seen.get(tuple(w[k : k + 50]), i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        if gone and len(gone) == len(w):
            continue
        at, text = 0, []
        for p, m in enumerate(re.finditer(rb"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", t.encode())):
            text.append(t.encode()[at : m.start()] + (b"" if p in gone else m.group()))
            at = m.end()
        out.append((i, (b"".join(text) or t.encode()).decode()))
    return out


def free_of(rows, items):
    fold = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = set()
    for t in items:
        w = fold(t)
        m = min(10, len(w))
        grams |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    bad = lambda w: any(tuple(w[k : k + m]) in grams for m in {len(g) for g in grams} for k in range(len(w) - m + 1))
    return [(i, t) for i, t in rows if not bad(fold(t))]


def corpus(r):
    en = [w + s for w in "the of and that with from have this will your which their about would there other into could than".split() for s in ("", "s", "ing", "ed", "er", "ly")]
    de = [w + s for w in "der die und ist nicht mit auf für eine sich auch werden nach haben über können müssen".split() for s in ("", "en", "er", "lich", "keit", "ß")]
    prose = lambda n, v=en: " ".join(r.choice(v) for _ in range(n))
    passage, item = [prose(r.randrange(50, 80)) for _ in range(3)], [prose(r.randrange(4, 15)) for _ in range(3)]
    texts = [None, "", "12345 !!", "é", prose(6000)]
    for _ in range(40):
        v = r.choice([en, de])
        t = prose(r.randrange(1, 160), v)
        for extra in (passage, item):
            if r.random() < 0.3:
                t += r.choice(["  ", "\n", " "]) + r.choice(extra) + " " + prose(r.randrange(30), v)
        texts.append(t)
        if r.random() < 0.4:
            w = t.split(" ")
            w[r.randrange(len(w))] = "edit"
            texts.append(r.choice([t, t.upper(), " ".join(w)]))
    r.shuffle(texts)
    return texts, item


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_of_random_documents(spark, tmp_path, seed):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    texts, items = corpus(random.Random(seed))
    rows = [(i, t, "de" if t and ("lich" in t or "ß" in t) else "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __k string, __copy int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: list(x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    left = free_of(cut_passages(kept_of_near_copies(left)), items)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert got == {i: sp.encode(t) for i, t in left} and 10 < len(left) < len(texts)


def test_pipeline_of_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id string, __a int, row string, ids int, `odd.name` int"
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    base = " ".join(f"word{i}" for i in range(70))
    tables = {"empty": [], "repeated": [(1, base, "en", "s", 5, "a", 1, "b", 2, 3)] * 3 + [(2, base, None, None, None, None, None, None, None, None), (None, base, "en", "s", 1, "a", 1, "b", 2, 3)]}
    for name, rows in tables.items():
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        bench.write.parquet(str(folder / "benchmark.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, (label, f) in enumerate(corpus_pipeline.STAGES):
            if stage < 4:
                assert f(spark, docs, str(folder)).columns == docs.columns, label
        assert [x.doc_id for x in corpus_pipeline.run(spark, str(folder)).collect()] == [r[0] for r in rows[:3]]


def test_long_texts(spark, monkeypatch):
    """A text beyond the bytes of one numpy step, and words of a hundred thousand letters."""
    from starloom.llm import common
    from starloom.llm.decontaminate import contamination
    from starloom.llm.minhash import near_duplicates
    from starloom.llm.substrings import without_repeats
    from starloom.llm.suffixes import without_repeated_bytes

    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**7)}" for _ in range(250_000))
    assert len(long) > common.CHUNK_BYTES - 400_000
    long += " tail" * 100_000
    giant = "".join(r.choice("abc") for _ in range(100_000))
    d = spark.createDataFrame([(1, long), (2, "x " + long), (3, giant), (4, giant + " y")], "doc_id long, text string")
    n = len(long.split())
    assert {x.doc_id: (x.n_words, x.n_removed) for x in without_repeats(d).collect()} == {1: (n, 0), 2: (n + 1, n), 3: (1, 0), 4: (2, 0)}
    assert {x.doc_id: (x.n_bytes, x.n_removed) for x in without_repeated_bytes(d).collect()} == {1: (len(long), 0), 2: (len(long) + 2, len(long)), 3: (100_000, 0), 4: (100_002, 100_000)}
    assert {x.id: x.component_id for x in near_duplicates(d, 3, 85).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    bench = spark.createDataFrame([(1, giant)], "item_id long, text string")
    assert {x.id: x.n_hit for x in contamination(d, bench).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def labelled(spark, texts):
    return spark.createDataFrame([(i, x, lang) for i, (x, lang) in enumerate(texts)], "doc_id long, text string, lang string")


def test_language_of_long_documents_is_learnt(spark):
    from starloom.llm.langid import languages

    d = labelled(spark, [(f"alpha beta gamma {i} " * 1500, "long") for i in range(40)] + [(f"one two three {i} four", "short") for i in range(40)])
    assert {(r.lang, r.lang_pred) for r in languages(d).join(d.select("doc_id", "lang"), "doc_id").select("lang", "lang_pred").distinct().collect()} == {("long", "long"), ("short", "short")}


def test_languages_of_many_letters_stay_apart():
    import random

    from starloom.llm.langid import predict, train

    rng = random.Random(5)
    text = lambda first, n: "".join(chr(first + rng.randrange(600)) for _ in range(n))
    scripts = {"a": 0x4E00, "b": 0x5E00, "c": 0x6E00, "d": 0xAC00}
    model = train({k: [text(v, 5000)] for k, v in scripts.items()})
    asked = [(k, text(v, 200)) for k, v in scripts.items() for _ in range(20)]
    assert predict(model, [x for _, x in asked])[0] == [k for k, _ in asked]
