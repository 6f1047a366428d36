"""Collocations against counting in plain loops, automata against all substrings."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from starloom.llm import phrases
from starloom.llm.phrases import Automaton, Filter, Words, collocations, frequent_phrases


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, most, least, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        inside = lambda q: any(q[i : i + len(w)] == w for i in range(len(q) - len(w) + 1))
        if any(m == lang and len(q) > len(w) and 100 * b >= percent * a and inside(q) for (m, q), b in candidates.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], k + 1, *x[1:]) for k, x in enumerate(mine[:top])]
    return sorted(ranked)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocabulary = ["the", "The", "of", "New", "york", "é", "日本", "a-b", "x" * 70, "abcdefghijklmnop", "mjerdhnqwx2z6bd3", "rare"]
    out = []
    for _ in range(400):
        pieces = []
        for _ in range(r.randrange(1, 5)):
            w = [r.choice(vocabulary[:11]) if r.random() < 0.99 else f"w{r.randrange(999)}" for _ in range(r.randrange(9))]
            if r.random() < 0.3:
                w += ["one", "two", "three", "four", "five"][r.randrange(2) :]
            pieces.append(r.choice([" ", "  ", "\t"]).join(w))
        out.append((r.choice([". ", ",", "\n", "; "]).join(pieces), r.choice(["en", "de", None])))
    return [*out, out[3], out[3], (None, "en"), ("", None), (" . ", "fr"), ("one two three four five " * 5000, "en")]


@pytest.mark.parametrize(("most", "least", "percent", "top"), [(5, 20, 100, 2000), (4, 15, 60, 7), (2, 30, 100, 50), (5, 10**6, 100, 9)])
def test_collocations(spark, rows, most, least, percent, top):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).selectExpr("*", "1 AS phrase", "2 AS f", "3 AS n", "4 AS Rank")
    got = sorted(map(tuple, collocations(docs, most, least, percent, top).collect()))
    assert got == brute(rows, most, least, percent, top)
    assert bool(got) == (least < 10**6)


def test_empty(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_products_past_64_bits(spark, monkeypatch):
    def tables(docs, most, least):
        rows = [("en", None, 4 * 10**15), ("en", "a", 3 * 10**15), ("en", "b", 3 * 10**15 + 1), ("en", "c", 10**15)]
        table = lambda x: spark.createDataFrame(x, "lang string, phrase string, f long")
        return [table(rows), table([("en", "a b", 2 * 10**15 + 7), ("en", "b c", 10**15 - 1)]), table([("en", "a b c", 10**15 - 2)])]

    monkeypatch.setattr(phrases, "frequent_phrases", tables)
    got = {r.phrase: (r.score, r.l, r.r) for r in collocations(spark.range(1)).collect()}
    n, a, b, c = 4 * 10**15, 3 * 10**15, 3 * 10**15 + 1, 10**15
    assert got["a b"] == (1000 * (2 * 10**15 + 7) * n // (a * b), a, b)
    assert got["b c"] == (1000 * (c - 1) * n // (b * c), b, c)
    assert got["a b c"][0] == min(1000 * (c - 2) * n // (a * (c - 1)), 1000 * (c - 2) * n // ((2 * 10**15 + 7) * c))


def test_automaton_holds_all_substrings():
    r = random.Random(2)
    for _ in range(200):
        size, depth = r.randrange(1, 60), r.randrange(1, 6)
        ids = np.array([r.randrange(3) for _ in range(size)])
        ids = np.unique(ids, return_inverse=True)[1]
        follows = np.array([i > 0 and r.random() < 0.8 for i in range(size)])
        a = Automaton.of(ids, follows, depth)
        ends_of = {}
        for n in range(1, depth + 1):
            for e in range(n - 1, size):
                if all(follows[e - n + 2 : e + 1]):
                    ends_of.setdefault(tuple(ids[e - n + 1 : e + 1].tolist()), []).append(e)
        for n in range(1, depth + 1):
            ends, counts = a.substrings(n)
            assert sorted((tuple(ids[e - n + 1 : e + 1].tolist()), c) for e, c in zip(ends.tolist(), counts.tolist())) == sorted((w, len(x)) for w, x in ends_of.items() if len(w) == n)
        assert len(a.end) == len({tuple(x) for x in ends_of.values()})  # a state for each set of places


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(phrases, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = Words([b"a b A ab a, b", b"a b"], ["en", "de"])
    assert [words.ids[i] == words.ids[j] for i, j in ((0, 2), (0, 4), (1, 5), (0, 1), (0, 3), (0, 6), (1, 7), (6, 7))] == [True, True, True, False, False, False, False, False]
    assert words.phrases(np.array([1, 4]), 2).to_pylist() == ["a b", "ab a"]
    assert words.follows.tolist() == [False, True, True, True, True, False, False, True]


def test_filter_is_bounded_and_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BYTES", 1 << 10)
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = phrases.filter_of(spark, phrases.summed(phrases.counted(docs, range(1, 2)), 1), 1)
    words = Words([lowered(t or "").encode() for t, _ in rows], ["und" if x is None else x for _, x in rows])
    assert len(found.bits) * 8 <= 1 << 14 and Filter(found.bits).has(words.hashes).all()
    assert [t.count() for t in frequent_phrases(docs, 2, 1)][1] > 100
