"""Fill-in-middle against plain string slicing."""

import hashlib
import random

import numpy as np
import pytest
from starloom.llm import fim
from starloom.llm.fim import PLAIN, PSM, SPM, Plan, Units, filled_in_middle, restored


def plainly(i, text, p="<P>", s="<S>", m="<M>"):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or p in text or s in text or m in text or h[2] % 100 >= 90:
        return n, PLAIN, None, None, text
    if h[3] % 100 < 20:
        return n, SPM, a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, PSM, a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    texts = [None, "", " ", "a", "é", "😀", "ab<P>c", "<S>", "x<M", "<P", "S><", "a\nb\n\nc", "́a", "日本語のテキスト", "<" * 40, "<S" * 30, ">" * 9, "é" * 100_000]
    texts += ["".join(r.choice("ab é😀\n<>PSM日") for _ in range(r.randrange(60))) for _ in range(300)]
    return [*enumerate(texts), (4, "é"), (None, "no id"), (None, None)]


def test_forms_and_cuts(spark, rows, monkeypatch):
    monkeypatch.setattr("starloom.llm.common.CHUNK_BYTES", 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS output", "2 AS c0", "3 AS `a.b`", "4 AS __text", "5 AS Form")
    found = filled_in_middle(docs)
    assert found.columns == ["doc_id", "text", "c0", "a.b", "__text", "output", "form", "n", "prefix_units", "middle_units"]
    got = found.withColumn("back", restored("output", "form")).collect()
    assert sorted((repr((r.doc_id, r.text)), r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got) == sorted((repr((i, t)), *plainly(i, t)) for i, t in rows)
    assert all(r.back == (r.text or "") and (r.c0, r["a.b"], r["__text"]) == (2, 3, 4) for r in got)
    assert {r.form for r in got} == {PLAIN, PSM, SPM}
    assert filled_in_middle(docs.where("false")).count() == 0


def test_cuts_do_not_depend_on_batches(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = filled_in_middle(docs.repartition(1)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, filled_in_middle(docs.repartition(7)).collect()))


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_units(unit):
    texts = ["", "ab  cd e\n\nf", "é è", " x", "\n", "日本 語", "no"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    units = Units(np.frombuffer(b"".join(raw), np.uint8), at, unit)
    for d, b in enumerate(raw):
        t, white = texts[d], b" \t\n\v\f\r"
        want = {
            "byte": list(range(len(b))),
            "char": [len(t[:k].encode()) for k in range(len(t))],
            "word": [k for k in range(len(b)) if k == 0 or b[k] in white and b[k - 1] not in white],
            "line": [k for k in range(len(b)) if k == 0 or b[k - 1 : k] == b"\n"],
        }[unit]
        assert units.count[d] == len(want)
        for k, place in enumerate([*want, len(b)]):
            assert units.place(np.full(len(raw), k))[d] - at[d] == place


def test_units_and_sentinels_of_ones_own(spark):
    plan = Plan("<|pre|>", "<|suf|>", "<|mid|>", plain=0, spm=50, seed="s", unit="word")
    docs = spark.range(200).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, id % 9), x -> concat('w', x))) AS text")
    got = filled_in_middle(docs, plan).withColumn("back", restored("output", "form", plan)).collect()
    assert all(r.back == r.text and r.n == r.doc_id % 9 + 1 for r in got) and {r.form for r in got} == {PSM, SPM}
    for r in got:
        assert all(part == "" or part[0] in "w " for part in r.output.replace("<|pre|>", "|").replace("<|suf|>", "|").replace("<|mid|>", "|").split("|"))


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "d"), ("aa", "b", "c"), ("abc", "b", "d")])
def test_sentinels_that_cannot_be_told(marks):
    with pytest.raises(ValueError):
        Plan(*marks)
