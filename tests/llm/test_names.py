"""Words and windows that were made to share a name do not."""

import random

import numpy as np
from starloom.llm.common import packed, span_names, word_bounds, word_hashes

PAIR = "abcdefghijklmnop", "mjerdhnqwx2z6bd3"


def hashes(text):
    data, _ = packed([text.encode()])
    return word_hashes(data, *word_bounds(data))


def test_long_words():
    assert len(set(hashes(" ".join(PAIR)).tolist())) == 2
    r = random.Random(1)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 80))) for _ in range(30_000)}
    words |= {"a" * n for n in range(1, 200)} | {"a" * n + "b" + "a" * 20 for n in range(60)}
    words = sorted(words)
    found = hashes(" ".join(words))
    assert len(set(found.tolist())) == len(words)
    assert (found[::-1] == hashes(" ".join(reversed(words)))).all()  # whatever stands around


def test_alternating_symbols():
    """Two symbols that differ by a multiple of 2 ** 44, in Thue and Morse's order and its reverse."""
    a, b = np.uint64(12345), np.uint64(12345 + (1 << 44))
    order = np.array([bin(i).count("1") % 2 for i in range(32)])
    both = np.concatenate([np.where(order == 0, a, b), np.where(order == 0, b, a)])
    one, two = span_names(both, np.array([0, 32]), np.array([32, 64]))
    assert one != two
    same = np.concatenate([both[:32], both[:32]])
    assert len(set(span_names(same, np.array([0, 32]), np.array([32, 64])).tolist())) == 1


def test_operators_keep_them_apart(spark):
    from starloom.llm.minhash import near_duplicates
    from starloom.llm.search import top_k
    from starloom.llm.substrings import without_repeats

    rest = " ".join(f"w{i}" for i in range(49))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t: (i, t, "en", "s", len(t))
    docs = spark.createDataFrame([row(1, f"{PAIR[0]} {rest}"), row(2, f"{PAIR[1]} {rest}"), row(3, f"{PAIR[0]} {rest}")], schema)
    assert {r.doc_id: r.n_removed for r in without_repeats(docs, parts=2).collect()} == {1: 0, 2: 0, 3: 50}
    single = spark.createDataFrame([row(1, PAIR[0]), row(2, PAIR[1])], schema)
    assert {r.id: r.component_id for r in near_duplicates(single, 3, 85).collect()} == {1: 1, 2: 2}
    found = top_k(single, single.select(single.doc_id.alias("query_id"), "text"), 10).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(1, 1), (2, 2)}


def test_languages_of_repeated_ids_are_learnt(spark):
    from starloom.llm.langid import languages

    r = random.Random(2)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(40))
    for same in (1, 7, 8, 9):
        rows = [(same, text("abcdeé"), "x", "s", 1) for _ in range(400)] + [(1000 + i, text("uvwxyz"), "y", "s", 1) for i in range(400)] + [(same, "ßßß ßßß " * 9, "z", "s", 1)] * 300
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = languages(docs).join(docs.select("doc_id", "lang").distinct(), "doc_id").where("doc_id >= 1000").select("lang", "lang_pred").distinct().collect()
        assert [tuple(x) for x in got] == [("y", "y")]
        assert {x.lang_pred for x in languages(docs).where(f"doc_id = {same}").collect()} == {"x", "z"}


def test_components(spark):
    from starloom.llm.minhash import Union, components

    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    sets = Union()
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    want = {x: sets.find(x) for a, b in edges if a != b for x in (a, b)}
    table = spark.createDataFrame(edges * 2, "a long, b long").repartition(5)
    for most in (1_000_000, 37):
        assert {x.node: x.root for x in components(table, most).collect()} == want
    assert components(table.where("false")).count() == 0
