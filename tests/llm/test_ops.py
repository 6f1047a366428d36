"""The text operators on small tables with odd rows, against brute force or the libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from starloom.llm.common import WordTable, held_out  # noqa: F401

W = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return W.findall((text or "").encode())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [None, "", "   ", "x", base, base, base.replace(" ", "  ", 3), prose(90) + "\n" + passage, passage + " " + prose(40), prose(30) + " " + passage, prose(49), base + " more", prose(2000), "é" * 60, "a " * 120, "a " * 130, "A b C", "a B c", prose(3), base[:200] + "zz" + base[200:]]
    out = [(i, t, ["en", "de", None][i % 3], "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[4], (None, base, "en", "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS id", "1 AS k1", "2 AS bands", "3 AS key", "4 AS spans", "5 AS n_words", "6 AS _id", "7 AS runs", "8 AS hit")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def last(i):
    return 1 << 62 if i is None else i


def multiset(found):
    return sorted(found, key=repr)


def test_substrings(docs, rows, empty):
    from starloom.llm.substrings import without_repeats

    seen = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            seen[key] = min(seen.get(key, 1 << 63), last(i))
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < last(i) for p in range(k, k + 50)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    for hot in (2000, 1):
        found = without_repeats(docs, hot=hot, parts=3)
        assert set(docs.columns) <= set(found.columns)
        got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert multiset(got) == multiset(want)
    assert without_repeats(empty, parts=2).count() == 0


def test_suffixes(docs, rows, empty):
    from starloom.llm.suffixes import without_repeated_bytes

    seen = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(seen.get(b[k : k + 50], 1 << 63), last(i))
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < last(i):
                m[k : k + 50] = b"\1" * 50
        want.append((i, len(b), sum(m), len(bytes(m).replace(b"\0", b" ").split()), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()))
    for hot in (2000, 1, 0):
        got = [tuple(r) for r in without_repeated_bytes(docs, hot=hot, parts=3).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
        assert multiset(got) == multiset(want)
    assert without_repeated_bytes(empty, parts=2).count() == 0


def test_suffix_sorter():
    from starloom.llm.suffixes import SuffixSorter

    r = np.random.default_rng(3)
    text = r.choice([97, 98], 700).astype(np.uint8)
    text[300:400] = text[100:200]
    s = SuffixSorter(np.concatenate([text, np.zeros(60, np.uint8)]), 50)
    at = s.sort(np.arange(640))
    raw = text.tobytes() + bytes(60)
    assert [raw[i : i + 50] for i in at] == sorted(raw[i : i + 50] for i in range(640))
    assert (s.equal_to_next(at) == [raw[i : i + 50] == raw[j : j + 50] for i, j in zip(at[:-1], at[1:], strict=True)]).all()


def test_minhash(docs, rows, empty):
    from starloom.llm.minhash import near_duplicates, representatives

    sets = []
    for _, t, *_ in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    ids = lambda g: [rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None]
    want = [(r[0], len(s), min(ids(g)) if s and ids(g) else r[0]) for r, s, g in zip(rows, sets, group, strict=True)]
    got = [tuple(r) for r in near_duplicates(docs, 3, 85).select("id", "n_shingles", "component_id").collect()]
    assert multiset(got) == multiset(want)
    kept = representatives(docs, 3, 85)
    assert kept.columns == docs.columns and kept.count() == sum(w[2] == w[0] for w in want)
    assert near_duplicates(empty, 3, 85).count() == 0


def test_min_max_bands_meet():
    from starloom.llm.minhash import bands, linked, shingle_sets  # noqa: F401

    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = [x if r.random() > 0.01 else "edit" for x in base]
    values, at = shingle_sets([" ".join(base).encode(), " ".join(near).encode(), " ".join(reversed(base)).encode()], 3)
    keys = bands(values, at)
    assert (keys[0] == keys[1]).any() and not (keys[0] == keys[2]).any()


def test_decontamination(spark, docs, rows, empty):
    from starloom.llm.decontaminate import contamination, decontaminated, folded

    passage = rows[7][1]
    items = [(1, passage), (10, "A b c"), (2, None), (3, "!!"), (None, "x"), (1, passage), (4, "é" * 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: folded((t or "").encode()).split()
    pats = {}
    for i, t in items:
        w = fold(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            pats.setdefault(tuple(w[k : k + m]), set()).add(i)
    want = []
    for i, t, *_ in rows:
        w, hit, found = fold(t), set(), set()
        for p, owners in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= owners
        want.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    for block in (1 << 24, 300):
        got = [(r[0], r[1], r[2], tuple(r[3])) for r in contamination(docs, bench, block_bytes=block).select("id", "n_words", "n_hit", "items").collect()]
        assert multiset(got) == multiset(want)
    assert decontaminated(docs, bench).count() == sum(not x[2] for x in want)
    assert contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert contamination(empty, bench).count() == 0


def test_language(spark, docs, empty):
    from starloom.llm.langid import automaton, fit, languages

    go = automaton([1, 2, 1, 1, 2])
    walk = lambda s: all((state := go[state].get(c) if state is not None else None) is not None for c in s) if (state := 0) == 0 else None
    assert walk([2, 1, 1]) and not walk([2, 2])
    en, de = "the quick brown fox is over the lazy dog and then some ", "der schnelle braune fuchs ist über dem faulen hund und so weiter "
    table = spark.createDataFrame([(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    model = fit(table)
    got = languages(table, model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0.5 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in languages(docs, model).collect() if r.doc_id is not None}
    assert odd[0].lang_pred == odd[1].lang_pred == "und" and odd[0].score == 0
    assert languages(empty).count() == 0 and languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).where("lang_pred <> 'und'").count() == 0


def test_language_held_out_accuracy(spark):
    from starloom.llm.langid import languages

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = languages(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").selectExpr("avg(CAST(lang = lang_pred AS DOUBLE)) AS a").first()
    assert r.a > 0.98


def test_quality(spark, docs, empty):
    from starloom.llm.quality import NAMES, boost, quality, statistics

    x = statistics([b"", b"One two. three\nfour", b"| | |"])
    assert x.shape == (3, len(NAMES)) and not x[0].any() and np.isfinite(x).all()
    r = np.random.default_rng(0)
    f = r.normal(size=(800, len(NAMES)))
    y = (f[:, 3] + f[:, 5] * f[:, 7] > 0).astype(float)
    assert ((boost(f, y).scores(f) > 0.5) == y).mean() > 0.9
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality(d, labels).where("held_out").join(labels, "doc_id").selectExpr("avg(CAST(predicted = quality AS DOUBLE)) AS a").first()
    assert got.a > 0.95
    none = labels.where("false")
    assert {r.score for r in quality(docs, none).collect()} == {0.5} and quality(empty, none).count() == 0


def test_pieces(docs, rows, empty):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from starloom.llm.pieces import Encoder, decoded, encoded, round_trip

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    alphabet = [*"aabcdet  thein▁\n\té日本🙂İß.,0x'", "  ", "    ", "the ", "ing", "<0x0A>", "</s>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(800)] + [" " * k for k in range(40)] + ["ab" * 90]
    e = Encoder.kept(path)
    ids = e.encode([t.encode() for t in texts])
    assert [x.tolist() for x in ids] == sp.encode(texts)
    assert [x.decode() for x in e.decode(ids)] == [sp.decode(x.tolist()) for x in ids]
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, *_), x in zip(rows, sp.encode([t or "" for _, t, *_ in rows]), strict=True)]
    got = [(x.doc_id, x.n_ids, x.ids_crc32) for x in round_trip(docs, path).collect()]
    assert multiset(got) == multiset(want)
    out = encoded(docs, path)
    assert "text" not in out.columns and {x.text for x in decoded(out, path).collect()} == {t or "" for _, t, *_ in rows}
    assert encoded(empty, path).count() == 0


def test_token_store(spark, docs, rows, empty, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from starloom.llm.tokens import WordEncoder, crc_shift, read_store, write_store

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(1)
    texts = ["".join(r.choice("aB'sß²ªµ İÉ\x85　\x1c０ǅéſ'Re\n\t1½€🙂ﬁЖ") if r.random() < 0.9 else r.choice(["<|endoftext|>", "'re"]) for _ in range(r.randrange(50))) for _ in range(600)]
    assert [x.tolist() for x in WordEncoder(path).encode([x.encode() for x in texts])] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    a, b = b"some bytes", b"and others" * 9
    assert int(crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
    folder = f"file://{tmp_path}/store"
    write_store(docs, path, folder, partitions=3)
    got = sorted((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in read_store(spark, folder).collect())
    ordered = sorted((-1 if i is None else i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in rows)
    assert [x[0] for x in got] == list(np.cumsum([0, *(x[2] for x in got[:-1])]))
    assert multiset((-1 if i is None else i, n, c) for _, i, n, c in got) == multiset((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ordered)
    assert [-1 if x[1] is None else x[1] for x in got] == [i for i, _ in ordered]
    chunk = next((tmp_path / "store/raw/kind=chunk").glob("*.parquet"))
    chunk.unlink()
    with pytest.raises(Exception, match="missing"):
        read_store(spark, folder).collect()
    write_store(empty, path, f"file://{tmp_path}/none", partitions=2)
    assert read_store(spark, f"file://{tmp_path}/none").count() == 0


def test_warc(spark, tmp_path):
    import io

    from starloom.llm import warc

    rows = [(1, "http://a/é x\r\n", "p"), (2, None, "p"), (3, "u", None), (4, "u", ""), (None, "u", "q"), (5, "u", "q" * 5000), (1, "again", "p"), (6, "u", "x\r\n\r\ny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS first_id")
    out = warc.warc_round_trip(spark, pages).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 1 << 62), last(i))
    want = [(i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if last(i) == first[h or ""] else "revisit", None if last(i) == first[h or ""] else first[h or ""]) for i, _, h in rows]
    assert multiset(tuple(r)[:5] for r in out) == multiset(want) and all(r.verified for r in out)
    assert {r.record_type for r in warc.warc_round_trip(spark, pages, 10**6).collect()} == {"response"}
    assert warc.warc_round_trip(spark, pages.where("false")).count() == 0
    data = warc.member(1, "u", b"payload", None, 4) + warc.member(2, "u", b"payload", 1, 4)
    for step in (1, 7, 1 << 20):
        assert [r["record_type"] for r in warc.records(io.BytesIO(data), step)] == ["response", "revisit"]
    plain = zlib.decompress(warc.member(1, "u", b"payload", None, 4), 31).replace(b"payload", b"pAyload")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(z.compress(plain) + z.flush())))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(data[:-9])))


def test_search(spark, docs, rows, empty):
    import math
    from collections import Counter

    from starloom.llm.decontaminate import folded
    from starloom.llm.search import top_k

    texts = [(i, Counter(folded((t or "").encode()).split())) for i, t, *_ in rows]
    length = [sum(c.values()) for _, c in texts]
    n, mean = len(texts), sum(length) / len(texts)
    df = Counter(w for _, c in texts for w in c)
    queries = [(1, rows[7][1]), (2, rows[18][1]), (3, None), (4, "nowhere")]
    want = {}
    for q, t in queries:
        scores = []
        for (i, c), size in zip(texts, length, strict=True):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(folded((t or "").encode()).split()) if w in c)
            if s:
                scores.append((-round(s, 9), last(i)))
        want[q] = sorted(scores)[:5]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for shard, block in ((1 << 24, 1 << 24), (2000, 200)):
        got = {q: [] for q, _ in queries}
        for r in sorted(top_k(docs, asked, 5, shard, block).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append((-round(r.score, 9), last(r.doc_id)))
        assert got == want
    assert top_k(empty, asked).count() == 0 and top_k(docs, asked.where("false")).count() == 0


def test_search_skips_blocks_and_shards():
    from starloom.llm.search import BLOCK, Shard, document_frequencies, leading, rounds, shard_row, term_counts  # noqa: F401

    r = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join([*r.choices(common, k=10), *(f"topic{d // BLOCK}x{r.randrange(20)}" for _ in range(15))]).encode() for d in range(BLOCK * 20)]
    shard = Shard(shard_row(5, list(range(len(texts))), texts), 45.0)
    spared = []
    for q in (3, 700, 1200):
        terms, _, _, _ = term_counts([texts[q]])
        idf = np.array([np.log(1 + len(texts) / (1 + c)) for c in np.diff(shard.term_entry)[np.searchsorted(shard.terms, terms)] * 3.0])
        ids, scores, skipped = shard.best(terms, idf, 10)
        want = {}
        for w, x in zip(terms, idf, strict=True):
            s = int(np.searchsorted(shard.terms, w))
            a, b = shard.entry_start[shard.term_entry[s]], shard.entry_start[shard.term_entry[s + 1]]
            for d, i in zip(shard.doc[a:b].tolist(), shard.impact[a:b].tolist(), strict=True):
                want[d] = want.get(d, 0.0) + x * i
        every = leading(shard.ids[list(want)], np.array(list(want.values())), 10)
        assert ids.tolist() == every[0].tolist() and np.allclose(scores, every[1]) and ids[0] == q
        again = shard.best(terms, idf, 10, float(scores[-1]))
        assert again[0].tolist() == ids.tolist() and again[1].tolist() == scores.tolist()
        assert again[2] >= skipped
        spared.append((skipped, again[2]))
        assert shard.best(terms, idf, 10, float(scores[0]) + 1e6)[2] == shard.blocks
    assert all(map(sum, zip(*spared, strict=True)))
    assert rounds({0: 36, 1: 9, 2: 3}) == [[2], [1], [0]] and rounds({0: 4}) == [[0]] and rounds({0: 5, 1: 1, 3: 1}) == [[3, 1, 0]] and rounds({}) == []


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_constructed_words_stay_apart(spark, size):
    """A Thue-Morse word and its complement, which polynomial hashes modulo 2**64 take for one."""
    from starloom.llm.common import packed, word_bounds, word_hashes
    from starloom.llm.minhash import near_duplicates
    from starloom.llm.search import top_k
    from starloom.llm.substrings import without_repeats

    a = thue_morse(size)
    b = a.translate(str.maketrans("ab", "ba"))
    data, _ = packed([f"{a} {b}".encode()])
    assert len(set(word_hashes(data, *word_bounds(data)).tolist())) == 2
    tail = " ".join(f"w{i}" for i in range(49))
    d = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert {r.n_removed for r in without_repeats(d, parts=2).collect()} == {0}
    e = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(e, 3, 85).select("component_id").collect()} == {1, 2}
    assert [tuple(r) for r in top_k(e, e.selectExpr("doc_id AS query_id", "text")).select("query_id", "doc_id").orderBy("query_id").collect()] == [(1, 1), (2, 2)]
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    from starloom.llm.pieces import Encoder
    from starloom.llm.tokens import WordEncoder

    path = P.path("piece_bpe_32k.model")
    assert [x.tolist() for x in Encoder.kept(path).encode([a.encode(), b.encode()])] == sentencepiece.SentencePieceProcessor(model_file=path).encode([a, b])
    path = P.path("word_bpe_49k.json")
    assert [x.tolist() for x in WordEncoder(path).encode([a.encode(), b.encode()])] == [x.ids for x in Tokenizer.from_file(path).encode_batch([a, b], add_special_tokens=False)]


def test_word_table_keeps_colliding_words_apart(monkeypatch):
    from starloom.llm import common

    monkeypatch.setattr(common, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    table = WordTable(lambda words: [np.frombuffer(w.ljust(8, b"-")[:8], np.uint32).tobytes() for w in words])
    words = [b"ab", b"cd", b"ab", b"xyz", b"zyx", b"cd", b"q" * 70, b"r" * 70]
    data, _ = common.packed([b" ".join(words)])
    for _ in range(2):
        start, count = table.lookup(data, *common.word_bounds(data))
        assert [table.ids[s : s + n].tobytes() for s, n in zip(start, count, strict=True)] == [w.ljust(8, b"-")[:8] for w in words]


def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    import corpus_pipeline

    r = random.Random(4)
    en = [w + s for w in "the of and that with from have this will your which their about would there other into could than".split() for s in ("", "s", "ing", "ed", "er", "ly")]
    prose = lambda n: " ".join(r.choice(en) for _ in range(n))
    base, passage, item = prose(150), prose(60), prose(12)
    texts = [base, base, base.replace(" ", "  ", 2), prose(80) + " " + passage, passage + " " + prose(70), prose(40) + " " + item + " " + prose(30), "12345 !!", None, *(prose(60) for _ in range(12))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: list(x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {0: texts[0], 3: texts[3], 4: texts[4][len(passage) + 1 :], **{i: texts[i] for i in range(8, 20)}}
    assert got == {i: sp.encode(t) for i, t in want.items()}


def test_search_of_many_queries_at_once(monkeypatch):
    """Long queries share their frequent words: these go through a matrix, so few postings are unfolded a query; ties by nine digits."""
    from starloom.llm import search
    from starloom.llm.search import Asked, Shard, leading, shard_row, term_counts

    r = random.Random(5)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join([*r.sample(common, 120), f"rare{r.randrange(400)}", f"rare{r.randrange(400)}"]).encode() for _ in range(1500)]
    shard, parts = Shard(shard_row(5, list(range(len(texts))), texts), 122.0), [np.unique(term_counts([x])[0]) for x in texts[:300]]
    idf = dict(zip(shard.terms.tolist(), np.log(1 + (1500 - shard.counts + 0.5) / (shard.counts + 0.5)).tolist(), strict=True))
    weights = [np.array([idf[t] for t in x.tolist()]) for x in parts]
    first = np.append(0, np.cumsum([len(x) for x in parts]))
    asked = Asked(np.concatenate(parts), np.concatenate(weights), first, np.zeros(len(parts)))
    shard.weigh(asked)
    whole = np.zeros((len(parts), len(texts)))
    at = dict(zip(shard.terms.tolist(), range(len(shard.terms)), strict=True))
    for q, (terms, weight) in enumerate(zip(parts, weights, strict=True)):
        for t, w in zip(terms.tolist(), weight.tolist(), strict=True):
            a, b = shard.start[at[t]], shard.start[at[t] + 1]
            whole[q, shard.doc[a:b]] += w * shard.impact[a:b]
    unfolded, plain = [], search.spread
    monkeypatch.setattr(search, "spread", lambda start, count: unfolded.append(int(count.sum())) or plain(start, count))
    kth = np.sort(whole, axis=1)[:, -10]
    for floors in (kth, np.zeros(len(parts))):
        found, looked = shard.answers(asked, 0, len(parts), 10, floors)
        assert looked <= shard.blocks * len(parts)
        for q in range(len(parts)):
            ids, scores = leading(*found[q], 10)
            want = leading(shard.ids, whole[q], 10)
            assert ids.tolist() == want[0].tolist() and np.allclose(scores, want[1], rtol=1e-12)
        if floors is kth:
            assert 20 * sum(unfolded) < shard.counts[shard.slot[asked.place]].sum()  # what a query at a time would unfold
    assert not shard.answers(asked, 0, len(parts), 10, kth + 1e6)[0]
    assert leading(np.array([7, 3]), np.array([1.0 + 1e-12, 1.0]), 2)[0].tolist() == [3, 7]
