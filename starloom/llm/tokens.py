"""Token ids in a content-addressed store.

Texts are encoded with the tokenizers library. Each document's stream of ids is cut where a
rolling hash of the last WINDOW ids has MASK bits of zeros, so equal runs of ids give equal
chunks wherever they stand. A chunk's name is the SHA-256 of its bytes; each is stored once. A
document's recipe lists its chunks; the manifest has, per file, a Merkle root over the recipes
in it, and `read_store` checks every chunk's name, every recipe's length and every root.

Format. chunks/: rows (name binary, ids binary: 16- or 32-bit little-endian words, zstd). recipes/: files in ascending
order of id, rows (part, doc_id, n_tokens, names binary: 32 bytes each, counts binary: 32-bit
words). manifest/: rows (part, docs, n_tokens, start, root binary), one per part.

Defined cases: null or empty text is the end id alone; a null doc_id sorts first and stays null;
rows that repeat stay separate, in the order of their text's hash; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, WordTable, binaries, chunks, mix, packed, shared_dir, word_bounds

WINDOW, MASK_BITS, LEAST, MOST = 16, 9, 64, 4096
END_ID = 2
#: Parts of pieces whose ids a worker keeps, besides the table of whole pieces.
CACHE_PARTS = 400_000
_GEAR = mix(np.arange(1, (1 << 16) + 1, dtype=U64) * U64(0xA0761D6478BD642F))
#: How the tokenizer's pattern splits lower-case text of the first 256 characters.
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]*")
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0D]] = True


_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes each distinct piece between white space once, and each distinct part of pieces once.

    Right wherever the tokenizer drops white space and never joins across it: its normaliser
    collapses it, its pre-tokenizer matches no token with it. A piece is what stands between
    spaces, tabs and line ends. Pieces within Latin-1 are lower-cased and split as the
    tokenizer's own pattern does, so that one part serves every case and punctuation; any
    other piece, and one that may hold a special token, goes to the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.table = WordTable(self.learn)

    @classmethod
    def kept(cls, path: str) -> "WordEncoder":
        """The one of this worker process, so that its tasks share what it has learnt."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for i in range(0, len(texts), 20_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]

    def several(self, parts: list[str]) -> list[bytes]:
        """Of parts that each become one word of the model, 256 to a call: the word ends tell them apart."""
        out = []
        for i in range(0, len(parts), 256):
            some = parts[i : i + 256]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(some) else self.whole(some)
        return out

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        texts = [x.decode() for x in pieces]
        split = [_PARTS.findall(w.lower()) if _PLAIN.fullmatch(w) and "<|" not in w else None for w in texts]
        new = list({x for parts in split if parts for x in parts if x not in self.parts})
        if len(self.parts) + len(new) > CACHE_PARTS:
            self.parts = {}
            new = list({x for parts in split if parts for x in parts})
        self.parts.update(zip(new, self.several(new), strict=True))
        rest = iter(self.whole([w for w, x in zip(texts, split, strict=True) if x is None]))
        get = self.parts.__getitem__
        return [next(rest) if x is None else get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in split]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data, at = packed(texts)
        starts, ends = word_bounds(data, _BREAK)
        start, count = self.table.lookup(data, starts, ends)
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return np.split(self.table.flat(start, count), total[np.searchsorted(starts, at[1:-1])]) if texts else []


def cuts(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a stream: content-defined, LEAST to MOST ids long (the last may be shorter)."""
    n = len(ids)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    with np.errstate(over="ignore"):
        gear = _GEAR[ids & np.uint32(0xFFFF)] ^ (ids >> np.uint32(16)).astype(U64)
        roll, step = gear.copy(), 1
        while step < WINDOW:  # sum of the last WINDOW values, each shifted by its age
            more = roll.copy()
            more[step:] += roll[:-step] << U64(step)
            roll, step = more, 2 * step
    found = np.flatnonzero(roll >> U64(64 - MASK_BITS) == 0) + 1
    ends, last = [], 0
    for e in [*found.tolist(), n]:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST and e < n:
            ends.append(e)
            last = e
    if last < n:
        ends.append(n)
    return np.array(ends, np.int64)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaf and node are hashed under different prefixes."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"\0").digest()


def leaf(doc_id: int | None, n: int, names: bytes, counts: bytes) -> bytes:
    return f"{doc_id}:{n}:".encode() + names + b":" + counts


KINDS = "kind string, key binary, doc_id long, k long, n_tokens long, names binary, counts binary, ids binary, width int"
_KINDS = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("k", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("width", pa.int32())])
#: Names that a task remembers so as not to send a chunk twice; after so many it forgets all, which costs only traffic.
SEEN_NAMES = 500_000
#: What a part of the store holds of the texts, and the least that a document counts for; so the recipes of a part, which a task holds for its Merkle root, are 200,000 at most.
PART_BYTES, DOC_BYTES = 64 << 20, 320


def packed_ids(ids: np.ndarray) -> tuple[bytes, int]:
    import zstandard

    width = 4 if len(ids) and ids.max() > 0xFFFF else 2
    return zstandard.ZstdCompressor(level=1).compress(ids.astype(f"<u{width}").tobytes()), width


def unpacked_ids(data: bytes, width: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), f"<u{width}").astype(np.uint32)


def cut_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of two kinds: `recipe`, one per document, and `chunk`, one per chunk that its task has not sent yet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = WordEncoder.kept(path), set()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = binaries(batch.column("text"))
            doc_ids, keys = batch.column("doc_id").to_pylist(), batch.column("k").to_pylist()
            for i, j in chunks([len(x) for x in texts]):
                rows = []
                for at, ids in enumerate(encoder.encode(texts[i:j]), i):
                    ids = np.concatenate([ids, end])
                    ends = cuts(ids)
                    raw, names, last = ids.tobytes(), [], 0
                    for e in ends.tolist():
                        name = hashlib.sha256(raw[4 * last : 4 * e]).digest()
                        names.append(name)
                        if name not in seen:
                            if len(seen) >= SEEN_NAMES:
                                seen.clear()
                            seen.add(name)
                            data, width = packed_ids(ids[last:e])
                            rows.append({"kind": "chunk", "key": name, "ids": data, "width": width})
                        last = e
                    rows.append({"kind": "recipe", "key": hashlib.sha256(f"{doc_ids[at]}".encode()).digest(), "doc_id": doc_ids[at], "k": keys[at], "n_tokens": len(ids), "names": b"".join(names), "counts": np.diff(ends, prepend=0).astype("<u4").tobytes()})
                yield pa.RecordBatch.from_pylist(rows, _KINDS)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k"))
    return source.mapInArrow(work, KINDS)


def store_parts(docs: DataFrame, least: int = 12) -> int:
    """How many parts hold about PART_BYTES of text each, a document counting as DOC_BYTES at least."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    total = docs.agg(F.sum(F.greatest(size, F.lit(DOC_BYTES)))).first()[0] or 0
    return max(least, -(-total // PART_BYTES))


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encodes, cuts and writes chunks/, recipes/ and manifest/ below `folder`.

    Ids are shuffled once, by chunk name, and written once; of equal names, which stand together
    in the order of the files, the first stays. The recipes (36 bytes a chunk) are then dealt by
    ranges of doc_id and each part is written in ascending order. The number of parts follows the
    size of the texts.
    """
    spark = docs.sparkSession
    parts = partitions or store_parts(docs)
    nth = F.row_number().over(Window.partitionBy("kind", "key").orderBy("width"))
    pieces = cut_documents(docs, path, end_id).repartition(parts, "key").withColumn("nth", nth)
    pieces.where("kind = 'recipe' or nth = 1").drop("nth").write.partitionBy("kind").option("compression", "none").parquet(f"{folder}/raw")
    raw = spark.read.schema("kind string, " + KINDS.split(", ", 1)[1]).parquet(f"{folder}/raw").where("kind = 'recipe'")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            offset = at + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
            at += int(n.sum())
            leaves = [hashlib.sha256(leaf(*x)).digest() for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "names", "counts")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(offset, pa.int64()), batch.column("names"), batch.column("counts"), pa.array(leaves, pa.binary())], names=["part", "doc_id", "n_tokens", "part_offset", "names", "counts", "leaf"])

    ordered = raw.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "k").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "k").select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "names", "counts")
    ordered.mapInArrow(place, RECIPE).write.option("compression", "zstd").parquet(f"{folder}/recipes")

    def root(key, table):
        order = np.argsort(table.column("part_offset").to_numpy())
        leaves = table.column("leaf").to_pylist()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "docs": [len(leaves)], "n_tokens": [int(table.column("n_tokens").to_numpy().sum())], "root": pa.array([merkle([leaves[i] for i in order])], pa.binary())})

    roots = spark.read.schema(RECIPE).parquet(f"{folder}/recipes").select("part", "part_offset", "n_tokens", "leaf").groupBy("part").applyInArrow(root, "part int, docs long, n_tokens long, root binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    roots.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/manifest")


RECIPE = "part int, doc_id long, n_tokens long, part_offset long, names binary, counts binary, leaf binary"
MANIFEST = "part int, docs long, n_tokens long, root binary, start long"


def _shift_tables(bits: int = 40) -> list[np.ndarray]:
    """For each k: what 2**k zero bytes after a message do to its CRC-32, as four 256-entry tables."""
    step = np.array([1 << (i - 1) if i else 0xEDB88320 for i in range(32)], np.uint32)  # one zero bit, by input bit
    apply = lambda m, v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(32, dtype=np.uint32)) & 1, m, 0).astype(np.uint32), axis=1)
    for _ in range(3):
        step = apply(step, step)
    tables = []
    for _ in range(bits):
        tables.append(np.stack([apply(step, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)]))
        step = apply(step, step)
    return tables


_TABLES: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s of messages, each as it counts in the CRC of the message with n_bytes more behind it (xor of all parts gives the whole)."""
    if not _TABLES:
        _TABLES.extend(_shift_tables())
    crc, k = crc.astype(np.uint32), 0
    while (n_bytes >> k).any():
        hit = (n_bytes >> k) & 1 == 1
        c, t = crc[hit], _TABLES[k]
        crc[hit] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
        k += 1
    return crc


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks.

    Every chunk is read, unpacked, checked against its name and given its CRC; recipes bring
    the CRCs together by xor, so no ids are shuffled. A part whose Merkle root differs, a
    missing chunk or a wrong length raises.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, n = [], []
            for name, data, width in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "width")), strict=True):
                raw = unpacked_ids(data, width).tobytes()
                if hashlib.sha256(raw).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not have the content of its name")
                crc.append(zlib.crc32(raw))
                n.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["name", "crc", "n"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = batch.column("names").to_pylist(), [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("counts").to_pylist()]
            if any(hashlib.sha256(leaf(*x)).digest() != y for *x, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "names", "counts", "leaf")), strict=True)):
                raise ValueError("a recipe differs from its leaf")
            each = [len(x) for x in counts]
            rows = np.repeat(np.arange(len(each)), each)
            after = [4 * (x.sum() - np.cumsum(x)) for x in counts]
            take = lambda c: pa.array(np.asarray(batch.column(c).to_numpy(zero_copy_only=False))[rows])
            yield pa.RecordBatch.from_arrays([take("part").cast(pa.int32()), take("part_offset"), pa.array([s[32 * i : 32 * i + 32] for s, m in zip(names, each, strict=True) for i in range(m)], pa.binary()), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*after, np.zeros(0, np.int64)]), pa.int64())], names=["part", "part_offset", "name", "want", "after"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, after, n, want = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "after", "n", "want"))
            if batch.column("crc").null_count or (n != want).any():
                raise ValueError("a recipe names a chunk that is missing or of another length")
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("part_offset"), pa.array(crc_shift(crc, after).astype(np.int64)), batch.column("n")], names=["part", "part_offset", "crc", "n"])

    def proven(key, table):
        order = np.argsort(table.column("part_offset").to_numpy())
        leaves = table.column("leaf").to_pylist()
        if merkle([leaves[i] for i in order]) != table.column("root")[0].as_py():
            raise ValueError(f"the Merkle root of part {key[0].as_py()} differs")
        return table.select(["part", "part_offset", "doc_id", "n_tokens", "start"])

    chunk = spark.read.schema("kind string, " + KINDS.split(", ", 1)[1]).parquet(f"{folder}/raw").where("kind = 'chunk'").select("key", "ids", "width").mapInArrow(check, "name binary, crc long, n long")
    recipes = spark.read.schema(RECIPE).parquet(f"{folder}/recipes")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("part", "root", "start")
    rows = recipes.mapInArrow(listed, "part int, part_offset long, name binary, want long, after long")
    sums = rows.join(chunk, "name", "left").select("part", "part_offset", "crc", "after", "n", "want").mapInArrow(shift, "part int, part_offset long, crc long, n long").groupBy("part", "part_offset").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("read"), F.count("*").alias("n_chunks"))
    heads = recipes.select("part", "part_offset", "doc_id", "n_tokens", "leaf").join(manifest, "part", "left").groupBy("part").applyInArrow(proven, "part int, part_offset long, doc_id long, n_tokens long, start long")
    whole = heads.join(sums, ["part", "part_offset"], "left")
    return whole.select("doc_id", (F.col("start") + F.col("part_offset")).alias("start"), F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks do not sum to its length")).cast("long")).alias("n_tokens"), F.col("ids_crc32"), "n_chunks")


def token_round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    folder = shared_dir(spark)
    write_store(docs, path, folder, end_id)
    return read_store(spark, folder)
