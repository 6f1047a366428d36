"""WARC archives: a writer with payload de-duplication and a sequential reader.

Writer: one gzip member per record, payload and block digests, a `revisit` record for every
payload that a page with a smaller id has already stored. Reader: a file is taken front to
back through incremental zlib, members are told apart by the decompressor's own end mark,
records are framed by Content-Length and each digest is computed again.

Defined cases: null html is an empty payload; null url is an empty target; a null page id
sorts after all others and stays null; rows that repeat the smallest id with the same payload
are all responses; an empty table gives no archive and no row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("verified", pa.bool_()),
    ]
)


class WarcError(ValueError):
    """The archive breaks the format or a digest differs."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def head(fields: list[tuple[str, object]], first: str) -> bytes:
    return END.join([first.encode(), *(f"{k}: {v}".encode() for k, v in fields)]) + END + END


def one_line(text: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in text)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int) -> bytes:
    """One record as a complete gzip member."""
    sha = digest(payload)
    block = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    fields: list[tuple[str, object]] = [("WARC-Type", "response" if refers_to is None else "revisit")]
    if page_id is not None:
        fields.append(("WARC-Page-ID", page_id))
    fields += [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url or "")), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", refers_to)]
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head(fields, "WARC/1.1") + block + END + END) + deflate.flush()


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The content of each gzip member in turn; memory holds one record and one read."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(read_bytes)
        if not data:
            if parts:
                raise WarcError("the archive ends within a member")
            return
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as e:
            raise WarcError(f"bad gzip member: {e}") from e
        rest = b""
        if inflate.eof:
            yield b"".join(parts)
            rest, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []


def fields_of(lines: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = lines.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def records(stream, read_bytes: int = READ_BYTES) -> Iterator[dict]:
    """Every record of an archive, checked: framing, block digest, payload digest."""
    for data in members(stream, read_bytes):
        top, mark, body = data.partition(END + END)
        version, named = fields_of(top)
        if not mark or not version.startswith("WARC/"):
            raise WarcError("no record header")
        n = int(named["content-length"])
        block = body[:n]
        if len(block) != n or body[n:] != END + END:
            raise WarcError("the block does not have the length that the header states")
        if named.get("warc-block-digest", "").removeprefix("sha1:") != digest(block):
            raise WarcError("block digest differs")
        http, _, payload = block.partition(END + END)
        _, http_fields = fields_of(http)
        kind, sha = named["warc-type"], named["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (digest(payload) != sha or len(payload) != int(http_fields["content-length"])):
            raise WarcError("payload digest differs")
        whole = lambda k: int(named[k]) if k in named else None
        yield {
            "page_id": whole("warc-page-id"),
            "payload_bytes": int(http_fields["content-length"]),
            "payload_digest": sha,
            "record_type": kind,
            "refers_to": whole("warc-refers-to-page-id"),
            "url": named["warc-target-uri"],
            "verified": True,
            "payload": payload if kind == "response" else None,
        }


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, level: int = 4, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives below `folder` (a path or URI that all executors can write); returns the manifest.

    Only ids and digests are grouped, with partial aggregation, so a payload that a third of
    all pages share costs one row per task. Pages are shuffled once, by id, to meet their class.
    A file gets its name in one rename after it is complete; a repeated task writes another.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ids = page.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n"))
    first = ids.where(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    again = ids.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).where(F.col("first_id").isNotNull()).select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "first_id").distinct()
    marked = page.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha") == F.col("again_sha")), "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "first_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, made, count, size = None, [], 0, 0

        def close() -> None:
            out.close()
            store.move(temp, name)
            made.append({"file": name, "records": count, "bytes": size})

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "html", "first_id")]
            for page_id, url, html, first_id in zip(*columns, strict=True):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    temp, count, size = f"{name}.part", 0, 0
                    out = store.open_output_stream(temp, compression=None)
                data = member(page_id, url, html, first_id, level)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, MANIFEST)

    return marked.mapInArrow(write, "file string, records long, bytes long")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads each archive of the manifest front to back; a damaged record raises WarcError."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(name, compression=None) as stream:
                    rows = []
                    for r in records(stream):
                        r.pop("payload")
                        rows.append(r)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    return manifest.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, verified boolean")


def warc_round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write, then read back: the manifest is a written table, so each archive is made once."""
    base = shared_dir(spark)
    path = f"{base}/manifest"
    write_warc(pages, f"{base}/warc" if "://" in base else f"file://{base}/warc", min_revisit_bytes).write.parquet(path)
    manifest = spark.read.parquet(path)
    files = max(1, manifest.count())
    return read_warc(manifest.repartition(min(files, 10_000), "file"), f"{base}/warc" if "://" in base else f"file://{base}/warc")
