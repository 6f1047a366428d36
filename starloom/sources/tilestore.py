"""Tile files as a Spark data source: executors write and read them, each on its own; the driver sees folders and counts.

    spark.dataSource.register(TileSource)
    tiles.write.format("starloom_tiles").mode("append").save(root)       # ord, pix, format, content
    spark.read.format("starloom_tiles").option("ord", 3).load(root)      # ... and length

Files lie as root/Norder<ord>/Dir<10000s>/Npix<pix>.<format>. A task writes below root/_pending and moves its
files to their places when it has written them all, so a file is whole or not there, and what a failed
task has written goes with it. If another task fails for good, the lists that finished tasks have left say which of
their files to take back. A tile that is written again replaces the one there. Roots are paths or
URIs that Arrow's file systems open (local or mounted paths, hdfs, s3); `tiles.read_tiles` reads any that Spark can.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "starloom_tiles"
SCHEMA = "ord int, pix bigint, format string, length bigint, content binary"
FOLDER = 10_000
#: Bytes of tiles in a batch of the reader.
BATCH_BYTES = 8 << 20
_FILE = re.compile(r"Npix(\d+)\.(\w+)$")


def opened(root: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(root)
    return where, path.rstrip("/")


def place(order: int, pix: int, kind: str) -> str:
    return f"Norder{order}/Dir{pix // FOLDER * FOLDER}/Npix{pix}.{kind}"


def listed(where: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return where.get_file_info(fs.FileSelector(path, allow_not_found=True))


@dataclass
class Folder(InputPartition):
    order: int
    path: str


class TileReader(DataSourceReader):
    """A partition for each Dir folder, which has at most FOLDER tiles of a format; only folders are listed on the driver."""

    def __init__(self, options):
        self.root, order, kind = options["path"], options.get("ord"), options.get("format")
        self.order, self.kind = None if order is None else int(order), kind

    def partitions(self) -> list[Folder]:
        where, root = opened(self.root)
        orders = [(int(m[1]), x.path) for x in listed(where, root) if x.type == fs.FileType.Directory and (m := re.fullmatch(r"Norder(\d+)", x.base_name))]
        found = [Folder(k, x.path) for k, path in sorted(orders) if self.order in (None, k) for x in listed(where, path) if x.type == fs.FileType.Directory]
        return found or [Folder(-1, "")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        if partition.order < 0:
            return
        where, _ = opened(self.root)
        rows, size = [], 0
        for x in sorted(listed(where, partition.path), key=lambda x: x.path):
            m = _FILE.search(x.base_name)
            if not m or self.kind not in (None, m[2]):
                continue
            with where.open_input_stream(x.path) as f:
                content = f.read()
            rows.append((partition.order, int(m[1]), m[2], len(content), content))
            size += len(content)
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = {"ord": pa.int32(), "pix": pa.int64(), "format": pa.string(), "length": pa.int64(), "content": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


@dataclass
class Moved(WriterCommitMessage):
    """How many tiles a task has put in place; which, is in the list that bears its name."""

    task: str
    tiles: int


class TileWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        where, root = opened(self.root)
        task = uuid.uuid4().hex
        pending, places, moved = f"{root}/_pending/{task}", [], 0
        where.create_dir(pending)
        try:
            for batch in iterator:
                for order, pix, kind, content in zip(*(batch.column(c).to_pylist() for c in ("ord", "pix", "format", "content")), strict=True):
                    if order is None or pix is None or order < 0 or pix < 0 or not re.fullmatch(r"\w+", kind or ""):
                        raise ValueError(f"no tile has order {order}, index {pix} and format {kind}")
                    with where.open_output_stream(f"{pending}/{len(places)}") as f:
                        f.write(content or b"")
                    places.append(place(order, pix, kind))
            with where.open_output_stream(f"{pending}.list") as f:
                f.write("\n".join(places).encode())
            for folder in sorted({p.rpartition("/")[0] for p in places}):
                where.create_dir(f"{root}/{folder}")
            for i, p in enumerate(places):
                where.move(f"{pending}/{i}", f"{root}/{p}")
                moved += 1
            where.delete_dir(pending)
        except BaseException:
            for p in places[:moved]:
                where.delete_file(f"{root}/{p}")
            where.delete_dir(pending)
            raise
        return Moved(task, len(places))

    def commit(self, messages: list[Moved | None]) -> None:
        where, root = opened(self.root)
        if listed(where, f"{root}/_pending"):
            where.delete_dir(f"{root}/_pending")

    def abort(self, messages: list[Moved | None]) -> None:
        """Takes back the files of tasks that had finished."""
        where, root = opened(self.root)
        for m in messages:
            if m is not None:
                with where.open_input_stream(f"{root}/_pending/{m.task}.list") as f:
                    for p in filter(None, f.read().decode().split("\n")):
                        if where.get_file_info(f"{root}/{p}").type == fs.FileType.File:
                            where.delete_file(f"{root}/{p}")
        if listed(where, f"{root}/_pending"):
            where.delete_dir(f"{root}/_pending")


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)

    def writer(self, schema, overwrite: bool) -> TileWriter:
        if overwrite:
            raise ValueError("tiles are added or replaced one by one: use mode append")
        return TileWriter(self.options)


def save_tiles(tiles: DataFrame, root: str) -> None:
    """tiles: ord, pix, format, content. A task writes whole Dir folders, so no two tasks make files in one."""
    tiles.sparkSession.dataSource.register(TileSource)
    dealt = tiles.select(F.col("ord").cast("int"), F.col("pix").cast("long"), "format", F.lit(0).cast("long").alias("length"), F.col("content").cast("binary"))
    dealt.repartition("ord", F.floor(F.col("pix") / FOLDER)).write.format(NAME).mode("append").save(root)


def load_tiles(spark: SparkSession, root: str, order: int | None = None) -> DataFrame:
    """(ord, pix, format, length, content); with an order only its folders are listed."""
    spark.dataSource.register(TileSource)
    reader = spark.read.format(NAME)
    return (reader if order is None else reader.option("ord", order)).load(root)
