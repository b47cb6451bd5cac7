"""Sources and sinks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagflow.storage import cut, fresh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strided_range(spark: SparkSession, first: int, last: int, step: int = 1, name: str = "tag", parts: int | None = None) -> DataFrame:
    """Integers from ``first``, below ``last`` (S3, S4, C14: ``parts`` is the grain)."""
    return spark.range(first, last, step, parts).withColumnRenamed("id", name)


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The lines of each text, numbered from 0."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their file and block, the place in bytes where it begins.

    Spark splits the files into blocks of spark.sql.files.maxPartitionBytes at most; a line that crosses their border is
    whole and belongs to the block that it begins in.
    """
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def blocks(spark: SparkSession, path: str, size: int = 2 << 20) -> DataFrame:
    """Binary files in blocks of ``size`` bytes: file, block, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cuts = range(0, max(1, len(content)), size)
                data = [content[at : at + size] for at in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(data)), pa.array(range(len(data)), pa.int64()), pa.array(data, pa.binary())], names=["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block long, data binary")


def jdbc_items(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The items of a SQL table (S8); partitioning options split the read."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_jdbc(items: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Items put through to a SQL table (S8); in a stream call it from ``foreachBatch``."""
    items.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


class SqlItems:
    """An item collection kept in a SQL table, put through and read on demand (S8). Keys are the table's business to check."""

    def __init__(self, spark: SparkSession, url: str, name: str, keys: list[str], **options: str):
        self.spark, self.url, self.name, self.keys, self.options = spark, url, name, keys, options

    def items(self) -> DataFrame:
        return jdbc_items(self.spark, self.url, self.name, **self.options)

    def put(self, items: DataFrame) -> None:
        write_jdbc(items, self.url, self.name, **self.options)

    def get(self, *key):
        """One item by its key; the database looks for it. A missing one is a KeyError."""
        cond = F.lit(True)
        for name, value in zip(self.keys, key, strict=True):
            cond = cond & (F.col(name) == F.lit(value))
        row = self.items().where(cond).first()
        if row is None:
            raise KeyError(key)
        return row

    def erase(self, keys: DataFrame) -> None:
        """Drops the items of these keys: the others are kept aside, then put anew."""
        rest = cut(self.items().join(keys.select(*self.keys).distinct(), self.keys, "left_anti"))
        write_jdbc(rest, self.url, self.name, "overwrite", truncate="true", **self.options)

    def clear(self) -> None:
        write_jdbc(self.items().limit(0), self.url, self.name, "overwrite", truncate="true", **self.options)


def stored_items(items: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Items written through to a Parquet table and read from it: the table form of S8."""
    items.write.mode(mode).parquet(path)
    return items.sparkSession.read.schema(items.schema).parquet(path)


#: Fixed values of the chunker (Q20, F8): a cut is where the hash of the last WINDOW bytes is 0 under CUT_MASK.
WINDOW, CUT_MASK, MOST_CHUNK = 32, 0xFFF, 60 << 10


def chunk_ends(data: bytes, most: int = MOST_CHUNK) -> list[int]:
    """Ends of the content-defined chunks of ``data``, none longer than ``most``; cuts depend on the WINDOW bytes before them alone."""
    values, ends, done = np.frombuffer(data, np.uint8).astype(np.uint32), [], 0
    n, factor = len(values) - WINDOW + 1, 1
    rolled = np.zeros(max(n, 0), np.uint32)
    for k in range(WINDOW - 1, -1, -1):
        if n > 0:
            rolled += (values[k : k + n] + np.uint32(1)) * np.uint32(factor)
        factor = factor * 0x01000193 & 0xFFFFFFFF
    rolled ^= rolled >> np.uint32(15)
    for end in [*(np.flatnonzero((rolled & np.uint32(CUT_MASK)) == 0) + WINDOW).tolist(), len(data)]:
        while end - done > most:
            done += most
            ends.append(done)
        if end > done:
            done = end
            ends.append(done)
    return ends


def content_chunks(blocks: DataFrame, block: str = "block", data: str = "data") -> DataFrame:
    """block, item and data (binary) of the content-defined chunks of each block (F8): a narrow map. Null and empty blocks give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                ends = chunk_ends(content or b"")
                parts = [content[x:y] for x, y in zip([0, *ends], ends)]  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(parts), name.type), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["block", "item", "data"])

    named = blocks.select(F.col(block).alias("block"), F.col(data).cast("binary").alias("data"))
    return named.mapInArrow(run, f"block {dict(named.dtypes)['block']}, item long, data binary")


def archive(chunks: DataFrame, order: list[str], data: str = "data") -> DataFrame:
    """Each chunk in order with its fingerprint; the first of equal ones carries the data, which ``deflated`` compresses.

    First occurrences are found by an aggregate that carries their data, so equal chunks meet combined; of the others
    only places and fingerprints travel. ``order`` names each chunk.
    """
    marked = chunks.withColumn("_fingerprint", F.sha1(data))
    place = F.struct(*order)
    first = marked.groupBy("_fingerprint").agg(F.min(place).alias("_first"), F.min_by(data, place).alias("payload"))
    first = first.select(*(F.col(f"_first.{c}").alias(c) for c in order), F.col("_fingerprint").alias("fingerprint"), F.lit(True).alias("is_first"), "payload")
    taken = first.select(*(F.col(c).alias(f"_f_{c}") for c in order))
    others = marked.join(taken, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in order], "left_anti")
    nothing = F.lit(None).cast(first.schema["payload"].dataType)
    return first.unionByName(others.select(*order, F.col("_fingerprint").alias("fingerprint"), F.lit(False).alias("is_first"), nothing.alias("payload")))


def deflated(rows: DataFrame, column: str = "payload") -> DataFrame:
    """``column`` compressed by zlib where it isn't null."""
    @F.pandas_udf("binary")
    def squeeze(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else zlib.compress(bytes(b)))

    return rows.withColumn(column, squeeze(F.col(column).cast("binary")))


def write_image(pixels: DataFrame, path: str, width: int, height: int) -> None:
    """Pixels (x, y, r, g, b) as a plain-text image (P3) in text files (S14): end to end in their order they are the image."""
    image_rows(pixels, width, height).repartitionByRange("y").sortWithinPartitions("y").select("line").write.text(path)


def image_rows(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """y and line: a line of numbers for each row of pixels, behind the header at -1."""
    rows = pixels.groupBy(F.col("y").cast("long").alias("y")).agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))).alias("p"))
    line = F.array_join(F.transform("p", lambda q: F.concat_ws(" ", *(q[c].cast("int").cast("string") for c in "rgb"))), " ")
    head = pixels.sparkSession.range(1).select(F.lit(-1).cast("long").alias("y"), F.lit(f"P3 {width} {height} 255").alias("line"))
    return rows.select("y", line.alias("line")).unionByName(head)


class RangeSource(DataSource):
    """A range of tags as a data source (U8, U9): options first, last, step and parts; each part is read by a task."""

    @classmethod
    def name(cls) -> str:
        return "tag_range"

    def schema(self) -> str:
        return "tag long"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(*(int(self.options.get(k, d)) for k, d in (("first", 0), ("last", 0), ("step", 1), ("parts", 1))))


class RangeReader(DataSourceReader):
    def __init__(self, first: int, last: int, step: int, parts: int):
        self.tags, self.parts = range(first, last, step), max(1, parts)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k * len(self.tags) // self.parts, (k + 1) * len(self.tags) // self.parts)) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        low, high = partition.value
        for at in range(low, high, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(self.tags[at : min(high, at + 10_000)], pa.int64())], names=["tag"])


def graph_edges(spec: str) -> list[tuple[str, str, str]]:
    """The edges of a textual graph (S16): <tags> :: (step); [items], [others: key] -> (step) -> [items]; env -> <tags>;

    Statements end with a semicolon, may span lines, and list several collections on a side; tag functions behind a colon
    are left out, and declarations without an arrow have no edges.
    """
    out = []
    for statement in re.sub(r"//[^\n]*|/\*.*?\*/", " ", spec, flags=re.S).split(";"):
        sides = re.split(r"(->|::)", statement)
        named = [[re.sub(r"\s*:.*(?=[>\])]$)|\s+(?=[>\])]$)|(?<=^[<\[(])\s+", "", n) for n in re.findall(r"\benv\b|<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)", side)] for side in sides[::2]]
        out += [(a, kind, b) for left, kind, right in zip(named, sides[1::2], named[1:], strict=False) for a in left for b in right]
    return out


def graph_faults(edges: list[tuple[str, str, str]]) -> list[str]:
    """What a graph lacks: steps that nothing prescribes, collections that are read but never put."""
    prescribed = {b for _, kind, b in edges if kind == "::"}
    put, read = {b for _, kind, b in edges if kind == "->"}, {a for a, _, _ in edges}
    steps = {x for edge in edges for x in (edge[0], edge[2]) if x.startswith("(")}
    return sorted([f"nothing prescribes {s}" for s in steps - prescribed] + [f"nothing puts to {c}" for c in read - put if c[0] in "<["])


def scratch(spark: SparkSession, name: str) -> str:
    return fresh(spark, name)
