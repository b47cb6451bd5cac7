"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagflow.storage import cut

#: Bytes of text that a task handles at a time; a longer text is a slice of its own.
SLICE_BYTES = 12 << 20


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut in the lineage that survives lost executors."""
    return cut(df, compression="zstd")


def on_all_cores(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if it is read in fewer parts than there are cores, as a small file of one row group is; larger
    tables stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables are broadcast up to this size, which is measured first.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written, and marked for a broadcast if its values have ``limit`` bytes at most; else it joins by a shuffle."""
    out = written(df)
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in out.dtypes if kind in ("string", "binary")]
    size = out.agg(F.coalesce(F.sum(sum(sizes, F.lit(16 * len(out.columns)))), F.lit(0))).first()[0]
    return F.broadcast(out) if size <= limit else out


#: Rows of one key that meet in a task, at least; a ten-thousandth of all rows, if that is more.
HOT_ROWS, MOST_HOT = 1024, 10_000


def salts_of(counted: DataFrame, name: str, total: int) -> DataFrame:
    """name and salts of the few values that have too many rows for one task: MOST_HOT rows at most, so they are broadcast."""
    limit = max(HOT_ROWS, total // MOST_HOT)
    return F.broadcast(counted.where(F.col("n") > limit).select(name, F.ceil(F.col("n") / limit).cast("int").alias("salts")))


def salted(df: DataFrame, hot: DataFrame, name: str, place: Column) -> DataFrame:
    """``df`` with the salt that each row of a hot value is dealt to."""
    return df.join(hot, name, "left").withColumn("salt", F.coalesce(F.pmod(place, F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def for_salts(df: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """``df``, a row for each salt of its value."""
    return df.join(hot, name, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def spread_join(left: DataFrame, right: DataFrame, key: str, counted: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key; rows of hot keys are dealt over salts.

    ``counted``: key and n, the rows of ``left`` that have it; ``total``: all rows of ``left``.
    """
    if total <= HOT_ROWS:
        return left.join(right.hint("merge"), key, how)
    hot = salts_of(counted, key, total)
    spread = salted(left, hot, key, F.xxhash64(*left.columns))
    # Merged at every size: broadcasts of the many joins of a loop would add up in the driver.
    return spread.join(for_salts(right, hot, key).hint("merge"), [key, "salt"], how).drop("salt")


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have about ``limit`` bytes; nulls in ``text`` become empty."""
    for batch in batches:
        col = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            part = batch.slice(begin, end - begin)
            at = part.schema.get_field_index(text)
            yield part.set_column(at, text, pc.fill_null(part.column(at).cast(pa.string()), ""))
            begin = end


def returning_memory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; what the worker has allocated and freed goes back to the system behind the last one, since workers
    stay while tasks without Python use the same executor."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def ordered(df: DataFrame, *order: str) -> tuple[DataFrame, dict[int, int]]:
    """``df`` in the order of ``order`` over all rows, written, with ``_part`` and ``_row`` (place in that part), and
    the number of rows before each part. ``order`` must leave only equal rows in a tie. Rows are dealt by ranges that
    Spark samples, so no part grows with one key; the driver gets one count per part.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = F.monotonically_increasing_id()
    out = written(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.shiftright(placed, 33).cast("int"))
        .withColumn("_row", placed.bitwiseAND((1 << 33) - 1))
    )
    before, total = {}, 0
    for part, n in sorted(map(tuple, out.groupBy("_part").count().collect())):
        before[part] = total
        total += n
    return out, before


def before_part(before: dict[int, int], part: np.ndarray) -> np.ndarray:
    """The number of rows before each of these parts."""
    lut = np.zeros(max(before, default=0) + 1, np.int64)
    for k, v in before.items():
        lut[k] = v
    return lut[part]


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is named so (Spark's names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
