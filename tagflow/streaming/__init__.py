"""Incremental graphs as Structured Streaming queries.

Each function takes streaming DataFrames and gives one; ``drained`` runs it over what is there now (quiescence, K8) and
reads the result back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagflow.storage import fresh


#: Keys that one side of a cross product is dealt over.
SALTS = 16


def stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Files at ``path`` as a stream, with the columns of ``like``. The path may be one file: as a pattern Spark takes it."""
    return spark.readStream.schema(like.schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Everything available now, processed and read back (K4, K8). Only ``append`` is for tables of any size."""
    spark = rows.sparkSession
    out, state = fresh(spark, "stream"), fresh(spark, "stream-state")
    if mode == "append":
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """The incremental cross product of two streams (K2). State grows with the input, as the operator demands.

    The rows of ``a`` are dealt over SALTS keys and those of ``b`` go to each, so no task holds all of either pair.
    """
    left = a.withColumn("_salt", F.pmod(F.xxhash64(*a.columns), F.lit(SALTS)).cast("int"))
    right = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, "_salt").drop("_salt")


def memoized(tags: DataFrame, *keys: str) -> DataFrame:
    """Each tag once (K5); give the stream a watermark and use dropDuplicatesWithinWatermark to bound the state."""
    return tags.dropDuplicates(list(keys))


def counted_sum(items: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    """A keyed sum as soon as as many items were reduced as its count says (K3); -1: at once. Read it with ``emitted_once``.

    items (key, value) and counts (key, n) may arrive in any order. State, one row a key, is Spark's own aggregate's, so
    partial sums are combined before the shuffle; items behind the emission are folded, never emitted.
    Completion is tested when a batch ends: a key that more items than its count reach within one batch does not come
    out, since nothing says which of them would be the first.
    """
    both = items.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.lit(None).cast("long").alias("n")).unionByName(
        counts.select(F.col(key).alias("key"), F.lit(None).cast("double").alias("value"), F.col("n").cast("long").alias("n"))
    )
    sums = both.groupBy("key").agg(F.sum("value").alias("value"), F.count("value").alias("n_reduced"), F.max("n").alias("n"))
    done = (F.col("n_reduced") == F.col("n")) | ((F.col("n") == -1) & (F.col("n_reduced") > 0))
    return sums.where(done).select("key", F.coalesce("value", F.lit(0.0)).alias("value"), "n_reduced")


def emitted_once(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row that each key of a stream in update mode gives, over everything available now.

    A batch writes a folder of its own, anew if it is repeated, without the keys of the folders before it.
    """
    spark = rows.sparkSession
    out, state = fresh(spark, "stream"), fresh(spark, "stream-state")
    kept = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])

    def put(batch: DataFrame, number: int) -> None:
        new = batch
        if number:
            before = batch.sparkSession.read.schema(kept).parquet(out).where(F.col("batch") < number)
            new = new.join(before.select(*keys), list(keys), "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(kept).parquet(out).select(*rows.columns)


def actor(inputs: DataFrame, key: str, order: str, value: str, first: float = 0.0) -> DataFrame:
    """out = value + state, and the state grows by one with each input of a key, in order (K6, Q27)."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else first
        rows = pd.concat(list(frames)).sort_values("order", kind="stable")
        rows["out"] = rows["value"] + at + range(len(rows))
        state.update((at + len(rows),))
        yield rows[["key", "order", "out"]]

    named = inputs.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    return named.groupBy("key").applyInPandasWithState(fold, "key long, order long, out double", "at double", "append", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, key: str, order: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """Each row with the latest value of every kind so far, by key (K7)."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else [0.0] * len(kinds)
        rows = pd.concat(list(frames)).sort_values("order", kind="stable")
        out = rows[["key", "order"]].copy()
        for n, (name, c) in enumerate(zip(names, kinds, strict=True)):
            out[name] = rows["value"].where(rows["kind"] == c).ffill().fillna(last[n])
            last[n] = float(out[name].iloc[-1])
        state.update(tuple(last))
        yield out

    names = [f"last_{c}" for c in kinds]
    fields = ", ".join(f"`{n}` double" for n in names)
    named = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("value"))
    return named.groupBy("key").applyInPandasWithState(fold, f"key long, order long, {fields}", fields, "append", GroupStateTimeout.NoTimeout)


def on_put(rows: DataFrame, callback: Callable[[DataFrame], None]) -> None:
    """``callback`` gets what arrives, batch by batch, until all that is there now has come (I8): memoize before for once each."""
    state = fresh(rows.sparkSession, "stream-state")
    rows.writeStream.foreachBatch(lambda batch, _: callback(batch)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def total_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A keyed sum that is emitted anew with every batch: read it in complete mode (K3 without counts)."""
    return rows.groupBy(key).agg(F.sum(F.col(value)).alias("value"), F.count("*").alias("n_reduced"))


def windowed(rows: DataFrame, time: str, width: str, late: str, value: str) -> DataFrame:
    """An extension of our own (the dataflow model knows no event time): sums of tumbling windows with a watermark (K9)."""
    timed = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w")).agg(F.sum(value).alias("value"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "value", "n")
