"""Keyed reductions with a selector and expected counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagflow.operators.ranges import in_ranges, same_keys


def reduce_items(
    items: DataFrame,
    key: dict[str, Column],
    op: Column,
    select: Column | None = None,
    counts: DataFrame | None = None,
    identity: object = None,
    flush: bool = False,
) -> DataFrame:
    """value and n_reduced for each key (A1).

    select: the selector's filter over tag columns (A1a, A1i); key: its key. op: an associative and commutative
    aggregate (A1b). counts: a table of the key's columns and ``n``; a key comes out when exactly n items were
    reduced (A1c, A1d), when n is -1 whatever was reduced (A1e), and for n = 0 with no item as ``identity`` (A1h).
    flush: every key comes out (A1f). Partial aggregation is Spark's (A1j).
    """
    if counts is None and not flush:
        raise ValueError("without counts nothing is ever emitted; pass counts or flush=True")
    chosen = items if select is None else items.where(select)
    named = chosen.groupBy(*(e.alias(k) for k, e in key.items())).agg(op.alias("value"), F.count("*").alias("n_reduced"))
    if flush:
        return named
    out = counts.join(named, list(key), "left")
    reduced = F.coalesce("n_reduced", F.lit(0))
    done = (reduced == F.col("n")) | ((F.col("n") == -1) & F.col("n_reduced").isNotNull())
    return out.where(done).select(*key, F.coalesce("value", F.lit(identity)).alias("value"), reduced.alias("n_reduced"))


def reduce_with(rows: DataFrame, key: list[str], value: str, op: Callable[[np.ndarray], object], kind: str, salts: int = 32, at_once: int = 4 << 20) -> DataFrame:
    """``value`` of each key reduced by a function of the user's own (U2): associative and commutative, an array to a value.

    Arrow batches, joined to ``at_once`` bytes, are reduced where they are, then what tasks made of a key in ``salts``
    groups, then those. These come sorted by key, as many keys to a batch as fit, and of a batch only the last key waits
    for the next: a group takes no call of Spark's, and a key of any size no memory. ``op`` meets every value, but no
    result a second time that is alone. Floats are keys as Spark groups them: 0.0 is -0.0.
    """
    floats = {f.name: f.dataType for f in rows.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}

    def grouped(k: str) -> Column:
        if k not in floats:
            return F.col(k)
        special = F.when(F.col(k) == 0, F.lit(0.0).cast(floats[k])).when(F.isnan(k), F.lit(float("nan")).cast(floats[k]))
        return special.otherwise(F.col(k)).alias(k)

    named = rows.where(F.col(value).isNotNull()).select(*(grouped(k) for k in key), value)
    schema = T.StructType([*named.schema.fields[:-1], T.StructField(value, T._parse_datatype_string(kind))])
    made = to_arrow_schema(schema)

    def reduced(t: pa.Table, again: bool = False) -> pa.Table:
        groups = t.group_by(key, use_threads=False).aggregate([(value, "list")])
        lists = groups[f"{value}_list"].combine_chunks()
        flat, ends = lists.flatten(), np.cumsum(np.asarray(lists.value_lengths())).tolist()
        nulls, whole = flat.null_count > 0, flat.to_numpy(zero_copy_only=False)  # nulls: op's own

        def one(x: int, y: int) -> object:
            if again and not nulls and y - x == 1:
                return whole[x]
            return op(flat.slice(x, y - x).to_numpy(zero_copy_only=False) if nulls else whole[x:y])

        out = pa.array([one(x, y) for x, y in zip([0, *ends[:-1]], ends, strict=True)], made.field(value).type)
        return pa.table([*(groups[k] for k in key), out], schema=made)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= at_once:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            yield from reduced(t).to_batches()

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for t in tables(batches):
            t = reduced(t.select([*key, value]), again=True)
            if last is not None:
                t = pa.concat_tables([reduced(pa.concat_tables([last, t.slice(0, 1)]), again=True), t.slice(1)])
            last = t.slice(t.num_rows - 1)
            yield from t.slice(0, t.num_rows - 1).to_batches()
        if last is not None:
            yield from last.to_batches()

    def by(t: DataFrame, *dealt: str) -> DataFrame:
        return t.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(in_order, schema)

    few = named.mapInArrow(partial, schema).withColumn("_salt", F.spark_partition_id() % salts)
    return by(by(few, *key, "_salt"), *key)


def map_reduce(rows: DataFrame, emit: Callable[[DataFrame], DataFrame], combine: Column | Callable[[np.ndarray], object], kind: str = "long") -> DataFrame:
    """key and value (A5): ``emit`` makes rows of key and value, ``combine`` reduces the values of a key - an aggregate of
    Spark's over the column ``value``, or a function for ``reduce_with``, whose results are of ``kind``."""
    pairs = emit(rows).select("key", "value")
    if isinstance(combine, Column):
        return pairs.groupBy("key").agg(combine.alias("value"))
    return reduce_with(pairs, ["key"], "value", combine, kind)


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str = "running") -> DataFrame:
    """The prefix sum within each key."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w))


def running_in_ranges(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str = "running") -> DataFrame:
    """The same where a key may hold any share of the rows: prefix sums in sampled ranges, and what the ranges before add.

    What ranges tell each other is one sum for each key and range.
    """
    dealt = in_ranges(rows.withColumn("_value", value), *by, *order)
    inside = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_local", F.sum("_value").over(inside))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part", *by).agg(F.sum("_value").alias("_sum")).withColumn("_before", F.sum("_sum").over(earlier))
    twins = sums.select(F.col("_part").alias("_o__part"), *(F.col(c).alias(f"_o_{c}") for c in by), "_before")
    total = F.when(F.col("_before").isNull(), F.col("_local")).otherwise(F.col("_before") + F.coalesce("_local", F.lit(0)))
    return local.join(twins, same_keys(["_part", *by])).select(*rows.columns, total.alias(name))


def reduce_until(rows: DataFrame, by: list[str], order: list[str], value: Column, limit: float) -> DataFrame:
    """The first row of each key whose running sum exceeds ``limit`` (A7); keys that never do give none.

    Sums run in ranges and the first row is an aggregate, so a key may hold any share of the rows.
    """
    sums = running_in_ranges(rows, by, order, value)
    first = F.min_by(F.struct(*sums.columns), F.struct(*order)).alias("r")
    return sums.where(F.col("running") > limit).groupBy(*by).agg(first).select("r.*")


def fanout_audit(steps: DataFrame, items: DataFrame, key: str, declared: str = "n") -> DataFrame:
    """Items whose number of gets differs from the declared count (M3, M4)."""
    used = steps.groupBy(key).agg(F.count("*").alias("gets"))
    out = items.join(used, key, "left").withColumn("gets", F.coalesce("gets", F.lit(0)))
    return out.where(F.col("gets") != F.col(declared))
