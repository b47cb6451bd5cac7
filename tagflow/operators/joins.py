"""Gets and cross products as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagflow.operators.ranges import in_ranges, same_keys
from tagflow.storage import cut


def cross_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The incremental cross product in canonical form: each side as a set, each pair once (J1, J1a-c).

    The output is the product by definition; sides are made distinct before they meet.
    """
    return a.distinct().crossJoin(b.distinct())


def lookup(steps: DataFrame, items: DataFrame, on: Mapping[str, Column] | Sequence[str], missing: str = "wait", prefix: str = "") -> DataFrame:
    """A get at a computed key.

    on: item key -> expression over ``steps``, or names that both share. missing: ``wait`` drops steps whose item never
    comes (M9), ``null`` keeps them, ``flag`` keeps them with a boolean ``found``. prefix: put before the items' columns.
    """
    keys = {k: F.col(k) for k in on} if not isinstance(on, Mapping) else dict(on)
    right = items.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(prefix + c) for c in items.columns if c not in keys), F.lit(True).alias("_there"))
    left = steps.select("*", *(e.alias(f"_s_{k}") for k, e in keys.items()))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"_s_{k}") == F.col(f"_k_{k}"))
    out = left.join(right, cond, "inner" if missing == "wait" else "left")
    if missing == "flag":
        out = out.withColumn("found", F.col("_there").isNotNull())
    return out.drop("_there", *(f"_s_{k}" for k in keys), *(f"_k_{k}" for k in keys))


def everywhere(items: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """``items`` for gets by all steps (C8): written, measured, and sent to every executor if the values have ``limit`` bytes at
    most; larger ones join by a shuffle."""
    out = cut(items)
    size = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(16) for c, kind in out.dtypes]
    total = out.agg(F.coalesce(F.sum(sum(size, F.lit(16))), F.lit(0))).first()[0]
    return F.broadcast(out) if total <= limit else out


def stalled(steps: DataFrame, items: DataFrame, on: Sequence[str]) -> DataFrame:
    """Steps that wait for an item nobody puts (M9)."""
    return steps.join(items, list(on), "left_anti")


def cancel(tags: DataFrame, cancelled: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tags without those cancelled before they run (C11)."""
    return tags.join(cancelled.select(*on).distinct(), list(on), "left_anti")


def latest_values(rows: DataFrame, order: Sequence[str], kind: str, value: str, kinds: Sequence[str], by: Sequence[str] = (), default: float = 0.0) -> DataFrame:
    """Each row with the latest value of every kind so far (J5), ``default`` before the first.

    Without ``by`` all rows are one history, and Spark sorts them in one task: pass a key that splits it at scale.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(F.col(kind) == k, F.col(value)), ignorenulls=True).over(w)
    return rows.select("*", *(F.coalesce(last(k), F.lit(default)).alias(f"last_{k}") for k in kinds))


def latest_in_ranges(rows: DataFrame, order: Sequence[str], kind: str, value: str, kinds: Sequence[str], by: Sequence[str] = (), default: float = 0.0) -> DataFrame:
    """The same for histories of any length: latest values in sampled ranges, and for the rows before a range's first one
    what the ranges before end with, one row for each key and range."""
    dealt = in_ranges(rows, *by, *order)
    inside = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    given = {k: F.when(F.col(kind) == k, F.col(value)) for k in kinds}
    local = dealt.select("*", *(F.last(c, ignorenulls=True).over(inside).alias(f"_l_{k}") for k, c in given.items()))
    ends = dealt.groupBy("_part", *by).agg(*(F.max_by(c, F.when(c.isNotNull(), F.col("_row"))).alias(f"_e_{k}") for k, c in given.items()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_part").alias("_o__part"), *(F.col(c).alias(f"_o_{c}") for c in by), *(F.last(f"_e_{k}", ignorenulls=True).over(earlier).alias(f"_b_{k}") for k in kinds))
    out = local.join(ends, same_keys(["_part", *by]))
    return out.select(*rows.columns, *(F.coalesce(f"_l_{k}", f"_b_{k}", F.lit(default)).alias(f"last_{k}") for k in kinds))
