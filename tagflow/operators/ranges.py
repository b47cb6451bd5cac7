"""Rows in an order over all of them, dealt by sampled ranges, so that no key and no history is one task's load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagflow.storage import cut


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` written in their order, with ``_part`` (the range) and ``_row`` (the place in it)."""
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND((1 << 33) - 1)))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their 1-based ``rank`` over all rows (Q7): a count for each range is all that ranges share."""
    dealt = in_ranges(rows, *order)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    return dealt.join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_row") + 1).alias("rank"))


def same_keys(names: Sequence[str], other: str = "_o_"):
    """Equality of ``names`` with their renamed twins, nulls included."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(other + n))
    return cond
