"""Step bodies: maps, filters, generators and routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_step(tags: DataFrame, **values: Column) -> DataFrame:
    """A map step."""
    return tags.select("*", *(v.alias(k) for k, v in values.items()))


def cascade(rows: DataFrame, *classifiers: Column) -> DataFrame:
    """Rows that pass every classifier; Spark tests them in one pass."""
    for c in classifiers:
        rows = rows.where(c)
    return rows


def generate(tags: DataFrame, first: Column, last: Column, name: str = "i") -> DataFrame:
    """One row for each integer from first to last, both included."""
    return tags.select("*", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias(name))


def split_ranges(ranges: DataFrame, first: str, last: str, grain: int) -> DataFrame:
    """Tags that are half-open ranges, cut into ranges of ``grain`` at most (C15): other columns stay. Empty ranges give none."""
    starts = F.sequence(F.col(first), F.col(last) - 1, F.lit(grain).cast("long"))
    cut = ranges.where(F.col(first) < F.col(last)).withColumn("_start", F.explode(starts))
    return cut.withColumn(last, F.least(F.col("_start") + grain, F.col(last))).withColumn(first, F.col("_start")).drop("_start")


def route(rows: DataFrame, routes: Mapping[str, Column]) -> dict[str, DataFrame]:
    """The rows of each route; a row may take several."""
    return {name: rows.where(cond) for name, cond in routes.items()}


def runs(rows: DataFrame, text: str) -> DataFrame:
    """Stretches of one character and their places (P5): the text is split into characters once and all its stretches are
    built before they are exploded, so the work is linear in its length."""
    chars, at = F.col("_chars"), F.col("_at")
    starts = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | (F.get(chars, i) != F.get(chars, i - 1)))
    span = lambda start, k: F.struct(start.alias("pos"), F.repeat(F.get(chars, start), F.coalesce(F.get(at, k + 1), F.size(chars)) - start).alias("span"))
    split = rows.where(F.length(text) > 0).withColumn("_chars", F.split(text, "")).withColumn("_at", starts).withColumn("_runs", F.transform(at, span))
    # Not explode: for it Spark tests the array below the columns that make it, which makes them anew for every character.
    return split.select(*rows.columns, F.explode_outer("_runs").alias("_run")).select(*rows.columns, "_run.pos", "_run.span")
