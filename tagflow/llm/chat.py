"""Cumulative-snapshot collapse of logged conversations, then chat formatting.

A service that logs a conversation after every turn leaves prefixes of the longer ones. A rolling hash runs along each
conversation's turns; those whose whole hash is a proper prefix's hash of another are dropped by an anti-join, equal ones
leave the smallest id, and only the rest are rendered.

Cases: turns are ordered by turn, then role and text (nulls first), so repeated turn numbers have one order. Null
roles and texts count as their own value and are rendered empty. Each row without a conversation id is a conversation of
one turn. A very long conversation is placed and hashed in ranges; its text comes together, range by range, only if it
is kept, and must then fit a value. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagflow.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"


def turn_digest(role: Column, text: Column, place: Column, salt: str) -> Column:
    """A hash of a turn at its place, as a number that sums without overflow; tells a null from an empty string."""
    shown = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.xxhash64(F.lit(salt), place, shown(role), F.lit("|"), shown(text)).cast("decimal(20,0)")


def in_ranges(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with ``_part`` and ``_row``, in the order of conversations and their turns.

    Written by sampled ranges, so that no conversation is one task's load; equal turns are dealt as well.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "_tie")]
    place = F.monotonically_increasing_id()
    tied = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_tie"))
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    return written(dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND((1 << 33) - 1)))


def prefixes(dealt: DataFrame) -> DataFrame:
    """conv_id, n_turns, h1, h2 and is_last of each prefix of the conversations in ``in_ranges``' rows.

    The rolling hash is a running sum of two 64-bit hashes of the turns at their places. Places and sums run along each
    range; what ranges tell each other is a count and two sums for each conversation and range.
    """
    part, kind = ["_part", "conv_id"], "decimal(38,0)"
    along, earlier = Window.partitionBy("conv_id").orderBy("_part"), Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*part).agg(F.count("*").alias("n"), F.min("_row").alias("begin"))
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(*part, "begin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(every).alias("total"))
    placed = dealt.join(starts, part).withColumn("n_turns", F.col("before") + F.col("_row") - F.col("begin") + 1)
    digests = [turn_digest(F.col("role"), F.col("text"), F.col("n_turns"), s).alias(f"d{s}") for s in "12"]
    hashed = written(placed.select(*part, "n_turns", (F.col("n_turns") == F.col("total")).alias("is_last"), *digests))
    sums = hashed.groupBy(*part).agg(*(F.sum(f"d{s}").cast(kind).alias(f"s{s}") for s in "12"))
    added = sums.select(*part, *(F.coalesce(F.sum(f"s{s}").over(earlier).cast(kind), F.lit(0).cast(kind)).alias(f"b{s}") for s in "12"))
    inside = Window.partitionBy(*part).orderBy("n_turns").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.select(*part, "n_turns", "is_last", *(F.sum(f"d{s}").over(inside).cast(kind).alias(f"l{s}") for s in "12"))
    return local.join(added, part).select("conv_id", "n_turns", "is_last", *((F.col(f"b{s}") + F.col(f"l{s}")).cast(kind).alias(f"h{s}") for s in "12"))


def maximal(found: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations), h1 and h2 of the conversations that are no proper prefix of another.

    Equal conversations and equal prefixes are each pre-aggregated before they meet, so a very common opening is one row.
    """
    key = ["n_turns", "h1", "h2"]
    unique = found.where("is_last").groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("first"), F.count("*").alias("n_copies"))
    longer = found.where("NOT is_last").select(*key).distinct()
    return unique.join(longer, key, "left_anti").select(F.col("first.conv_id").alias("conv_id"), "n_turns", "n_copies", "h1", "h2")


def chat_format(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies and rendered, for each maximal conversation."""
    named = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt, line = in_ranges(named.where("conv_id IS NOT NULL")), F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    single = [turn_digest(F.col("role"), F.col("text"), F.lit(1).cast("long"), s).cast("decimal(38,0)").alias(f"h{s}") for s in "12"]
    lone = named.where("conv_id IS NULL").select("conv_id", F.lit(1).cast("long").alias("n_turns"), F.lit(True).alias("is_last"), *single, line.alias("rendered"))
    kept = written(maximal(written(prefixes(dealt).unionByName(lone.drop("rendered")))))
    chosen = dealt.join(kept.where("conv_id IS NOT NULL").select("conv_id", "n_turns", "n_copies"), "conv_id")
    key, joined = ["conv_id", "n_turns", "n_copies"], lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["s"]), "")
    ranges = chosen.groupBy(*key, "_part").agg(joined(F.struct("_row", line.alias("s"))).alias("s"))
    whole = ranges.groupBy(*key).agg(joined(F.struct("_part", "s")).alias("rendered"))
    once = lone.groupBy("h1", "h2").agg(F.min("rendered").alias("rendered"))
    return whole.unionByName(kept.where("conv_id IS NULL").join(once, ["h1", "h2"]).select(*key, "rendered"))
