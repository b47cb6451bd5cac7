"""Recursive computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.operators.iterate import frontier
from tagflow.operators.steps import split_ranges


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """i and fib for i = 0..n: a recurrence that carries its two latest values."""
    return spark.sql(f"""
        WITH RECURSIVE f(i, a, b) MAX RECURSION LEVEL {n + 5} AS (
          SELECT 0L AS i, CAST(0 AS DECIMAL(38, 0)) AS a, CAST(1 AS DECIMAL(38, 0)) AS b
          UNION ALL
          SELECT f.i + 1, f.b, CAST(f.a + f.b AS DECIMAL(38, 0)) FROM f WHERE f.i < {n})
        SELECT i, a AS fib FROM f""")


def primes(spark: SparkSession, n: int) -> DataFrame:
    """Primes up to ``n``: odd numbers that no odd factor's multiples hit (Q2). Factors are bounded by the root of n."""
    root = int(n**0.5) + 1
    factors = spark.range(3, root + 1, 2).withColumnRenamed("id", "f")
    hits = factors.where(F.col("f") * F.col("f") <= n).select(F.explode(F.sequence(F.col("f") * F.col("f"), F.lit(n), 2 * F.col("f"))).alias("prime")).distinct()
    odd = spark.range(3, n + 1, 2).withColumnRenamed("id", "prime").join(hits, "prime", "left_anti")
    return odd.unionByName(spark.range(2, min(3, n + 1)).withColumnRenamed("id", "prime"))


def fibonacci_by_tags(spark: SparkSession, n: int) -> DataFrame:
    """fib(n) as steps that control their own tags (Q1): tag k puts k - 1 and k - 2, memoized so that each runs once; a
    get of an item is a join that waits for it, so items come level by level from the leaves."""
    from tagflow.storage import cut

    start = spark.range(n, n + 1).withColumnRenamed("id", "tag")
    tags = cut(frontier(start, lambda level: level.where("tag > 1").select(F.explode(F.array(F.col("tag") - 1, F.col("tag") - 2)).alias("tag")).distinct()).distinct())
    items = cut(tags.where("tag < 2").select("tag", F.col("tag").cast("decimal(38,0)").alias("fib")))
    while True:
        waiting = tags.join(items, "tag", "left_anti")
        one, two = items.select((F.col("tag") + 1).alias("tag"), F.col("fib").alias("x")), items.select((F.col("tag") + 2).alias("tag"), F.col("fib").alias("y"))
        made = cut(waiting.join(one, "tag").join(two, "tag").select("tag", (F.col("x") + F.col("y")).cast("decimal(38,0)").alias("fib")))
        if made.isEmpty():
            return items
        items = cut(items.unionByName(made), replacing=items)


def primes_by_ranges(spark: SparkSession, n: int, grain: int = 4096) -> DataFrame:
    """Primes up to ``n`` from range tags (Q2): each piece of odd numbers is tried against the factors up to the root."""
    pieces = split_ranges(spark.createDataFrame([(1, (n + 1) // 2)], "first long, last long"), "first", "last", grain)
    odd = pieces.select(F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("k")).select((2 * F.col("k") + 1).alias("prime"))
    factors = F.sequence(F.lit(3).cast("long"), F.greatest(F.lit(3).cast("long"), F.floor(F.sqrt(F.lit(float(n)))).cast("long")), F.lit(2).cast("long"))
    kept = odd.where(F.forall(factors, lambda f: (f * f > F.col("prime")) | (F.col("prime") % f != 0)))
    return kept.unionByName(spark.range(2, min(3, n + 1)).withColumnRenamed("id", "prime"))


def queens(spark: SparkSession, n: int) -> DataFrame:
    """Placements of n queens, a level a row (Q4): cols, left and right are bit sets of attacked columns."""
    start = spark.createDataFrame([(0, 0, 0, 0)], "row int, cols long, left long, right long")

    def step(level: DataFrame) -> DataFrame:
        spots = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.getbit(F.col("cols").bitwiseOR(F.col("left")).bitwiseOR(F.col("right")), c) == 0)
        at = level.where(F.col("row") < n).select("*", F.explode(spots).alias("c"))
        bit = F.expr("shiftleft(1L, c)")
        return at.select(
            (F.col("row") + 1).alias("row"), F.col("cols").bitwiseOR(bit).alias("cols"),
            F.shiftleft(F.col("left").bitwiseOR(bit), 1).alias("left"), F.shiftright(F.col("right").bitwiseOR(bit), 1).alias("right"))

    return frontier(start, step).where(F.col("row") == n)


def divide(spark: SparkSession, value: int) -> DataFrame:
    """The nodes of a halving tree (Q5): tag (path in digits 0 and 1 behind a 1), value, is_leaf."""
    return spark.sql(f"""
        WITH RECURSIVE t(tag, value) AS (
          SELECT '1' AS tag, CAST({value} AS BIGINT) AS value
          UNION ALL
          SELECT concat(t.tag, c.side), CASE WHEN c.side = '0' THEN t.value div 2 ELSE t.value - t.value div 2 END
          FROM t CROSS JOIN (VALUES ('0'), ('1')) AS c(side) WHERE t.value >= 2)
        SELECT tag, value, value < 2 AS is_leaf FROM t""")


def tree_search(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and i of each wanted value found in a leaf of a sorted tree (Q6, J7): a frontier that meets the nodes by key."""
    start = wanted.select(F.lit(1).cast("long").alias("node"), "i", "wanted")

    def step(level: DataFrame) -> DataFrame:
        at = level.join(nodes, "node").where("has_children = 1")
        return at.select((F.col("node") * 10 + F.when(F.col("wanted") <= F.col("value"), 0).otherwise(1)).cast("long").alias("node"), "i", "wanted")

    return frontier(start, step).join(nodes, "node").where("has_children = 0 AND wanted = value").select("node", "i")


def unbalanced_tree(spark: SparkSession, fanout: float = 4.0, depth: int = 6, seed: int = 0) -> DataFrame:
    """height and children of every node of a tree whose shape a hash chain decides (Q8), linear geometric kind.

    A node's state is the SHA-1 of its parent's state and its number, so a level is one map over the one before.
    """
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    draw = F.conv(F.substring(F.hex("state"), 33, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF) / float(1 << 31)
    target = fanout * (1 - F.col("height") / float(depth))
    children = F.when(target > 0, F.floor(F.log(1 - draw) / F.log(1 - 1 / (1 + target)))).otherwise(0).cast("long")
    root = spark.range(1).select(F.lit(0).alias("height"), F.unhex(F.sha1(F.concat(F.unhex(F.lit("00" * 16)), number(F.lit(seed).cast("long"))))).alias("state"))

    def grown(level: DataFrame) -> DataFrame:
        born = level.where("children > 0").select("height", "state", F.explode(F.sequence(F.lit(0).cast("long"), F.col("children") - 1)).alias("k"))
        return sized(born.select((F.col("height") + 1).alias("height"), F.unhex(F.sha1(F.concat("state", number(F.col("k"))))).alias("state")))

    def sized(level: DataFrame) -> DataFrame:
        return level.withColumn("children", children)

    return frontier(sized(root), grown).select("height", "children")


def shortest_paths(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """i, j, d: least sums over paths (Q9, A12) by min-plus doubling: each round joins paths that meet, of which one at
    least has been found or shortened in the round before.

    Distances must not be negative. ``rounds`` bounds the doubling; by default it stops when nothing shortens.
    """
    from tagflow.storage import cut, remove

    paths = cut(edges.groupBy("i", "j").agg(F.min("d").alias("d")).withColumn("new", F.lit(True)))
    k = 0
    while rounds is None or k < rounds:
        new, k = paths.where("new"), k + 1
        meet = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.j") == F.col("b.i")).where("a.i <> b.j").select(F.col("a.i").alias("i"), F.col("b.j").alias("j"), (F.col("a.d") + F.col("b.d")).alias("d"))
        longer = meet(new, paths).unionByName(meet(paths.where("NOT new"), new))
        both = paths.select("i", "j", "d", F.col("d").alias("was")).unionByName(longer.withColumn("was", F.lit(None).cast("double")))
        least = both.groupBy("i", "j").agg(F.min("d").alias("d"), F.min("was").alias("was"))
        after = cut(least.select("i", "j", "d", (F.col("was").isNull() | (F.col("d") < F.col("was"))).alias("new")))
        remove(edges.sparkSession, paths.cut_path)
        paths = after
        if paths.where("new").isEmpty():
            break
    return paths.select("i", "j", "d")


def backward_items(spark: SparkSession, n: int) -> DataFrame:
    """t and value for t < n, value(t) = t + value(t div 6) squared, value(0) = 0 (Q23), by depth of the dependency."""
    from tagflow.storage import cut

    known = cut(spark.range(1).select(F.col("id").alias("t"), F.col("id").cast("decimal(38,0)").alias("value")))
    low, high = 1, 6
    while low < n:
        tags = spark.range(low, min(high, n)).withColumnRenamed("id", "t").withColumn("p", F.expr("t div 6"))
        new = tags.join(known.select(F.col("t").alias("p"), "value"), "p").select("t", (F.col("t").cast("decimal(19,0)") + (F.col("value").cast("decimal(18,0)") * F.col("value").cast("decimal(18,0)"))).cast("decimal(38,0)").alias("value"))
        known, low, high = cut(known.unionByName(new)), high, high * 6
    return known


def thread_ring(spark: SparkSession, hops: int, agents: int, single: bool = False) -> DataFrame:
    """The agent that holds the token when it has no hops left (Q26); a loop would only count modulo the agents."""
    return spark.range(1).select((F.lit(hops) % agents + (0 if single else 1)).cast("long").alias("agent"))
