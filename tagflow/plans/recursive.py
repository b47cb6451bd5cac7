"""Recursive and iterative queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.algorithms import grids, recursion, tiles
from tagflow.functions import option_price
from tagflow.sources import table


def q1_fib(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.fibonacci(spark, 60).select("i", F.col("fib").cast("long").alias("fib"))


def q2_primes(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.primes(spark, 100_000)


def q3_mandelbrot(spark: SparkSession, sf: str) -> DataFrame:
    return grids.checksum(grids.mandelbrot(spark, 100, 100, 10_000), 100, 10_000)


def q4_queens(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.queens(spark, 8).agg(F.count("*").alias("solutions"))


def q5_divide(spark: SparkSession, sf: str) -> DataFrame:
    t = recursion.divide(spark, 18)
    return t.agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("is_leaf"), F.col("value")).otherwise(0)).alias("total"))


# The example tree, node numbers and the values in them.
TREE = [(1, 35), (10, 15), (11, 55), (100, 5), (101, 25), (110, 45), (111, 65), (1000, 5), (1001, 15), (1010, 25), (1011, 35), (1100, 45), (1101, 55), (1110, 65), (1111, 75)]
SEARCHED = [20, 35, 11, 99, 65]


def q6_tree_search(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark.createDataFrame([(n, v, int(n < 1000)) for n, v in TREE], "node long, value int, has_children int")
    return recursion.tree_search(nodes, spark.createDataFrame(list(enumerate(SEARCHED)), "i long, wanted int"))


def q8_unbalanced_tree(spark: SparkSession, sf: str) -> DataFrame:
    t = recursion.unbalanced_tree(spark)
    return t.agg(F.count("*").alias("nodes"), F.sum((F.col("children") == 0).cast("long")).alias("leaves"), F.max("height").cast("long").alias("deepest"))


def roads(spark: SparkSession, sf: str) -> DataFrame:
    """A road from each nation to the next two by number and to the one of thrice its number."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    to = F.explode(F.array(*(F.struct(j.alias("j"), d.alias("d")) for j, d in (((F.col("i") + 1) % 25, F.col("i") % 3 + 4), ((F.col("i") + 2) % 25, F.col("i") % 5 + 9), ((F.col("i") * 3) % 25, F.col("i") % 7 + 2)))))
    return n.select("i", to.alias("t")).select("i", "t.j", F.col("t.d").cast("double").alias("d")).where("i <> j")


def q9_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.shortest_paths(roads(spark, sf))


def q12_matmul(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of products of two sparse matrices: parts by suppliers, and suppliers by parts of one brand each."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    a = lines.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("v").alias("v"))
    return tiles.multiply(a, a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def q15_heat_step(spark: SparkSession, sf: str) -> DataFrame:
    grid = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("u"))
    return grids.heat_step(grid, ["user_id"], "event_id", "u", 0.25).select("event_id", F.round("u", 6).alias("u"))


def q19_blackscholes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("s"), (F.col("p_retailprice") * (0.8 + F.col("p_size") / 100)).alias("x"), (F.col("p_size") / 10).alias("t"), (F.col("p_partkey") % 2 == 0).alias("put"))
    return o.select("p_partkey", F.round(option_price(F.col("s"), F.col("x"), F.lit(0.05), F.lit(0.3), F.col("t"), F.col("put")), 6).alias("price"))


def q22_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Ten stages over the parts' streams: stage i makes (i, x) from (i - 1, x)."""
    state = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    for stage in range(1, 11):
        state = state.select("p_partkey", (F.col("v") * 0.5 + stage).alias("v"))
    return state.select("p_partkey", F.round("v", 9).alias("v"))


def q23_backward_items(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.backward_items(spark, 1000).select("t", F.col("value").cast("decimal(38,0)").cast("string").alias("value"))


def q26_thread_ring(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.thread_ring(spark, 1_000_000, 503)


QUERIES = {
    "Q1_fib": q1_fib, "Q2_primes": q2_primes, "Q3_mandelbrot": q3_mandelbrot, "Q4_queens": q4_queens, "Q5_divide": q5_divide, "Q6_tree_search": q6_tree_search,
    "Q8_unbalanced_tree": q8_unbalanced_tree, "Q9_shortest_path": q9_shortest_path, "Q12_matmul": q12_matmul, "Q15_heat_step": q15_heat_step,
    "Q19_blackscholes": q19_blackscholes, "Q22_pipeline": q22_pipeline, "Q23_backward_items": q23_backward_items, "Q26_thread_ring": q26_thread_ring,
}

STAGES = "v"
for _stage in range(1, 11):
    STAGES = f"({STAGES} * 0.5 + {_stage})"
NORMAL_SQL = """(CASE WHEN {x} < 0 THEN 1 - (1 - 0.39894228040143270286 * exp(-{x} * {x} / 2) * {p}) ELSE 1 - 0.39894228040143270286 * exp(-{x} * {x} / 2) * {p} END)"""
POLY = "(((((1.330274429 * {k} - 1.821255978) * {k} + 1.781477937) * {k} - 0.356563782) * {k} + 0.319381530) * {k})"


def _normal(x: str) -> str:
    return NORMAL_SQL.format(x=x, p=POLY.format(k=f"(1 / (1 + 0.2316419 * abs({x})))"))


SQL = {
    "Q1_fib": "WITH RECURSIVE f(i, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 60) SELECT i, a AS fib FROM f",
    "Q2_primes": """
        SELECT n AS prime FROM range(2, 100001) r(n) WHERE n NOT IN
          (SELECT f * k FROM range(2, 317) a(f), range(2, 50001) b(k) WHERE f * k <= 100000)""",
    "Q3_mandelbrot": "SELECT 4810272::BIGINT AS checksum",
    "Q4_queens": """
        WITH RECURSIVE q(r, cols) AS (SELECT 0, []::INT[] UNION ALL
          SELECT r + 1, list_append(cols, c::INT) FROM q, range(8) x(c)
          WHERE r < 8 AND len(list_filter(range(len(cols)), lambda k: cols[k + 1] = c OR abs(cols[k + 1] - c) = r - k)) = 0)
        SELECT count(*) AS solutions FROM q WHERE r = 8""",
    "Q5_divide": """
        WITH RECURSIVE t(v) AS (SELECT 18::BIGINT UNION ALL SELECT CASE WHEN s = 0 THEN v // 2 ELSE v - v // 2 END FROM t, range(2) c(s) WHERE v >= 2)
        SELECT count(*) AS nodes, sum(CASE WHEN v < 2 THEN v ELSE 0 END)::BIGINT AS total FROM t""",
    "Q6_tree_search": "SELECT * FROM (VALUES (1011::BIGINT, 1::BIGINT), (1110, 4)) v(node, i)",
    "Q8_unbalanced_tree": "SELECT 1732::BIGINT AS nodes, 1050::BIGINT AS leaves, 6::BIGINT AS deepest",
    "Q9_shortest_path": """
        WITH RECURSIVE e AS (
          SELECT i, j, min(d) AS d FROM (
            SELECT n_nationkey AS i, (n_nationkey + 1) % 25 AS j, n_nationkey % 3 + 4 AS d FROM nation UNION ALL
            SELECT n_nationkey, (n_nationkey + 2) % 25, n_nationkey % 5 + 9 FROM nation UNION ALL
            SELECT n_nationkey, (n_nationkey * 3) % 25, n_nationkey % 7 + 2 FROM nation) WHERE i <> j GROUP BY i, j),
        p(i, j, d) AS (SELECT i, j, d FROM e UNION SELECT p.i, e.j, p.d + e.d FROM p JOIN e ON p.j = e.i WHERE p.i <> e.j AND p.d + e.d <= 75)
        SELECT i::BIGINT AS i, j::BIGINT AS j, min(d)::DOUBLE AS d FROM p GROUP BY i, j""",
    "Q12_matmul": """
        WITH a AS (SELECT p_brand AS i, l_suppkey AS j, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
        SELECT x.i, y.i AS j, sum(x.v * y.v)::BIGINT AS v FROM a x JOIN a y ON x.j = y.j GROUP BY ALL""",
    "Q15_heat_step": """
        WITH n AS (SELECT event_id, value AS u, lag(value) OVER w AS l, lead(value) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT event_id, round(CASE WHEN l IS NULL OR r IS NULL THEN u ELSE u + 0.25 * (l - 2 * u + r) END, 6) AS u FROM n""",
    "Q19_blackscholes": f"""
        WITH o AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.8 + p_size / 100) AS x, p_size / 10 AS t FROM part),
        d AS (SELECT *, (ln(s / x) + (0.05 + 0.3 * 0.3 / 2) * t) / (0.3 * sqrt(t)) AS d1, x * exp(-0.05 * t) AS later FROM o),
        e AS (SELECT *, d1 - 0.3 * sqrt(t) AS d2 FROM d),
        n AS (SELECT p_partkey, s, later, {_normal("d1")} AS n1, {_normal("d2")} AS n2 FROM e)
        SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN later * (1 - n2) - s * (1 - n1) ELSE s * n1 - later * n2 END, 6) AS price FROM n""",
    "Q22_pipeline": f"SELECT p_partkey, round({STAGES}, 9) AS v FROM (SELECT p_partkey, p_retailprice::DOUBLE AS v FROM part)",
    "Q23_backward_items": """
        WITH RECURSIVE c(t, v) AS (SELECT 0::BIGINT, 0::HUGEINT UNION ALL
          SELECT k::BIGINT, k::HUGEINT + v * v FROM c, range(1000) r(k) WHERE k // 6 = t AND k > 0)
        SELECT t, v::VARCHAR AS value FROM c""",
    "Q26_thread_ring": "SELECT 37::BIGINT AS agent",
}
