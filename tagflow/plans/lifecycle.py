"""Sources, sinks, lifecycle, tuning, user functions and numeric graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tagflow import functions, sources
from tagflow.algorithms import grids, tiles
from tagflow.model import ItemTable, TagSet
from tagflow.operators import joins, ranges, reduce, steps
from tagflow.plans.items import TOTAL
from tagflow.sources import strided_range, table


def s1_puts(spark: SparkSession, sf: str) -> DataFrame:
    """Items put in two lots, one row a key."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return ItemTable(rows.where("c_custkey % 2 = 0"), ["c_custkey"]).put(rows.where("c_custkey % 2 = 1")).items()


def s2_tag_puts(spark: SparkSession, sf: str) -> DataFrame:
    """Tags are a bag: a tag put twice is there twice."""
    rows = table(spark, sf, "orders").select("o_custkey")
    return TagSet(rows).put(rows.where("o_custkey % 5 = 0")).tags().groupBy("o_custkey").agg(F.count("*").alias("n"))


def s6_text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as text files, read again in blocks that Spark cuts at line ends: lines and words."""
    path = sources.scratch(spark, "text")
    table(spark, sf, "documents").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    return sources.text_files(spark, path).agg(F.count("*").alias("lines"), F.sum(F.size(functions.words(F.col("text")))).alias("words"))


def s8_stored_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items written through to a table; what is read comes from there."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = sources.scratch(spark, "items")
    sources.stored_items(rows.where("s_acctbal < 0"), path)
    return sources.stored_items(rows.where("s_acctbal >= 0"), path)


def s9_env_get(spark: SparkSession, sf: str) -> DataFrame:
    row = ItemTable(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).get(7)
    return spark.createDataFrame([row], "n_nationkey int, n_name string")


def s12_sizes(spark: SparkSession, sf: str) -> DataFrame:
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    held = {name: ItemTable(table(spark, sf, name), k, "bag") for name, k in keys.items()}
    return spark.createDataFrame([(name, t.size(), t.empty()) for name, t in held.items()], "collection string, size long, empty boolean")


def s13_reset(spark: SparkSession, sf: str) -> DataFrame:
    """What was put before a reset is gone."""
    rows = table(spark, sf, "region")
    return ItemTable(rows, ["r_regionkey"]).reset().put(rows.where("r_regionkey < 2")).items()


def s14_image(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a small plain-text image."""
    pixels = spark.range(12 * 8).select((F.col("id") % 12).alias("x"), F.expr("id div 12").alias("y")).select("x", "y", (F.col("x") * 20).alias("r"), (F.col("y") * 30).alias("g"), (F.col("x") + F.col("y")).alias("b"))
    return sources.image_rows(pixels, 12, 8)


SPEC = """
    <row> :: (scan);          // each row tag prescribes a scan
    [table] -> (scan) -> [word];
    <word> :: (count);
    [word] -> (count) -> [total];
"""


def s16_graph_spec(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(sources.graph_edges(SPEC), "source string, kind string, target string")


def p6_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(functions.words(functions.ascii_lower(F.col("text")))).alias("place", "word")).select("doc_id", F.col("place").cast("long").alias("place"), "word")


def p8_many_steps(spark: SparkSession, sf: str) -> DataFrame:
    """One tag collection prescribes three steps."""
    tags = TagSet(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tag")))
    made = [tags.prescribe(lambda t, name=name, f=f: t.select("tag", F.lit(name).alias("step"), f.alias("out"))) for name, f in (("double", F.col("tag") * 2), ("square", F.col("tag") * F.col("tag")), ("negative", -F.col("tag")))]
    return made[0].unionByName(made[1]).unionByName(made[2])


def p10_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """A step's own members and the context's global data are literals of its plan."""
    scale = lambda factor: lambda t: t.select("p_partkey", F.lit(factor).alias("factor"), (F.col("p_size") * factor).cast("long").alias("out"))
    tags = TagSet(table(spark, sf, "part").select("p_partkey", "p_size"))
    return tags.prescribe(scale(3)).unionByName(tags.prescribe(scale(5)))


def i2_four_gets(spark: SparkSession, sf: str) -> DataFrame:
    """Four gets at computed tags: the neighbours of every cell of a grid of orders."""
    grid = table(spark, sf, "orders").select(F.expr("o_orderkey div 40").alias("i"), (F.col("o_orderkey") % 40).alias("j"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    near = grids.neighbours(grid, grids.CROSS, ("i", "j"), "v")
    total = sum((F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(4)), F.lit(0))
    return near.select("i", "j", total.alias("around"))


def j3_point_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two gets of one step, at keys that its tag holds."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    got = joins.lookup(joins.lookup(events, customers, {"c_custkey": F.col("user_id")}), nations, {"n_nationkey": F.col("c_nationkey")})
    return got.groupBy("n_name").agg(F.count("*").alias("events"))


def c7_placement(spark: SparkSession, sf: str) -> DataFrame:
    """compute_on by key: all rows of a key are in one partition."""
    placed = table(spark, sf, "events").select("user_id").repartition(16, "user_id").withColumn("place", F.spark_partition_id())
    return placed.groupBy("user_id").agg(F.countDistinct("place").alias("places"), F.count("*").alias("n"))


def c12_sequentialize(spark: SparkSession, sf: str) -> DataFrame:
    """Odd tags run alone behind the others, the last put first: their turns."""
    odd = strided_range(spark, 0, 18).where("tag % 2 = 1").select((-F.col("tag")).alias("order"), "tag")
    return ranges.ranked(odd, "order").select("tag", F.col("rank").alias("turn"))


def c14_range_grain(spark: SparkSession, sf: str) -> DataFrame:
    """The grain of a range's split changes no result."""
    one = lambda parts: strided_range(spark, 0, 100_000, 7, parts=parts).agg(F.sum("tag").alias("total"), F.count("*").alias("n")).select(F.lit(parts).alias("parts"), "total", "n")
    return one(1).unionByName(one(13))


def c16_parallel_for(spark: SparkSession, sf: str) -> DataFrame:
    return strided_range(spark, 10, 1000, 3, "i").select("i", (F.col("i") * F.col("i") % 1009).alias("out"))


def c24_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """How many instances a step made, observed while it runs."""
    seen = Observation("steps")
    tags = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    made = steps.generate(tags, F.lit(1).cast("long"), F.col("n")).observe(seen, F.count(F.lit(1)).alias("created"), F.max("i").alias("widest"))
    made.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["created"], seen.get["widest"])], "created long, widest long")


def u2_own_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate of the user's own over partial sums: the geometric mean of each brand's prices."""
    logs = reduce.reduce_items(table(spark, sf, "part"), {"p_brand": F.col("p_brand")}, F.sum(F.log("p_retailprice")), flush=True)
    return logs.select("p_brand", F.round(F.exp(F.col("value") / F.col("n_reduced")), 4).alias("mean"))


def u8_data_source(spark: SparkSession, sf: str) -> DataFrame:
    spark.dataSource.register(sources.RangeSource)
    return spark.read.format("tag_range").options(first=5, last=500, step=3, parts=4).load()


def f_strings(spark: SparkSession, sf: str) -> DataFrame:
    """find, substr, rfind, membership and ASCII lower case on names."""
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", F.locate("e", name, 3).cast("long").alias("found"), F.substring(name, 2, 4).alias("part"), functions.last_place(name, F.lit("a")).cast("long").alias("last"),
        F.col("p_brand").isin("Brand#11", "Brand#23").alias("member"), functions.ascii_lower(name).alias("low"))


def f_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Roots, powers, angles, integer division, shifts and bits."""
    n, x = F.col("p_partkey"), F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(F.sqrt(x) + F.exp(-x / 1000) + F.log(x), 6).alias("a"), F.round(F.sin(x) + F.cos(x) * F.tan(x / 5000) + F.pow(x, F.lit(0.3)), 6).alias("b"),
        F.least(x, F.lit(1000.0)).alias("low"), F.greatest(x, F.lit(1000.0)).alias("high"), F.expr("p_partkey div 7").alias("quotient"), (n % 7).alias("rest"),
        F.shiftleft(n, 3).alias("shifted"), n.bitwiseAND(12).bitwiseOR(1).alias("bits"), F.floor(x / 3).alias("floor"))


def f15_complex(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of z = z * z + c on columns."""
    c = functions.complex_of(F.col("p_size") / 50 - 1, F.col("p_partkey") % 7 / 7)
    rows = table(spark, sf, "part").select("p_partkey", c.alias("c"), c.alias("z"))
    for _ in range(3):
        rows = rows.select("p_partkey", "c", functions.complex_add(functions.complex_mul(F.col("z"), F.col("z")), F.col("c")).alias("z"))
    return rows.select("p_partkey", F.round(functions.complex_abs(F.col("z")), 6).alias("size"))


def symmetric(spark: SparkSession, n: int) -> DataFrame:
    """A symmetric, positive definite matrix of cells."""
    i, j = F.expr(f"id div {n}"), F.col("id") % n
    v = F.when(i == j, F.lit(2.0 * n)).otherwise(0.0) + (i * j % 5 + F.least(i, j) % 3).cast("double")
    return spark.range(n * n).select(i.alias("i"), j.alias("j"), v.alias("v"))


def q10_cholesky(spark: SparkSession, sf: str) -> DataFrame:
    """The factor times its transpose, which is the matrix again."""
    low = tiles.to_cells(tiles.cholesky(tiles.to_tiles(symmetric(spark, 12), 4), 12, 4), 4)
    back = tiles.multiply(low, low.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return back.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def q11_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix times its inverse."""
    a = symmetric(spark, 12)
    product = tiles.multiply(a, tiles.to_cells(tiles.inverse(tiles.to_tiles(a, 4), 12, 4), 4))
    return product.select("i", "j", F.abs(F.round("v", 6)).alias("v"))


def q12_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The product of two matrices of tiles."""
    a = symmetric(spark, 12)
    t = tiles.to_tiles(a, 4)
    return tiles.to_cells(tiles.multiply_tiles(t, t, 4), 4).select("i", "j", F.round("v", 6).alias("v"))


def q13_gemm_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Two products in a row, each added to what came before."""
    a = symmetric(spark, 10)
    once = tiles.gemm(a, a, a, 0.5, 2.0)
    return tiles.gemm(once, a, once, 1.0, -1.0).select("i", "j", F.round("v", 6).alias("v"))


def plate(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j")).withColumn("v", F.col("j") * 11 % 100 * 0.01)


def q16_sor(spark: SparkSession, sf: str) -> DataFrame:
    return grids.sor(plate(spark, 24), 24, 24, 0.3, 4, 12).select("i", "j", F.round("v", 9).alias("v"))


def q17_jacobi(spark: SparkSession, sf: str) -> DataFrame:
    return grids.jacobi(plate(spark, 12), 0.005).select("i", "j", F.round("v", 9).alias("v"), "rounds")


def q18_stencil(spark: SparkSession, sf: str) -> DataFrame:
    """Two wave steps of a star of reach 2 on a cube."""
    cells = spark.range(10**3).select((F.col("id") % 10).alias("x"), F.expr("id div 10 % 10").alias("y"), F.expr("id div 100").alias("z"))
    u = F.when((F.col("x") == 5) & (F.col("y") == 5) & (F.col("z") == 5), 1.0).otherwise(0.0)
    return grids.stencil_3d(cells.select("x", "y", "z", u.alias("u"), F.lit(0.0).alias("before")), (-0.75, 0.1, 0.025), 2).select("x", "y", "z", F.round("u", 9).alias("u"))


# The scene, a centre and a radius for each sphere, and the light's direction.
SPHERES = ((0.0, 0.0, 3.0, 0.6), (0.4, 0.3, 2.0, 0.3), (-0.5, 0.2, 2.5, 0.35), (0.1, -0.6, 1.5, 0.2))
LIGHT = (0.48, 0.6, -0.64)


def q21_rays(spark: SparkSession, sf: str) -> DataFrame:
    return grids.traced(spark, 64, 48, SPHERES, LIGHT).where("sphere IS NOT NULL").select("x", "y", "sphere", F.round("shade", 6).alias("shade"))


def q28_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Of a chain of items each got by the next two steps, those with gets left: counts of 2 for all but the ends."""
    items = strided_range(spark, 0, 2000, name="k").withColumn("n", F.lit(2).cast("long"))
    gets = strided_range(spark, 2, 2000, name="t").select(F.explode(F.array(F.col("t") - 1, F.col("t") - 2)).alias("k"))
    return reduce.fanout_audit(gets, items, "k").select("k", "gets")


def a6_hot_prefix_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix sums that no key, however hot, makes one task's load."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").cast(TOTAL).alias("v"))
    return reduce.running_in_ranges(rows, ["user_id"], ["ts", "event_id"], F.col("v")).select("event_id", F.col("running").cast("double").alias("running"))


def j5_hot_latest_value(spark: SparkSession, sf: str) -> DataFrame:
    """Latest values of all events as one history, in ranges."""
    events = table(spark, sf, "events").select("ts", "event_id", "event_type", "value")
    return joins.latest_in_ranges(events, ["ts", "event_id"], "event_type", "value", ["click", "view"]).select("event_id", "last_click", "last_view")


QUERIES = {
    "A6_prefix_sum_ranges": a6_hot_prefix_sum, "J5_latest_value_ranges": j5_hot_latest_value, "S1_puts": s1_puts, "S2_tag_puts": s2_tag_puts, "S6_text_blocks": s6_text_blocks, "S8_stored_items": s8_stored_items, "S9_env_get": s9_env_get, "S12_sizes": s12_sizes,
    "S13_reset": s13_reset, "S14_image": s14_image, "S16_graph_spec": s16_graph_spec, "P6_tokens": p6_tokens, "P8_many_steps": p8_many_steps, "P10_parameters": p10_parameters,
    "I2_four_gets": i2_four_gets, "J3_point_join": j3_point_join, "C7_placement": c7_placement, "C12_sequentialize": c12_sequentialize, "C14_range_grain": c14_range_grain,
    "C16_parallel_for": c16_parallel_for, "C24_statistics": c24_statistics, "U2_own_aggregate": u2_own_aggregate, "U8_data_source": u8_data_source, "F1_strings": f_strings,
    "F10_numbers": f_numbers, "F15_complex": f15_complex, "Q10_cholesky": q10_cholesky, "Q11_inverse": q11_inverse, "Q12_matmul_tiles": q12_tiles, "Q13_gemm_chain": q13_gemm_chain,
    "Q16_sor": q16_sor, "Q17_jacobi": q17_jacobi, "Q18_stencil": q18_stencil, "Q21_rays": q21_rays, "Q28_survivors": q28_survivors,
}

CELLS = "SELECT i, j, (CASE WHEN i = j THEN 2.0 * {n} ELSE 0.0 END + (i * j % 5 + least(i, j) % 3))::DOUBLE AS v FROM range({n}) a(i), range({n}) b(j)"
ROUND = "SELECT n, cr, ci, zr * zr - zi * zi + cr AS zr, 2 * zr * zi + ci AS zi FROM ({})"
COMPLEX = "SELECT p_partkey AS n, p_size / 50 - 1 AS cr, p_partkey % 7 / 7 AS ci, p_size / 50 - 1 AS zr, p_partkey % 7 / 7 AS zi FROM part"
WAVE = """
        SELECT a.x, a.y, a.z, CASE WHEN count(b.u) = 12 THEN 2 * a.u - a.before - 0.75::DOUBLE * a.u
          + sum(CASE abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) WHEN 1 THEN 0.1::DOUBLE ELSE 0.025::DOUBLE END * b.u) ELSE a.u END AS u, a.u AS before
        FROM {0} a LEFT JOIN {0} b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) BETWEEN 1 AND 2
          AND (a.x = b.x)::INT + (a.y = b.y)::INT + (a.z = b.z)::INT = 2 GROUP BY a.x, a.y, a.z, a.u, a.before"""
SQL = {
    "A6_prefix_sum_ranges": "SELECT event_id, (sum(value::DECIMAL(38,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS running FROM events",
    "J5_latest_value_ranges": """
        SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w, 0) AS last_click,
          coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 0) AS last_view
        FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "S1_puts": "SELECT c_custkey, c_name FROM customer",
    "S2_tag_puts": "SELECT o_custkey, count(*) * CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 1 END AS n FROM orders GROUP BY o_custkey",
    "S6_text_blocks": "SELECT count(*) AS lines, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM documents",
    "S8_stored_items": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "S9_env_get": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7",
    "S12_sizes": " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS size, count(*) = 0 AS empty FROM {t}" for t in ("customer", "orders", "lineitem")),
    "S13_reset": "SELECT * FROM region WHERE r_regionkey < 2",
    "S14_image": "SELECT -1::BIGINT AS y, 'P3 12 8 255' AS line UNION ALL SELECT y, string_agg(x * 20 || ' ' || y * 30 || ' ' || x + y, ' ' ORDER BY x) FROM range(12) a(x), range(8) b(y) GROUP BY y",
    "S16_graph_spec": """SELECT * FROM (VALUES ('<row>', '::', '(scan)'), ('[table]', '->', '(scan)'), ('(scan)', '->', '[word]'),
        ('<word>', '::', '(count)'), ('[word]', '->', '(count)'), ('(count)', '->', '[total]')) v(source, kind, target)""",
    "P6_tokens": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+'), lambda w: w <> '') AS ws FROM documents)
        SELECT doc_id, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM w""",
    "P8_many_steps": """SELECT n_nationkey::BIGINT AS tag, s AS step, (CASE s WHEN 'double' THEN n_nationkey * 2 WHEN 'square' THEN n_nationkey * n_nationkey ELSE -n_nationkey END)::BIGINT AS out
        FROM nation, (VALUES ('double'), ('square'), ('negative')) v(s)""",
    "P10_parameters": "SELECT p_partkey, f AS factor, (p_size * f)::BIGINT AS out FROM part, (VALUES (3), (5)) v(f)",
    "I2_four_gets": """
        WITH g AS (SELECT o_orderkey // 40 AS i, o_orderkey % 40 AS j, round(o_totalprice * 100)::BIGINT AS v FROM orders)
        SELECT a.i, a.j, coalesce(sum(b.v), 0)::BIGINT AS around FROM g a LEFT JOIN g b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 AND b.i BETWEEN a.i - 1 AND a.i + 1 GROUP BY a.i, a.j""",
    "J3_point_join": "SELECT n_name, count(*) AS events FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "C7_placement": "SELECT user_id, 1::BIGINT AS places, count(*) AS n FROM events GROUP BY user_id",
    "C12_sequentialize": "SELECT t AS tag, row_number() OVER (ORDER BY t DESC) AS turn FROM range(1, 18, 2) r(t)",
    "C14_range_grain": "SELECT p AS parts, sum(t)::BIGINT AS total, count(*) AS n FROM range(0, 100000, 7) r(t), (VALUES (1), (13)) v(p) GROUP BY p",
    "C16_parallel_for": "SELECT i, i * i % 1009 AS out FROM range(10, 1000, 3) r(i)",
    "C24_statistics": "SELECT sum(p_size)::BIGINT AS created, max(p_size)::BIGINT AS widest FROM part",
    "U2_own_aggregate": "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS mean FROM part GROUP BY p_brand",
    "U8_data_source": "SELECT unnest(range(5, 500, 3)) AS tag",
    "F1_strings": """SELECT p_partkey, CASE WHEN strpos(p_name[3:], 'e') > 0 THEN strpos(p_name[3:], 'e') + 2 ELSE 0 END AS found, substr(p_name, 2, 4) AS part,
        CASE WHEN contains(p_name, 'a') THEN length(p_name) - strpos(reverse(p_name), 'a') + 1 ELSE 0 END AS last, p_brand IN ('Brand#11', 'Brand#23') AS member, lower(p_name) AS low FROM part""",
    "F10_numbers": """SELECT p_partkey, round(sqrt(p_retailprice) + exp(-p_retailprice / 1000) + ln(p_retailprice), 6) AS a,
        round(sin(p_retailprice) + cos(p_retailprice) * tan(p_retailprice / 5000) + pow(p_retailprice, 0.3), 6) AS b, least(p_retailprice, 1000.0) AS low, greatest(p_retailprice, 1000.0) AS high,
        p_partkey // 7 AS quotient, p_partkey % 7 AS rest, p_partkey << 3 AS shifted, (p_partkey & 12) | 1 AS bits, floor(p_retailprice / 3)::BIGINT AS floor FROM part""",
    "F15_complex": f"SELECT n AS p_partkey, round(sqrt(zr * zr + zi * zi), 6) AS size FROM ({ROUND.format(ROUND.format(ROUND.format(COMPLEX)))})",
    "Q10_cholesky": CELLS.format(n=12),
    "Q11_inverse": "SELECT i, j, (i = j)::INT::DOUBLE AS v FROM range(12) a(i), range(12) b(j)",
    "Q12_matmul_tiles": f"WITH a AS ({CELLS.format(n=12)}) SELECT x.i, y.j, round(sum(x.v * y.v), 6) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY ALL",
    "Q13_gemm_chain": f"""
        WITH a AS ({CELLS.format(n=10)}), p AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY ALL),
        b AS (SELECT i, j, 0.5 * p.v + 2 * a.v AS v FROM p JOIN a USING (i, j)), q AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM b x JOIN a y ON x.j = y.i GROUP BY ALL)
        SELECT i, j, round(q.v - b.v, 6) AS v FROM q JOIN b USING (i, j)""",
    # Cell by cell in row order: 22 x 22 inner cells, 4 rounds.
    "Q16_sor": """
        WITH RECURSIVE s(t, v) AS (
          SELECT 0, list_transform(range(576), lambda p: (p % 24 * 11 % 100) * 0.01::DOUBLE)
          UNION ALL
          SELECT t + 1, v[:p] || [0.3::DOUBLE / 4 * (v[p + 25] + v[p + 2] + v[p - 23] + v[p]) + (1 - 0.3::DOUBLE) * v[p + 1]] || v[p + 2:]
          FROM (SELECT t, v, (t % 484 // 22 + 1) * 24 + t % 22 + 1 AS p FROM s WHERE t < 1936))
        SELECT p // 24 AS i, p % 24 AS j, round(v[p + 1], 9) AS v FROM s, range(576) r(p) WHERE t = 1936""",
    "Q17_jacobi": """
        WITH RECURSIVE s(k, v, moved) AS (
          SELECT 0, list_transform(range(144), lambda p: (p % 12 * 11 % 100) * 0.01::DOUBLE), 1::DOUBLE
          UNION ALL
          SELECT k + 1, new, list_max(list_transform(range(144), lambda p: abs(new[p + 1] - v[p + 1])))
          FROM (SELECT k, v, list_transform(range(144), lambda p: CASE WHEN p < 12 OR p >= 132 OR p % 12 IN (0, 11) THEN v[p + 1]
            ELSE (v[p - 11] + v[p + 13] + v[p] + v[p + 2]) / 4 END) AS new FROM s WHERE moved >= 0.005))
        SELECT p // 12 AS i, p % 12 AS j, round(v[p + 1], 9) AS v, k AS rounds FROM s, range(144) r(p) WHERE moved < 0.005""",
    "Q18_stencil": f"""
        WITH g AS (SELECT x, y, z, (x = 5 AND y = 5 AND z = 5)::INT::DOUBLE AS u, 0::DOUBLE AS before FROM range(10) a(x), range(10) b(y), range(10) c(z)),
        one AS ({WAVE.format("g")}), two AS ({WAVE.format("one")})
        SELECT x, y, z, round(u, 9) AS u FROM two""",
    "Q21_rays": f"""
        WITH s AS (SELECT * FROM (VALUES {", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE, {r}::DOUBLE)" for k, (x, y, z, r) in enumerate(SPHERES))}) v(k, cx, cy, cz, r)),
        p AS (SELECT x, y, (x + 0.5::DOUBLE) / 64 * 2 - 1 AS px, (y + 0.5::DOUBLE) / 48 * 2 - 1 AS py FROM range(64) a(x), range(48) b(y)),
        h AS (SELECT *, cz - sqrt(r * r - (px - cx) * (px - cx) - (py - cy) * (py - cy)) AS z FROM p, s WHERE r * r - (px - cx) * (px - cx) - (py - cy) * (py - cy) > 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY z, k) AS first FROM h)
        SELECT x, y, k::INT AS sphere, round(greatest(((px - cx) * {LIGHT[0]} + (py - cy) * {LIGHT[1]} + (z - cz) * {LIGHT[2]}) / r, 0), 6) AS shade FROM n WHERE first = 1""",
    "Q28_survivors": "SELECT k, CASE k WHEN 1999 THEN 0 ELSE 1 END::BIGINT AS gets FROM (VALUES (0::BIGINT), (1998), (1999)) v(k)",
}
