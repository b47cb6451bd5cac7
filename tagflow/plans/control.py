"""Callbacks, cancelling, reusable graphs, traces, user reductions and whole-size forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow import model, sources, streaming, tracing
from tagflow.algorithms import grids, recursion, tiles
from tagflow.functions import ascii_lower
from tagflow.graphs import HiddenGraph, SubGraph
from tagflow.model import Graph, ItemTable, TagSet
from tagflow.operators import joins, reduce, steps
from tagflow.plans import recursive
from tagflow.sources import archive, content_chunks, deflated, strided_range, table
from tagflow.storage import fresh


def i8_on_put(spark: SparkSession, sf: str) -> DataFrame:
    """Two callbacks on one collection, told of each tag once though it is put twice: the second one's table."""
    path, told = fresh(spark, "told"), []
    events = table(spark, sf, "events").select("user_id", "event_type")
    tags = TagSet(events, preserve=True).put(events.where("event_type = 'click'"))
    tags = tags.on_put(lambda new: told.append(new.count())).on_put(lambda new: new.groupBy("event_type").agg(F.count("*").alias("users")).write.parquet(path))
    tags.settled()
    return spark.read.parquet(path).withColumn("told", F.lit(told[0]).cast("long"))


def i9_item_on_put(spark: SparkSession, sf: str) -> DataFrame:
    """A callback on items puts to a graph outside: what it was given."""
    path = fresh(spark, "told")
    ItemTable(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"]).on_put(lambda new: new.groupBy("s_nationkey").agg(F.count("*").alias("n")).write.parquet(path)).settled()
    return spark.read.parquet(path)


def i8_stream_on_put(spark: SparkSession, sf: str) -> DataFrame:
    """The same on a stream."""
    path = fresh(spark, "told")
    arriving = streaming.stream(spark, f"{sf}/events.parquet", table(spark, sf, "events"))
    streaming.on_put(streaming.memoized(arriving.select("user_id", "event_type"), "user_id", "event_type"), lambda new: new.write.mode("append").parquet(path))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("users"))


def c11_cancel_all(spark: SparkSession, sf: str) -> DataFrame:
    """What runs of one collection's tags: as they are, some cancelled, all cancelled, and when that is forgotten. Tags put later are cancelled too."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tag"))
    tags = TagSet(nations.where("tag < 20"))
    some = tags.cancel(strided_range(spark, 0, 40, 2)).put(nations.where("tag >= 20"))
    states = {"some": some, "all": some.cancel_all(), "forgotten": some.cancel_all().uncancel(), "none": tags}
    out = None
    for name, state in states.items():
        one = state.prescribe(lambda t: t.agg(F.count("*").alias("runs"), F.coalesce(F.sum("tag"), F.lit(0)).alias("total"))).withColumn("state", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("state", "runs", "total")


def s10_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All items with their keys."""
    return ItemTable(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_partkey"]).scan()


def s11_scan_tags(spark: SparkSession, sf: str) -> DataFrame:
    """An iteration over tags meets those of a memoizing collection only."""
    rows = table(spark, sf, "events").select("user_id")
    kept, lost = TagSet(rows, preserve=True).scan(), TagSet(rows).scan()
    return kept.agg(F.count("*").alias("n")).select(F.lit("preserved").alias("kind"), "n").unionByName(lost.agg(F.count("*").alias("n")).select(F.lit("not").alias("kind"), "n"))


def c2_describe(spark: SparkSession, sf: str) -> DataFrame:
    """A graph's declarations, a line each."""
    g = Graph("fib").prescribes("tags", "fib").consumes("fib", "fibs").produces("fib", "fibs").controls("env", "tags")
    return spark.createDataFrame(list(enumerate(g.describe().split("\n"))), "line long, said string")


def c13_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes by the collection itself, before and after it is quiet, and after a reset."""
    items = ItemTable(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    done = items.settled()
    rows = [("items", items.size(), items.empty()), ("settled", done.size(), done.empty()), ("reset", done.reset().size(), done.reset().empty())]
    return spark.createDataFrame(rows, "state string, size long, empty boolean")


def u7_own_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Keys under the user's equality: brands without their last digit, as a struct."""
    parts = table(spark, sf, "part").select("p_partkey", F.struct(F.expr("left(p_brand, length(p_brand) - 1)").alias("maker"), F.col("p_size")).alias("k"))
    named = parts.withColumn("c", model.canonical(F.col("k")))
    return named.groupBy("c").agg(F.min("k.maker").alias("maker"), F.min("k.p_size").alias("size"), F.count("*").alias("n")).drop("c")


def j1_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Sides in which tags are put several times: each pair comes once."""
    a, b = table(spark, sf, "nation").select("n_regionkey"), table(spark, sf, "orders").select("o_orderpriority")
    return joins.cross_product(a.unionByName(a), b)


def c8_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    """Items wanted by every step go to all places if they are small."""
    nations = joins.everywhere(table(spark, sf, "nation").select("n_nationkey", "n_name"))
    return joins.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), nations, {"n_nationkey": F.col("c_nationkey")}).groupBy("n_name").agg(F.count("*").alias("customers"))


def c15_range_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A range of keys for each supplier as one tag, cut at a grain; a step runs on each piece."""
    ranges = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("first"), (F.col("s_suppkey") * 10 + F.col("s_nationkey")).cast("long").alias("last"))
    return steps.split_ranges(ranges, "first", "last", 7).select("s_suppkey", "first", "last", ((F.col("first") + F.col("last") - 1) * (F.col("last") - F.col("first")) / 2).cast("long").alias("total"))


def c21_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Two contexts at once, with a collection of the same name each."""
    paths = []
    for n, rule in enumerate(("o_totalprice < 100000", "o_totalprice >= 100000")):
        context = spark.newSession()
        table(context, sf, "orders").where(rule).createOrReplaceTempView("mine")
        paths.append(fresh(spark, "context"))
        context.sql(f"SELECT {n} AS context, count(*) AS orders FROM mine").write.parquet(paths[-1])
    return spark.read.parquet(*paths)


def c22_fused(spark: SparkSession, sf: str) -> DataFrame:
    """A step that is its own tag collection, called by another."""
    square = model.fused(lambda t: t.select("tag", (F.col("tag") * F.col("tag")).alias("out")))
    half = model.fused(lambda t: square(t.where("tag % 2 = 0").select(F.expr("tag div 2").alias("tag"))))
    return half(table(spark, sf, "part").select(F.col("p_partkey").alias("tag")))


def c23_trace(spark: SparkSession, sf: str) -> DataFrame:
    """What was put and got, as rows."""
    trace = tracing.Trace()
    tags = trace.put("numbers", table(spark, sf, "nation").select("n_nationkey"), ["n_nationkey"])
    items = trace.put("regions", table(spark, sf, "region").select("r_regionkey"), ["r_regionkey"])
    trace.put("regions", joins.lookup(tags, items, {"r_regionkey": F.col("n_nationkey")}), ["n_nationkey"], "get")
    return trace.rows().groupBy("event", "collection").agg(F.count("*").alias("n"), F.min("tag").alias("first"))


def c25_timer(spark: SparkSession, sf: str) -> DataFrame:
    """The log of a step's times: its rows are those that went through."""
    words = table(spark, sf, "documents").select(F.explode(F.split(ascii_lower(F.col("text")), r"\s+")).alias("word"))
    log = tracing.timed(words, "words")
    return log.groupBy("step").agg(F.sum("rows").alias("rows"), (F.min("seconds") >= 0).alias("timed"))


class CountByKey(SubGraph):
    """A generic graph: tags by a key of the user's, counted and summed with a step of the user's."""

    inputs = {"tags": ("tag",)}
    outputs = ("counts", "large")

    def __init__(self, key, step, least: int):
        self.key, self.step, self.least = key, step, least

    def build(self, tags: DataFrame) -> dict[str, DataFrame]:
        counts = tags.select(self.key.alias("key"), self.step.alias("v")).groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
        return {"counts": counts, "large": counts.where(F.col("n") >= self.least)}


def u4_generic_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Two instances of one generic graph, the second one fed by the first."""
    tags = table(spark, sf, "part").select(F.col("p_partkey").alias("tag"), "p_size")
    first = CountByKey(F.col("p_size"), F.col("tag"), 1)(tags=tags)["large"]
    second = CountByKey(F.col("n"), F.col("tag"), 2)
    return second(tags=first.select(F.col("key").alias("tag"), "n"))["large"].select("key", "n", "total")


def u5_hidden_graph(spark: SparkSession, sf: str) -> DataFrame:
    """What a graph behind a stream makes of the events."""
    arriving = streaming.stream(spark, f"{sf}/events.parquet", table(spark, sf, "events"))
    hidden = HiddenGraph(lambda batch: batch.where("value % 4 >= 1").select((F.col("event_id") * 1000).alias("tag"), (F.col("value") + 1).alias("out")), "tag long, out double")
    return hidden.start(arriving).wait().select("tag", F.round("out", 6).alias("out"))


def a5_map_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Both operators of the user's: words by their length, and the longest text that has one."""
    emit = lambda docs: docs.select(F.explode(F.split("text", r"\s+")).alias("word"), F.length("text").cast("long").alias("value")).where("word <> ''").select(F.length("word").cast("long").alias("key"), "value")
    return reduce.map_reduce(table(spark, sf, "documents"), emit, F.max("value"))


def u2_own_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """A reduction that Spark has no aggregate for: the greatest common divisor of each key's numbers."""
    lines = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 6).alias("v"))
    return reduce.reduce_with(lines, ["l_partkey"], "v", np.gcd.reduce, "long")


def q20_content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of text cut by content, fingerprints, and the first of equal chunks compressed."""
    blocks = table(spark, sf, "documents").select(F.col("doc_id").alias("block"), F.col("text").alias("data"))
    out = deflated(archive(content_chunks(blocks), ["block", "item"]))
    return out.select("block", "item", "fingerprint", "is_first", F.octet_length("payload").cast("long").alias("stored"))


def q9_tiled(spark: SparkSession, sf: str) -> DataFrame:
    """The same roads as Q9, by tiles of 5 x 5 nations."""
    cells = recursive.roads(spark, sf).groupBy("i", "j").agg(F.min("d").alias("v"))
    # Every tile is there, empty ones hold no road.
    all_tiles = spark.range(25 * 25).select(F.expr("id div 25").alias("i"), (F.col("id") % 25).alias("j"), F.lit(float("inf")).alias("v"))
    filled = cells.unionByName(all_tiles).groupBy("i", "j").agg(F.min("v").alias("v"))
    out = tiles.to_cells(tiles.shortest_paths(tiles.to_tiles(filled, 5, float("inf")), 25, 5), 5)
    return out.where("i <> j AND v < double('inf')").select("i", "j", F.col("v").alias("d"))


def q15_heat(spark: SparkSession, sf: str) -> DataFrame:
    """Six steps in time of one rod."""
    rod = table(spark, sf, "orders").select(F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("u"))
    return grids.heat(rod, "x", "u", 0.25, 6).select("x", F.round("u", 4).alias("u"))


def q18_star(spark: SparkSession, sf: str) -> DataFrame:
    """Two wave steps of the star of 25 points on a cube."""
    cells = spark.range(12**3).select((F.col("id") % 12).alias("x"), F.expr("id div 12 % 12").alias("y"), F.expr("id div 144").alias("z"))
    u = (F.col("x") * 7 + F.col("y") * 5 + F.col("z") * 3) % 11 * 0.1
    return grids.stencil_3d(cells.select("x", "y", "z", u.alias("u"), F.lit(0.0).alias("before")), STAR, 2).select("x", "y", "z", F.round("u", 9).alias("u"))


STAR = (-0.75, 0.1, 0.025, 0.01, 0.005)


def q4_ten(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.queens(spark, 10).agg(F.count("*").alias("solutions"))


def q1_by_tags(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.fibonacci_by_tags(spark, 23).select("tag", F.col("fib").cast("long").alias("fib"))


def q2_by_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return recursion.primes_by_ranges(spark, 100_000)


def q3_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same sum from rows of counts."""
    rows = grids.mandelbrot_rows(spark, 100, 100, 10_000).select("i", F.posexplode("counts").alias("j", "count"))
    return grids.checksum(rows, 100, 10_000)


def c4_freed(spark: SparkSession, sf: str) -> DataFrame:
    """Items are stored, got as often as declared, and freed: what was got, and what is left."""
    items = ItemTable(table(spark, sf, "nation").select("n_nationkey", F.lit(1).cast("long").alias("n")), ["n_nationkey"]).settled()
    gets = table(spark, sf, "nation").select("n_nationkey")
    over = reduce.fanout_audit(gets, items.items(), "n_nationkey").count()
    got = joins.lookup(gets, items.items(), ["n_nationkey"]).count()
    left = items.free()
    return spark.createDataFrame([(got, over, left.size())], "got long, differing long, remaining long")


def q28_range_depends(spark: SparkSession, sf: str) -> DataFrame:
    """A range of tags whose steps wait for the items of a chain: item t comes from item t - 1, put behind the gets."""
    chain = reduce.running_in_ranges(strided_range(spark, 0, 1000, name="t").withColumn("one", F.lit(0)), ["one"], ["t"], F.lit(2), "item")
    waiting = strided_range(spark, 0, 1000, 10, name="t")
    return joins.lookup(waiting, chain.select((F.col("t")).alias("k"), "item"), {"k": F.col("t")}).select("t", "item")


SPEC = """
    <size_t pairs>;                       // a declaration
    env -> <sizes>, [grid],
           [weights: row];                // over two lines
    <sizes> :: (split), (count); [grid], [weights: row] -> (split) -> <pairs>;
    <pairs> :: (relax);
    [grid], [weights: row] -> (relax) -> [grid], [changes: row, col];
    [changes] -> (count) -> [total]; [total] -> env;
"""


def s16_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A graph with lists, an environment, tag functions and several statements a line; how many edges each pair has."""
    edges = sources.graph_edges(SPEC)
    faults = spark.createDataFrame([(len(sources.graph_faults(edges)),)], "faults long")
    counted = spark.createDataFrame(edges, "source string, kind string, target string").groupBy("source", "kind", "target").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(faults))


def s6_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Text files in blocks with their number; no line is lost or met twice at a border."""
    path = sources.scratch(spark, "text")
    table(spark, sf, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\r\n]+", " ")).alias("value")).write.text(path)
    rows = sources.text_files(spark, path)
    per_block = rows.groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum(F.split_part("text", F.lit(" "), F.lit(1)).cast("long")).alias("ids"))
    return per_block.agg(F.sum("lines").alias("lines"), F.sum("ids").alias("ids"))


QUERIES = {
    "I8_on_put": i8_on_put, "I9_item_on_put": i9_item_on_put, "I8_stream_on_put": i8_stream_on_put, "C11_cancel_all": c11_cancel_all, "S10_scan": s10_scan, "S11_scan_tags": s11_scan_tags,
    "C2_describe": c2_describe, "C13_settled": c13_settled, "U7_own_equality": u7_own_equality, "J1_duplicates": j1_duplicates, "C8_everywhere": c8_everywhere, "C15_range_tags": c15_range_tags,
    "C21_contexts": c21_contexts, "C22_fused": c22_fused, "C23_trace": c23_trace, "C25_timer": c25_timer, "U4_generic_graph": u4_generic_graph, "U5_hidden_graph": u5_hidden_graph,
    "A5_map_reduce": a5_map_reduce, "U2_own_reduce": u2_own_reduce, "Q20_content_dedup": q20_content_dedup, "Q9_tiled": q9_tiled, "Q15_heat": q15_heat, "Q18_star": q18_star, "Q4_ten": q4_ten,
    "S6_numbered_blocks": s6_blocks, "Q1_fib_tags": q1_by_tags, "Q2_primes_ranges": q2_by_ranges, "Q3_mandelbrot_rows": q3_rows, "C4_freed": c4_freed, "S16_graph_lists": s16_lists, "Q28_range_depends": q28_range_depends,
}

HEAT = """SELECT x, CASE WHEN lag(u) OVER w IS NULL OR lag(x) OVER w <> x - 1 OR lead(u) OVER w IS NULL OR lead(x) OVER w <> x + 1 THEN u
    ELSE u + 0.25 * (lag(u) OVER w - 2 * u + lead(u) OVER w) END AS u FROM ({}) WINDOW w AS (ORDER BY x)"""
ROD = "SELECT o_orderkey AS x, o_totalprice AS u FROM orders"
for _step in range(6):
    ROD = HEAT.format(ROD)
STARRED = """
        SELECT a.x, a.y, a.z, CASE WHEN count(b.u) = 24 THEN 2 * a.u - a.before - 0.75::DOUBLE * a.u
          + sum(CASE abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.025::DOUBLE WHEN 3 THEN 0.01::DOUBLE ELSE 0.005::DOUBLE END * b.u) ELSE a.u END AS u, a.u AS before
        FROM {0} a LEFT JOIN {0} b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) BETWEEN 1 AND 4
          AND (a.x = b.x)::INT + (a.y = b.y)::INT + (a.z = b.z)::INT = 2 GROUP BY a.x, a.y, a.z, a.u, a.before"""
SQL = {
    "I8_on_put": "SELECT event_type, count(*) AS users, sum(count(*)) OVER ()::BIGINT AS told FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type",
    "I9_item_on_put": "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey",
    "I8_stream_on_put": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "C11_cancel_all": """
        SELECT s AS state, count(t) AS runs, coalesce(sum(t), 0)::BIGINT AS total FROM (VALUES ('some'), ('all'), ('forgotten'), ('none')) v(s)
        LEFT JOIN (SELECT n_nationkey AS t FROM nation) ON (s = 'some' AND t % 2 = 1) OR s = 'forgotten' OR (s = 'none' AND t < 20) GROUP BY s""",
    "S10_scan": "SELECT p_partkey, p_brand FROM part",
    "S11_scan_tags": "SELECT 'preserved' AS kind, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'not', 0",
    "C2_describe": "SELECT * FROM (VALUES (0::BIGINT, 'fib'), (1, '  tags prescribes fib'), (2, '  fibs is consumed by fib'), (3, '  fib produces fibs'), (4, '  env controls tags')) v(line, said)",
    "C13_settled": "SELECT s AS state, CASE WHEN s = 'reset' THEN 0 ELSE n END AS size, s = 'reset' AS empty FROM (SELECT count(*) AS n FROM orders), (VALUES ('items'), ('settled'), ('reset')) v(s)",
    "U7_own_equality": "SELECT p_brand[:-2] AS maker, p_size AS size, count(*) AS n FROM part GROUP BY ALL",
    "J1_duplicates": "SELECT * FROM (SELECT DISTINCT n_regionkey FROM nation), (SELECT DISTINCT o_orderpriority FROM orders)",
    "C8_everywhere": "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "C15_range_tags": """
        WITH p AS (SELECT s_suppkey, unnest(range(s_suppkey * 10, s_suppkey * 10 + s_nationkey, 7)) AS f, s_suppkey * 10 + s_nationkey AS l FROM supplier)
        SELECT s_suppkey, f AS first, least(f + 7, l) AS last, ((f + least(f + 7, l) - 1) * (least(f + 7, l) - f) // 2)::BIGINT AS total FROM p""",
    "C21_contexts": "SELECT (o_totalprice >= 100000)::INT AS context, count(*) AS orders FROM orders GROUP BY ALL",
    "C22_fused": "SELECT p_partkey // 2 AS tag, (p_partkey // 2) * (p_partkey // 2) AS out FROM part WHERE p_partkey % 2 = 0",
    "C23_trace": """
        SELECT 'put' AS event, 'numbers' AS collection, count(*) AS n, '{"n_nationkey":0}' AS first FROM nation UNION ALL SELECT 'put', 'regions', count(*), '{"r_regionkey":0}' FROM region
        UNION ALL SELECT 'get', 'regions', count(*), '{"n_nationkey":0}' FROM nation JOIN region ON n_nationkey = r_regionkey""",
    "C25_timer": "SELECT 'words' AS step, sum(len(string_split_regex(text, '\\s+')))::BIGINT AS rows, true AS timed FROM documents",
    "U4_generic_graph": "WITH a AS (SELECT p_size AS tag, count(*) AS n FROM part GROUP BY p_size) SELECT n AS key, count(*) AS n, sum(tag)::BIGINT AS total FROM a GROUP BY n HAVING count(*) >= 2",
    "U5_hidden_graph": "SELECT event_id * 1000 AS tag, round(value + 1, 6) AS out FROM events WHERE value % 4 >= 1",
    "A5_map_reduce": """
        SELECT length(w) AS key, max(n)::BIGINT AS value FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w, length(text) AS n FROM documents) WHERE w <> '' GROUP BY length(w)""",
    "U2_own_reduce": "SELECT l_partkey, list_reduce(list(l_orderkey * 6), lambda a, b: gcd(a, b))::BIGINT AS v FROM lineitem GROUP BY l_partkey",
    "Q15_heat": f"SELECT x, round(u, 4) AS u FROM ({ROD})",
    "Q18_star": f"""
        WITH g AS (SELECT x, y, z, (x * 7 + y * 5 + z * 3) % 11 * 0.1::DOUBLE AS u, 0::DOUBLE AS before FROM range(12) a(x), range(12) b(y), range(12) c(z)),
        one AS ({STARRED.format("g")}), two AS ({STARRED.format("one")})
        SELECT x, y, z, round(u, 9) AS u FROM two""",
    "Q4_ten": """
        WITH RECURSIVE q(r, a, b, c) AS (SELECT 0, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
          SELECT r + 1, a | (1::BIGINT << k), (b | (1::BIGINT << k)) << 1, (c | (1::BIGINT << k)) >> 1 FROM q, range(10) x(k)
          WHERE r < 10 AND ((a | b | c) >> k) & 1 = 0)
        SELECT count(*) AS solutions FROM q WHERE r = 10""",
    "Q1_fib_tags": "WITH RECURSIVE f(i, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, b, a + b FROM f WHERE i < 23) SELECT i AS tag, a AS fib FROM f",
    "Q2_primes_ranges": recursive.SQL["Q2_primes"],
    "Q3_mandelbrot_rows": recursive.SQL["Q3_mandelbrot"],
    "S16_graph_lists": """SELECT *, 1::BIGINT AS n, 0::BIGINT AS faults FROM (VALUES ('env', '->', '<sizes>'), ('env', '->', '[grid]'), ('env', '->', '[weights]'), ('<sizes>', '::', '(split)'),
        ('<sizes>', '::', '(count)'), ('[grid]', '->', '(split)'), ('[weights]', '->', '(split)'), ('(split)', '->', '<pairs>'), ('<pairs>', '::', '(relax)'), ('[grid]', '->', '(relax)'),
        ('[weights]', '->', '(relax)'), ('(relax)', '->', '[grid]'), ('(relax)', '->', '[changes]'), ('[changes]', '->', '(count)'), ('(count)', '->', '[total]'), ('[total]', '->', 'env')) v(source, kind, target)""",
    "C4_freed": "SELECT count(*) AS got, 0::BIGINT AS differing, 0::BIGINT AS remaining FROM nation",
    "Q28_range_depends": "SELECT t, (t + 1) * 2 AS item FROM range(0, 1000, 10) r(t)",
    "Q9_tiled": recursive.SQL["Q9_shortest_path"],
    "S6_numbered_blocks": "SELECT count(*) AS lines, sum(doc_id)::BIGINT AS ids FROM documents",
}
