"""Steps, gets, cross products, reductions and lifecycle over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagflow.algorithms import grids
from tagflow.model import ItemTable, TagSet
from tagflow.operators import joins, ranges, reduce, steps
from tagflow.sources import archive, strided_range, table

TOTAL = "decimal(38,2)"


def money(c: str):
    return F.sum(F.col(c).cast(TOTAL)).cast("double")


def p1_producer_consumer(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "part").select(F.col("p_partkey").alias("tag"))
    made = steps.apply_step(tags, item=F.col("tag") * 10)
    return steps.apply_step(made, out=F.col("item") + 3).select("tag", "out")


def p2_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size % 2 = 1").select("p_partkey", "p_size")


def p3_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return steps.cascade(table(spark, sf, "documents").select("doc_id", "text"), F.contains("text", F.lit("th")), F.contains("text", F.lit("on")), F.contains("text", F.lit("ea"))).select("doc_id")


def p4_generate(spark: SparkSession, sf: str) -> DataFrame:
    return steps.generate(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("n")), F.lit(1).cast("long"), F.col("n")).select("p_partkey", "i")


def p5_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.lpad(F.bin("event_id"), 24, "0").alias("s"))
    return steps.runs(rows, "s").where(F.length("span") % 2 == 1).select("event_id", F.col("pos").cast("long").alias("pos"), "span")


def p7_route(spark: SparkSession, sf: str) -> DataFrame:
    out = steps.route(table(spark, sf, "events").select("event_id", "value"), {"low": F.col("value") < 50, "high": F.col("value") >= 50, "top": F.col("value") >= 90})
    parts = [df.select("event_id", F.lit(name).alias("route")) for name, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def s3_range_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A range put bypasses memoization, a single tag does not."""
    tags = TagSet(strided_range(spark, 0, 0), preserve=False).put_range(spark, 0, 100, 3).put_range(spark, 50, 60)
    return tags.tags().groupBy("tag").agg(F.count("*").alias("n"))


def s4_strided_range(spark: SparkSession, sf: str) -> DataFrame:
    return strided_range(spark, 1, 10, 2)


def i1_get(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    got = joins.lookup(orders.select("o_orderkey", "o_custkey"), customers.select("c_custkey", "c_name"), {"c_custkey": F.col("o_custkey")})
    return got.select("o_orderkey", "c_name")


def i3_boundary_get(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours of each line of an order, the line's own quantity beyond the ends."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(money("l_quantity").alias("q"))
    near = grids.neighbours(lines, ((0, -1), (0, 1)), ("l_orderkey", "l_linenumber"), "q")
    return near.select("l_orderkey", "l_linenumber", (grids.boundary(F.col("n0"), F.col("q")) + F.col("q") + grids.boundary(F.col("n1"), F.col("q"))).alias("total"))


def i4_unsafe_get(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return joins.lookup(table(spark, sf, "documents").select("doc_id"), labels, ["doc_id"], "flag").select("doc_id", "quality", "found")


def i5_all_gets(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    with_part = joins.lookup(lines, table(spark, sf, "part").select("p_partkey", "p_brand"), {"p_partkey": F.col("l_partkey")})
    return joins.lookup(with_part, table(spark, sf, "supplier").select("s_suppkey", "s_name"), {"s_suppkey": F.col("l_suppkey")}).groupBy("p_brand", "s_name").agg(F.count("*").alias("n"))


def m1_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return ItemTable(events, ["user_id"], "first", ["ts", "event_id"]).items().select("user_id", "event_id", "event_type")


def m1_distinct_puts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name")
    return ItemTable(pairs, ["r_regionkey"], "distinct").items()


def m3_getcount_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose orders are not as many as declared, four."""
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(4).cast("long").alias("n"))
    return reduce.fanout_audit(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), items, "k")


def m9_stalled_steps(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.stalled(table(spark, sf, "customer").select("c_custkey", "c_name"), items, ["c_custkey"])


def c3_memoize(spark: SparkSession, sf: str) -> DataFrame:
    return TagSet(table(spark, sf, "events").select("user_id", "event_type"), preserve=True).tags()


def c5_unpreserved(spark: SparkSession, sf: str) -> DataFrame:
    """Without memoization a tag put twice runs its step twice."""
    tags = TagSet(table(spark, sf, "events").select("user_id", "event_type"))
    return tags.prescribe(lambda t: t.groupBy("user_id", "event_type").agg(F.count("*").alias("runs")))


def c11_cancel(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.cancel(orders, gone, ["o_orderkey"])


def j1_cross(spark: SparkSession, sf: str) -> DataFrame:
    return joins.cross_product(table(spark, sf, "region").select("r_regionkey"), table(spark, sf, "nation").select("n_nationkey"))


def j2_chained_cross(spark: SparkSession, sf: str) -> DataFrame:
    a, b = strided_range(spark, 0, 16, name="a"), strided_range(spark, 0, 16, name="b")
    c = joins.cross_product(a, b).select(F.struct("a", "b").alias("c"))
    return joins.cross_product(b, c).select("b", F.col("c.a").alias("c_a"), F.col("c.b").alias("c_b"))


def j5_latest_value(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return joins.latest_values(events, ["ts", "event_id"], "event_type", "value", ["click", "view", "purchase"], by=["user_id"]).select("event_id", "last_click", "last_view", "last_purchase")


def a1_reduce_selected(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return reduce.reduce_items(lines, {"l_orderkey": F.col("l_orderkey")}, money("l_quantity"), F.col("l_linenumber") <= 4, flush=True)


def a1c_reduce_counted(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).cast("long").alias("n"))
    return reduce.reduce_items(table(spark, sf, "lineitem"), {"k": F.col("l_orderkey")}, money("l_quantity"), counts=counts, identity=0.0)


def a1e_reduce_done_flag(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1000).cast("long").alias("n"))
    return reduce.reduce_items(table(spark, sf, "lineitem"), {"k": F.col("l_orderkey")}, money("l_quantity"), counts=counts, identity=0.0)


def a1h_reduce_nothing(spark: SparkSession, sf: str) -> DataFrame:
    """Customers expected to have no order, with the identity."""
    counts = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("n"))
    return reduce.reduce_items(table(spark, sf, "orders"), {"k": F.col("o_custkey")}, money("o_totalprice"), counts=counts, identity=0.0)


def a2_reduce_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Ones on 32 x 32: rows below 24 summed by column, then all: 768."""
    cells = spark.range(32 * 32).select(F.expr("id div 32").alias("i"), (F.col("id") % 32).alias("j"), F.lit(1).cast("long").alias("v"))
    rows = reduce.reduce_items(cells, {"j": F.col("j")}, F.sum("v"), F.col("i") < 24, flush=True)
    return rows.agg(F.sum("value").alias("total"), F.count("*").alias("columns"))


def a2_chained(spark: SparkSession, sf: str) -> DataFrame:
    by_supplier = reduce.reduce_items(table(spark, sf, "lineitem"), {"l_suppkey": F.col("l_suppkey")}, F.sum(F.col("l_quantity").cast(TOTAL)), flush=True)
    return by_supplier.agg(F.sum("value").cast("double").alias("total"), F.count("*").alias("suppliers"), F.sum("n_reduced").alias("items"))


def a5_mapreduce_sum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"), F.count("*").alias("n"))


def a6_prefix_sum(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").cast(TOTAL).alias("v"))
    return reduce.running(rows, ["user_id"], ["ts", "event_id"], F.col("v")).select("event_id", F.col("running").cast("double").alias("running"))


def a6_row_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Values 10 row + col on 3 x 5 summed along each row: 65, 115, 165 at the end."""
    cells = spark.range(15).select((F.expr("id div 5") + 1).alias("row"), (F.col("id") % 5 + 1).alias("col"))
    return reduce.running(cells, ["row"], ["col"], 10 * F.col("row") + F.col("col"))


def a7_reduce_until(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").cast(TOTAL).alias("v"))
    return reduce.reduce_until(rows, ["user_id"], ["ts", "event_id"], F.col("v"), 200).select("user_id", "event_id", F.col("v").cast("double").alias("value"))


def a8_max_change(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = table(spark, sf, "events").select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("d"))
    return moved.groupBy("user_id").agg(F.round(F.max("d"), 6).alias("delta"))


def a9_tree_stats(spark: SparkSession, sf: str) -> DataFrame:
    kids = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return kids.agg(F.count("*").alias("parents"), F.sum("n").alias("leaves"), F.max("n").alias("widest"))


def q7_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The rank of every order by price: ranges are sorted apart and numbered by the ranges before them."""
    return ranges.ranked(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


def q20_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chunks: fingerprint, and whether this is the first. Q20_content_dedup cuts by content and compresses."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("block"), F.posexplode(F.split("text", "\n")).alias("item", "data"))
    out = archive(chunks.select("block", F.col("item").cast("long").alias("item"), "data"), ["block", "item"])
    return out.select("block", "item", "fingerprint", "is_first", F.length("payload").cast("long").alias("payload_chars"))


def q24_chain(spark: SparkSession, sf: str) -> DataFrame:
    """item(t) = t + item(t - 1), item(-1) = -1, over the events of each user in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.row_number().over(w) - 1).cast("long").alias("t"))
    return reduce.running(rows, ["user_id"], ["t"], F.col("t")).select("event_id", "t", (F.col("running") - 1).alias("item"))


def q27_actor(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") + F.row_number().over(w) - 1, 6).alias("out"))


QUERIES = {
    "P1_producer_consumer": p1_producer_consumer, "P2_filter": p2_filter, "P3_cascade": p3_cascade, "P4_generate": p4_generate, "P5_spans": p5_spans,
    "P7_route": p7_route, "S3_range_tags": s3_range_tags, "S4_strided_range": s4_strided_range, "I1_get": i1_get, "I3_boundary_get": i3_boundary_get,
    "I4_unsafe_get": i4_unsafe_get, "I5_all_gets": i5_all_gets, "M1_first_wins": m1_first_wins, "M1_distinct_puts": m1_distinct_puts,
    "M3_getcount_audit": m3_getcount_audit, "M9_stalled_steps": m9_stalled_steps, "C3_memoize": c3_memoize, "C3_unpreserved": c5_unpreserved,
    "C11_cancel": c11_cancel, "J1_cross": j1_cross, "J2_chained_cross": j2_chained_cross, "J5_latest_value": j5_latest_value,
    "A1_reduce_selected": a1_reduce_selected, "A1c_reduce_counted": a1c_reduce_counted, "A1e_reduce_done_flag": a1e_reduce_done_flag,
    "A1h_reduce_nothing": a1h_reduce_nothing, "A2_reduce_2d": a2_reduce_2d, "A2_chained": a2_chained, "A5_mapreduce_sum": a5_mapreduce_sum,
    "A6_prefix_sum": a6_prefix_sum, "A6_row_sums": a6_row_sums, "A7_reduce_until": a7_reduce_until, "A8_max_change": a8_max_change,
    "A9_tree_stats": a9_tree_stats, "Q7_sort": q7_sort, "Q20_dedup": q20_dedup, "Q24_chain": q24_chain, "Q27_actor": q27_actor,
}

EVENT_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
SQL = {
    "P1_producer_consumer": "SELECT p_partkey AS tag, p_partkey * 10 + 3 AS out FROM part",
    "P2_filter": "SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 1",
    "P3_cascade": "SELECT doc_id FROM documents WHERE contains(text, 'th') AND contains(text, 'on') AND contains(text, 'ea')",
    "P4_generate": "SELECT p_partkey, unnest(range(1, p_size::BIGINT + 1)) AS i FROM part",
    "P5_spans": """
        WITH c AS (SELECT event_id, lpad(bin(event_id), 24, '0') AS s FROM events),
        p AS (SELECT event_id, s, unnest(range(1, 25)) AS k FROM c),
        f AS (SELECT *, CASE WHEN k = 1 OR s[k] <> s[k - 1] THEN 1 ELSE 0 END AS starts FROM p),
        g AS (SELECT *, sum(starts) OVER (PARTITION BY event_id ORDER BY k) AS run FROM f)
        SELECT event_id, min(k) - 1 AS pos, string_agg(s[k], '' ORDER BY k) AS span FROM g GROUP BY event_id, run HAVING count(*) % 2 = 1""",
    "P7_route": "SELECT event_id, r AS route FROM events, (VALUES ('low'), ('high'), ('top')) v(r) WHERE (r = 'low' AND value < 50) OR (r = 'high' AND value >= 50) OR (r = 'top' AND value >= 90)",
    "S3_range_tags": "SELECT tag, count(*) AS n FROM (SELECT unnest(range(0, 100, 3)) AS tag UNION ALL SELECT unnest(range(50, 60))) GROUP BY tag",
    "S4_strided_range": "SELECT unnest(range(1, 10, 2)) AS tag",
    "I1_get": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "I3_boundary_get": """
        WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::DECIMAL(38,2))::DOUBLE AS q FROM lineitem GROUP BY ALL)
        SELECT a.l_orderkey, a.l_linenumber, coalesce(w.q, a.q) + a.q + coalesce(e.q, a.q) AS total
        FROM l a LEFT JOIN l w ON w.l_orderkey = a.l_orderkey AND w.l_linenumber = a.l_linenumber - 1
        LEFT JOIN l e ON e.l_orderkey = a.l_orderkey AND e.l_linenumber = a.l_linenumber + 1""",
    "I4_unsafe_get": "SELECT d.doc_id, quality, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "I5_all_gets": "SELECT p_brand, s_name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    "M1_first_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "M1_distinct_puts": "SELECT DISTINCT r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "M3_getcount_audit": "SELECT c_custkey AS k, 4::BIGINT AS n, count(o_orderkey) AS gets FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 4",
    "M9_stalled_steps": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "C3_memoize": "SELECT DISTINCT user_id, event_type FROM events",
    "C3_unpreserved": "SELECT user_id, event_type, count(*) AS runs FROM events GROUP BY ALL",
    "C11_cancel": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "J1_cross": "SELECT r_regionkey, n_nationkey FROM region, nation",
    "J2_chained_cross": "SELECT b.b, x.a AS c_a, y.b AS c_b FROM range(16) b(b), range(16) x(a), range(16) y(b)",
    "J5_latest_value": f"""
        SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w, 0) AS last_click,
          coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 0) AS last_view,
          coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w, 0) AS last_purchase
        FROM events WINDOW w AS ({EVENT_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "A1_reduce_selected": "SELECT l_orderkey, sum(l_quantity::DECIMAL(38,2))::DOUBLE AS value, count(*) AS n_reduced FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_orderkey",
    "A1c_reduce_counted": """
        SELECT o_orderkey AS k, coalesce(sum(l_quantity::DECIMAL(38,2)), 0)::DOUBLE AS value, count(l_orderkey) AS n_reduced
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) = o_orderkey % 7 + 1""",
    "A1e_reduce_done_flag": """
        SELECT o_orderkey AS k, sum(l_quantity::DECIMAL(38,2))::DOUBLE AS value, count(*) AS n_reduced
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus HAVING o_orderstatus = 'F' OR count(*) = 1000""",
    "A1h_reduce_nothing": "SELECT c_custkey AS k, 0.0::DOUBLE AS value, 0::BIGINT AS n_reduced FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "A2_reduce_2d": "SELECT 768::BIGINT AS total, 32::BIGINT AS columns",
    "A2_chained": "SELECT sum(l_quantity::DECIMAL(38,2))::DOUBLE AS total, count(DISTINCT l_suppkey) AS suppliers, count(*) AS items FROM lineitem",
    "A5_mapreduce_sum": "SELECT l_returnflag, sum(l_quantity::DECIMAL(38,2))::DOUBLE AS quantity, sum(l_extendedprice::DECIMAL(38,2))::DOUBLE AS price, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "A6_prefix_sum": f"SELECT event_id, (sum(value::DECIMAL(38,2)) OVER ({EVENT_ORDER} ROWS UNBOUNDED PRECEDING))::DOUBLE AS running FROM events",
    "A6_row_sums": "SELECT r.i AS row, c.i AS col, (sum(10 * r.i + c.i) OVER (PARTITION BY r.i ORDER BY c.i))::BIGINT AS running FROM range(1, 4) r(i), range(1, 6) c(i)",
    "A7_reduce_until": f"""
        WITH s AS (SELECT *, sum(value::DECIMAL(38,2)) OVER ({EVENT_ORDER} ROWS UNBOUNDED PRECEDING) AS running FROM events),
        k AS (SELECT *, row_number() OVER ({EVENT_ORDER}) AS k FROM s WHERE running > 200)
        SELECT user_id, event_id, value::DECIMAL(38,2)::DOUBLE AS value FROM k WHERE k = 1""",
    "A8_max_change": f"SELECT user_id, round(max(d), 6) AS delta FROM (SELECT user_id, abs(value - lag(value) OVER ({EVENT_ORDER})) AS d FROM events) GROUP BY user_id",
    "A9_tree_stats": "SELECT count(*) AS parents, sum(n)::BIGINT AS leaves, max(n) AS widest FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)",
    "Q7_sort": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders",
    "Q20_dedup": """
        WITH l AS (SELECT doc_id AS block, string_split(text, chr(10)) AS ls FROM documents),
        c AS (SELECT block, unnest(range(len(ls))) AS item, unnest(ls) AS data FROM l),
        f AS (SELECT *, row_number() OVER (PARTITION BY data ORDER BY block, item) = 1 AS is_first FROM c)
        SELECT block, item, sha1(data) AS fingerprint, is_first, CASE WHEN is_first THEN length(data) END AS payload_chars FROM f""",
    "Q24_chain": f"SELECT event_id, t, t * (t + 1) // 2 - 1 AS item FROM (SELECT event_id, row_number() OVER ({EVENT_ORDER}) - 1 AS t FROM events)",
    "Q27_actor": f"SELECT event_id, round(value + row_number() OVER ({EVENT_ORDER}) - 1, 6) AS out FROM events",
}
