"""Physical plans: what reaches the scan, and what stays out of Python."""

import re

import pytest

from tagflow import plans

QUERIES = plans.queries()
#: Queries whose steps are Python by nature: numeric kernels, a user's own aggregate, a Python data source.
PYTHON = {"Q3_mandelbrot", "U2_own_reduce", "U8_data_source", "C25_timer", "K6_stream_actor", "K7_stream_latest"} | {q for q in QUERIES if q.split("_")[0] in ("Q10", "Q11", "Q16") or q == "Q12_matmul_tiles"}
#: Those that are cross products by definition, of dimension tables or ranges.
CROSS = {"J1_cross", "J1_duplicates", "S16_graph_lists", "J2_chained_cross", "K2_stream_cross", "Q5_divide"}


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns", "pushed"),
    [
        ("P2_filter", {"p_partkey", "p_size"}, None),
        ("A1_reduce_selected", {"l_orderkey", "l_linenumber", "l_quantity"}, "LessThanOrEqual(l_linenumber,4)"),
        ("A4_count_all_words", {"text"}, None),
        ("C3_memoize", {"user_id", "event_type"}, None),
        ("S9_env_get", None, None),
        ("M1_first_wins", {"user_id", "ts", "event_id", "event_type"}, None),
        ("P3_cascade", {"doc_id", "text"}, "StringContains(text,th)"),
        ("A5_mapreduce_sum", {"l_returnflag", "l_quantity", "l_extendedprice"}, None),
    ],
)
def test_scans_read_what_the_query_needs(spark, sf_dir, name, columns, pushed):
    text = plan(spark, sf_dir, name)
    if columns:
        assert {c.split(":")[0] for c in re.search(r"ReadSchema: struct<(.*?)>", text)[1].split(",")} == columns
    if pushed:
        assert pushed in text


@pytest.mark.parametrize("name", ["A1_reduce_selected", "A4_count_all_words", "A5_mapreduce_sum", "C3_memoize", "M1_first_wins"])
def test_aggregates_combine_before_they_shuffle(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert len(re.findall("Aggregate", text)) >= 2 * len(re.findall(r"Exchange hashpartitioning.*\n.*Aggregate", text)) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - {q for q in QUERIES if q[0] in "QK" and q != "Q7_sort"}))
def test_no_python_and_no_accidental_product(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert not re.search("Python|Pandas|Arrow", text)
    if name not in CROSS:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
