"""Queries over the documents' words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.functions import ascii_lower, count_overlapping
from tagflow.sources import lines, table

#: The words whose occurrences are counted, and how often a word must occur to be reported.
WANTED, OFTEN = ("the", "anan", "eau", "sch", "qzx"), 999


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and n: words are exploded and combined before they are shuffled (A4). Empty pieces are left out behind the
    explosion, where the test is compiled; an outer one, as Spark would split the texts twice to infer that pieces exist."""
    return docs.select(F.explode_outer(F.split(ascii_lower(F.col(text)), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def a4_count_all_words(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(table(spark, sf, "documents"))


def a4_frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(table(spark, sf, "documents")).where(F.col("n") > OFTEN)


def a3_count_words(spark: SparkSession, sf: str) -> DataFrame:
    """All wanted words in one pass over the texts; words that never occur stay, with 0."""
    sums = table(spark, sf, "documents").agg(*(F.coalesce(F.sum(count_overlapping(F.col("text"), w)), F.lit(0)).alias(w) for w in WANTED))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.col(w).alias("n")) for w in WANTED))).alias("r")).select("r.*")


def s5_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.col("line").cast("long").alias("line"), F.length("text").cast("long").alias("chars"))


QUERIES = {"A4_count_all_words": a4_count_all_words, "A4_frequent_words": a4_frequent_words, "A3_count_words": a3_count_words, "S5_lines": s5_lines}

COUNTS = """
    WITH w AS (SELECT unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+')) AS word FROM documents)
    SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word"""
SQL = {
    "A4_count_all_words": COUNTS,
    "A4_frequent_words": COUNTS + f" HAVING count(*) > {OFTEN}",
    "A3_count_words": f"""
        SELECT word, sum(len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(word)) = word)))::BIGINT AS n
        FROM documents, (VALUES {", ".join(f"('{w}')" for w in WANTED)}) v(word) GROUP BY word""",
    "S5_lines": "SELECT doc_id, unnest(range(len(ls))) AS line, length(unnest(ls)) AS chars FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
}
