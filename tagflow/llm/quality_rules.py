"""Host-level quality rules.

Rules judge each document; failures are counted per host, each host's rate is shrunk towards an empirical beta prior,
and hosts whose shrunk rate is too high lose all their documents. The prior is the beta-binomial law whose moments the
hosts' rates have: the spread that a rate of few documents has by chance does not count as spread between hosts.

Cases: a null or empty text has no words and fails. Documents without a host are judged alone. Repeated rows count
as often as they occur and stay as often. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagflow.llm.common import broadcast_if_small, unused, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host goes when its shrunk failure rate exceeds this. The prior weighs between 1 and MOST_WEIGHT documents.
MAX_HOST_RATE, MOST_WEIGHT = 0.5, 1000.0

SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\v\f\r "
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which occurs twice or more, first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def text_metrics(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the metrics of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_metrics(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=names)

    part = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in part.dtypes[:-1])
    names = [*keys, *(x.split()[0] for x in METRICS.split(", "))]
    return part.mapInArrow(run, f"{schema}, {METRICS}")


def host_verdicts(rated: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: documents, failures, shrunk rate and ``host_failed``. The prior's moments are one row over all hosts."""
    hosts = rated.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures")
    )
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_docs")).alias("chance"))
    # A rate of n documents varies by m(1-m)(r + (1-r)/n), r = 1/(weight + 1); without spread the weight is MOST_WEIGHT documents.
    most = F.col("m") * (1 - F.col("m"))
    r = F.when((most > 1e-12) & (F.col("chance") < 1 - 1e-9), (F.col("v") / most - F.col("chance")) / (1 - F.col("chance"))).otherwise(0.0)
    weight = F.when(r > 1 / (MOST_WEIGHT + 1), F.greatest(F.lit(1.0), 1 / r - 1)).otherwise(MOST_WEIGHT)
    shrunk = (F.col("host_failures") + F.col("m") * weight) / (F.col("host_docs") + weight)
    return hosts.crossJoin(F.broadcast(prior)).select(host, "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``key``, the metrics, ``base_failed``, the host's figures and ``kept`` for each row of ``docs``.

    Only keys and metrics are written, once; hosts are pre-aggregated on the map side, and the verdicts, one row per
    host, join back by a broadcast where their measured size allows it, else by an equi-join that Spark splits where skewed.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    named = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.col(text).alias("_body"))
    rated = written(measured(named, ["_key", "_host"], "_body").withColumn("base_failed", base))
    out = rated.join(broadcast_if_small(host_verdicts(rated, "_host", "base_failed", max_rate)), "_host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    metrics = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("_key").alias(key), *metrics, F.round("host_rate", 9).alias("host_rate"), kept.alias("kept"))


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that rules and hosts keep, all columns as they are.

    The rules read each text once; the rows are written with their verdict, from which hosts read two columns, and texts
    need no shuffle where the failing hosts are a small table: these are then broadcast. More of them join by a shuffled
    equi-join.
    """
    failed, bad_host, names = unused("_failed", docs.columns), unused("_bad_host", docs.columns), docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = []
            for t in b.column(b.num_columns - 1).to_pylist():
                n, _, _, _, repeated = text_metrics(t or "")
                bad.append(n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bad, pa.bool_())], names=[*names, failed])

    judged = docs.select("*", F.col(text).alias(unused("_body", docs.columns))).mapInArrow(judge, T.StructType([*docs.schema, T.StructField(failed, T.BooleanType())]))
    judged = written(judged)
    verdicts = host_verdicts(judged.select(F.col(host).alias("_host"), F.col(failed).alias("base_failed")), "_host", "base_failed", max_rate)
    bad = broadcast_if_small(verdicts.where("host_failed").select(F.col("_host").alias(bad_host)))
    return judged.where(~F.col(failed)).join(bad, F.col(host) == F.col(bad_host), "left_anti").select(*names)
