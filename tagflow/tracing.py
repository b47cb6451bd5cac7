"""What a graph did: events of collections (C23) and times of steps (C25), as tables."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Trace:
    """Collects events lazily: rows of event, collection and tag (as JSON). Level 0 collects nothing."""

    def __init__(self, level: int = 1):
        self.level, self.parts = level, []

    def put(self, collection: str, rows: DataFrame, keys: list[str], event: str = "put") -> DataFrame:
        """``rows``, noted down."""
        if self.level:
            self.parts.append(rows.select(F.lit(event).alias("event"), F.lit(collection).alias("collection"), F.to_json(F.struct(*keys)).alias("tag")))
        return rows

    def rows(self) -> DataFrame | None:
        out = None
        for part in self.parts:
            out = part if out is None else out.unionByName(part)
        return out


def timed(rows: DataFrame, step: str) -> DataFrame:
    """step, part, began (seconds since 1970), seconds and rows for each batch of ``rows`` that a task goes through: how long
    what is before it took. The log is as small as the number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = time.time()
        for b in batches:
            now = time.time()
            yield pa.RecordBatch.from_arrays([pa.array([step]), pa.array([began]), pa.array([now - began]), pa.array([b.num_rows])], names=["step", "began", "seconds", "rows"])
            began = now

    return rows.mapInArrow(run, "step string, began double, seconds double, rows long").withColumn("part", F.spark_partition_id())
