"""Reusable graphs: parts that read some tables and give others, and graphs that work behind a stream."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagflow.storage import fresh


class SubGraph:
    """A part of a graph (C19, U4, U6): subclasses declare what they read and give, and build the tables in between.

    inputs: for each table that it reads, the columns it must have. outputs: names of what it gives. A generic graph takes
    steps or types as arguments of its constructor. Building is lazy; nothing runs before an action.
    """

    inputs: Mapping[str, tuple[str, ...]] = {}
    outputs: tuple[str, ...] = ()

    def build(self, **tables: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError

    def __call__(self, **tables: DataFrame) -> dict[str, DataFrame]:
        for name, columns in self.inputs.items():
            if name not in tables:
                raise ValueError(f"{type(self).__name__} reads {name}")
            if missing := set(columns) - set(tables[name].columns):
                raise ValueError(f"{name} has no {sorted(missing)}")
        out = self.build(**tables)
        if set(out) != set(self.outputs):
            raise ValueError(f"{type(self).__name__} gives {sorted(self.outputs)}, not {sorted(out)}")
        return out


class HiddenGraph:
    """A graph behind a stream (U5): whatever arrives is handed to ``work``, a function of DataFrames, and what this
    makes is put to the graph's own table. What it does in between is nobody's business; it is quiet when all has been
    worked on."""

    def __init__(self, work: Callable[[DataFrame], DataFrame], schema: str):
        self.work, self.schema, self.query = work, schema, None

    def start(self, arriving: DataFrame) -> HiddenGraph:
        spark = arriving.sparkSession
        self.spark, self.path = spark, fresh(spark, "hidden")

        def on_data(batch: DataFrame, number: int) -> None:
            self.work(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        self.query: StreamingQuery | None = arriving.writeStream.foreachBatch(on_data).option("checkpointLocation", fresh(spark, "hidden-state")).trigger(availableNow=True).start()
        return self

    def wait(self) -> DataFrame:
        """What it has put, once it is quiet."""
        self.query.awaitTermination()
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(self.path).drop("batch")
