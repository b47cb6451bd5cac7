"""Tags and items as DataFrames.

A tag collection is a DataFrame of keys with bag semantics (rule M5); with ``preserve`` it is a set (M6). An item
collection is a DataFrame with a unique key (M1); without the key it is a plain bag that feeds reductions (M2). Both are
lazy: a put is a union, a get is a join, and waiting for quiescence is an action.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.storage import cut, remove


Callback = Callable[[DataFrame], None]


@dataclass(frozen=True)
class TagSet:
    """Tags: rows of key columns. ``preserve`` memoizes: a tag put twice prescribes once.

    cancelled: tags that no step runs for, whenever they are put; stopped: no step runs at all (C11). callbacks: see ``on_put``.
    """

    rows: DataFrame
    preserve: bool = False
    cancelled: DataFrame | None = None
    stopped: bool = False
    callbacks: Sequence[Callback] = ()

    def put(self, more: DataFrame) -> TagSet:
        return replace(self, rows=self.rows.unionByName(more))

    def put_range(self, spark: SparkSession, first: int, last: int, step: int = 1, name: str = "tag", parts: int | None = None) -> TagSet:
        """Half-open and never memoized within the range."""
        return self.put(spark.range(first, last, step, parts).withColumnRenamed("id", name))

    def tags(self) -> DataFrame:
        return self.rows.dropDuplicates() if self.preserve else self.rows

    def scan(self) -> DataFrame:
        """The tags that an iteration meets: all of a memoizing collection; another keeps none."""
        return self.tags() if self.preserve else self.rows.limit(0)

    def cancel(self, tags: DataFrame) -> TagSet:
        """These tags' steps don't run, though the tags stay (C11); it holds until ``uncancel``."""
        more = tags.select(*self.rows.columns)
        return replace(self, cancelled=more if self.cancelled is None else self.cancelled.unionByName(more))

    def cancel_all(self) -> TagSet:
        return replace(self, stopped=True)

    def uncancel(self) -> TagSet:
        """Forgets what was cancelled."""
        return replace(self, cancelled=None, stopped=False)

    def runnable(self) -> DataFrame:
        tags = self.tags()
        if self.stopped:
            return tags.limit(0)
        if self.cancelled is None:
            return tags
        gone = self.cancelled.distinct().select(*(F.col(c).alias(f"_c_{c}") for c in tags.columns))
        same = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in tags.columns]
        return tags.join(gone, same, "left_anti")

    def prescribe(self, step, *args) -> DataFrame:
        """What ``step``, a function of DataFrames, makes of the tags (C1, P8: call it once for each step)."""
        return step(self.runnable(), *args)

    def on_put(self, callback: Callback) -> TagSet:
        """``callback`` gets the tags that were put, each once if the collection memoizes, when they are settled (I8)."""
        return replace(self, callbacks=(*self.callbacks, callback))

    def settled(self) -> TagSet:
        """All puts carried out, and told to the callbacks."""
        done = cut(self.tags())
        for callback in self.callbacks:
            callback(done)
        return replace(self, rows=done)


def fused(step: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A step that is its own tag collection (C22): called with tags it runs for each, as often as they are put."""
    return lambda tags: TagSet(tags).prescribe(step)


@dataclass(frozen=True)
class ItemTable:
    """Items: ``keys`` and value columns, one row a key.

    mode: what a second put of a key does. ``error`` fails the job, ``first`` keeps the one that ``order`` puts first
    (M1 as the runtime has it), ``distinct`` lets equal rows pass and fails on different ones, ``bag`` checks nothing (M2).
    """

    rows: DataFrame
    keys: Sequence[str]
    mode: str = "error"
    order: Sequence[str] = field(default_factory=tuple)
    callbacks: Sequence[Callback] = ()

    def put(self, more: DataFrame) -> ItemTable:
        return replace(self, rows=self.rows.unionByName(more))

    def items(self) -> DataFrame:
        """One aggregation with map-side combine; no window, so a key with many puts is no single task's load."""
        if self.mode == "bag":
            return self.rows
        values = [c for c in self.rows.columns if c not in self.keys]
        if self.mode == "first":
            first = (F.col(c).alias(f"_{k}") for k, c in enumerate(self.order))
            best = F.min(F.struct(*first, *values)).alias("_best")
            return self.rows.groupBy(*self.keys).agg(best).select(*self.keys, *(F.col(f"_best.{v}").alias(v) for v in values))
        rows = self.rows.dropDuplicates() if self.mode == "distinct" else self.rows
        once = rows.groupBy(*self.keys).agg(F.count("*").alias("_puts"), F.min(F.struct(*(values or self.keys))).alias("_one"))
        checked = F.when(F.col("_puts") == 1, F.col("_one")).otherwise(F.raise_error(F.lit("an item was put twice")))
        return once.select(*self.keys, checked.alias("_one")).select(*self.keys, *(F.col(f"_one.{v}").alias(v) for v in values))

    def get(self, *key):
        """One item by its key, as the environment asks for it; a missing one is a KeyError."""
        cond = F.lit(True)
        for name, value in zip(self.keys, key, strict=True):
            cond = cond & F.col(name).eqNullSafe(F.lit(value))
        row = self.items().where(cond).first()
        if row is None:
            raise KeyError(key)
        return row

    def size(self) -> int:
        return self.items().count()

    def empty(self) -> bool:
        return self.rows.isEmpty()

    def reset(self) -> ItemTable:
        """No items, the same schema."""
        return replace(self, rows=self.rows.sparkSession.createDataFrame([], self.rows.schema))

    def scan(self) -> DataFrame:
        """All items with their keys, in no order."""
        return self.items()

    def on_put(self, callback: Callback) -> ItemTable:
        """``callback`` gets the items that were put, one row a key, when they are settled."""
        return replace(self, callbacks=(*self.callbacks, callback))

    def settled(self) -> ItemTable:
        """All puts carried out (C13), and told to the callbacks."""
        done = cut(self.items())
        for callback in self.callbacks:
            callback(done)
        return replace(self, rows=done, mode="bag")

    def free(self) -> ItemTable:
        """A settled collection without its stored items (C4): for items whose declared gets have all been made."""
        if "cut_path" in vars(self.rows):
            remove(self.rows.sparkSession, self.rows.cut_path)
        return self.reset()


@dataclass
class Graph:
    """A static graph's declarations (C2): what consumes, produces and prescribes what, for ``describe``."""

    name: str
    edges: list[tuple[str, str, str]] = field(default_factory=list)

    def prescribes(self, tags: str, step: str) -> Graph:
        self.edges.append((tags, "prescribes", step))
        return self

    def consumes(self, step: str, items: str) -> Graph:
        self.edges.append((items, "is consumed by", step))
        return self

    def produces(self, step: str, items: str) -> Graph:
        self.edges.append((step, "produces", items))
        return self

    def controls(self, step: str, tags: str) -> Graph:
        self.edges.append((step, "controls", tags))
        return self

    def describe(self) -> str:
        return "\n".join([self.name, *(f"  {a} {verb} {b}" for a, verb, b in self.edges)])


def canonical(key: Column) -> Column:
    """A key column under a user's own equality (U7): compare its hash-safe text."""
    return F.sha2(F.to_json(F.struct(key.alias("k"))), 256)
