"""Data-dependent control: frontiers and loops whose rounds are Spark jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tagflow.storage import cut, remove


def frontier(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000, all_levels: bool = True) -> DataFrame:
    """Rows that ``step`` reaches from ``start``, level by level, until none is new.

    Each level is written to the shared folder, so a plan holds one level. With ``all_levels`` off only the last
    level that has rows comes back.
    """
    level = cut(start)
    levels = [level]
    for _ in range(most):
        level = cut(step(level))
        if level.isEmpty():
            break
        levels.append(level)
        if not all_levels:
            remove(start.sparkSession, levels.pop(0).cut_path)
    else:
        raise RuntimeError(f"still growing after {most} levels")
    out = levels.pop()
    while all_levels and levels:
        out = out.unionByName(levels.pop())
    return out


def loop(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, until: Callable[[DataFrame], bool] | None = None, every: int = 5) -> DataFrame:
    """``step`` applied ``rounds`` times, or until ``until`` holds; lineage is cut every few rounds and before each test."""
    for k in range(rounds):
        state = step(state, k)
        if until is not None or (k + 1) % every == 0:
            state = cut(state)
        if until is not None and until(state):
            break
    return state
