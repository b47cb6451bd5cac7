"""Tiled linear algebra: a matrix is rows (i, j, tile), a tile its doubles in row order as binary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.storage import cut


def tile_of(raw: bytes, b: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(b, b)


def to_tiles(cells: DataFrame, b: int, missing: float = 0.0) -> DataFrame:
    """Cells (i, j, v) of a matrix whose sides ``b`` divides, as tiles; missing cells are 0 or as told."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.full((b, b), missing)
        t[pdf["i"] % b, pdf["j"] % b] = pdf["v"]
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "tile": [t.astype("<f8").tobytes()]})

    return cells.groupBy(F.expr(f"i div {b}"), F.expr(f"j div {b}")).applyInPandas(build, "i long, j long, tile binary")


def to_cells(tiles: DataFrame, b: int) -> DataFrame:
    @F.pandas_udf("array<double>")
    def values(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: np.frombuffer(raw, "<f8"))

    at = tiles.select("i", "j", F.posexplode(values("tile")).alias("p", "v"))
    return at.select((F.col("i") * b + F.expr(f"p div {b}")).alias("i"), (F.col("j") * b + F.col("p") % b).alias("j"), "v")


def multiply(a: DataFrame, c: DataFrame) -> DataFrame:
    """The product of matrices of cells (i, j, v): join on the inner index, then sum."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), c.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gemm(a: DataFrame, c: DataFrame, onto: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha * a * c + beta * onto (Q13): a step of a chain of products; one shuffle adds both."""
    both = multiply(a, c).select("i", "j", (F.col("v") * alpha).alias("v")).unionByName(onto.select("i", "j", (F.col("v") * beta).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def multiply_tiles(a: DataFrame, c: DataFrame, b: int) -> DataFrame:
    """The same on tiles: products of the pairs that meet are summed by their place where they are made, then once more;
    a place's second sum has a tile for each task of the join, however long the inner side is."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple, np.ndarray] = {}
            for i, j, x, y in zip(pdf["i"], pdf["j"], pdf["x"], pdf["y"], strict=True):
                product = tile_of(x, b) @ tile_of(y, b)
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
            yield pd.DataFrame([(i, j, t.tobytes()) for (i, j), t in sums.items()], columns=["i", "j", "tile"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((b, b))
        for t in pdf["tile"]:
            total += tile_of(t, b)
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "tile": [total.tobytes()]})

    left, right = a.select("i", F.col("j").alias("k"), F.col("tile").alias("x")), c.select(F.col("i").alias("k"), "j", F.col("tile").alias("y"))
    made = left.join(right, "k").select("i", "j", "x", "y").mapInPandas(products, "i long, j long, tile binary")
    return made.groupBy("i", "j").applyInPandas(add, "i long, j long, tile binary")


def shortest_paths(a: DataFrame, n: int, b: int) -> DataFrame:
    """Least sums over paths on tiles of distances (Q9): for each k the pivot tile's own paths, then its row and column,
    then all others through them. Tiles hold inf where there is no road; distances must not be negative."""

    def through(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full((b, b), np.inf)
        for k in range(b):
            np.minimum(out, x[:, k, None] + y[None, k, :], out=out)
        return out

    @F.pandas_udf("binary")
    def closed(s: pd.Series) -> pd.Series:
        out = []
        for raw in s:
            t = tile_of(raw, b).copy()
            for k in range(b):
                np.minimum(t, t[:, k, None] + t[None, k, :], out=t)
            out.append(t.tobytes())
        return pd.Series(out)

    @F.pandas_udf("binary")
    def shorter(i: pd.Series, j: pd.Series, k: pd.Series, s: pd.Series, p: pd.Series, l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        out = []
        for i_, j_, k_, x, mid, col, row in zip(i, j, k, s, p, l, r, strict=True):
            x, mid, col, row = (tile_of(t, b) for t in (x, mid, col, row))
            t = mid
            if i_ != k_ or j_ != k_:
                first = mid if i_ == k_ else np.minimum(col, through(col, mid))
                last = mid if j_ == k_ else np.minimum(row, through(mid, row))
                t = np.minimum(x, through(first, last))
            out.append(t.tobytes())
        return pd.Series(out)

    state = cut(a)
    for k in range(n // b):
        pivot = state.where(f"i = {k} AND j = {k}").select(closed("tile").alias("p"), F.lit(k).cast("long").alias("k"))
        l, r = state.where(f"j = {k}").select("i", F.col("tile").alias("l")), state.where(f"i = {k}").select("j", F.col("tile").alias("r"))  # noqa: E741
        state = cut(state.join(l, "i").join(r, "j").crossJoin(F.broadcast(pivot)).select("i", "j", shorter("i", "j", "k", "tile", "p", "l", "r").alias("tile")), replacing=state)
    return state


def cholesky(a: DataFrame, n: int, b: int) -> DataFrame:
    """The lower factor's tiles (Q10): for each k the diagonal tile, its column, then all tiles to the right.

    Each round is two joins on tiles of column k; what is done stays out of later rounds.
    """

    @F.pandas_udf("binary")
    def factor(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.linalg.cholesky(tile_of(x, b)).tobytes())

    @F.pandas_udf("binary")
    def solve(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.solve(tile_of(y, b), tile_of(x, b).T).T.tobytes() for x, y in zip(s, d, strict=True)])

    @F.pandas_udf("binary")
    def update(s: pd.Series, l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([(tile_of(x, b) - tile_of(y, b) @ tile_of(z, b).T).tobytes() for x, y, z in zip(s, l, r, strict=True)])

    rest, done = cut(a.where("i >= j")), []
    for k in range(n // b):
        diagonal = rest.where(f"i = {k} AND j = {k}").select(F.lit(k).cast("long").alias("j"), factor("tile").alias("d"))
        below = rest.where(f"j = {k} AND i > {k}").join(diagonal, "j").select("i", "j", solve("tile", "d").alias("tile"))
        column = cut(below.unionByName(diagonal.select(F.col("j").alias("i"), "j", F.col("d").alias("tile"))))
        done.append(column)
        l, r = column.select("i", F.col("tile").alias("l")), column.select(F.col("i").alias("j"), F.col("tile").alias("r"))  # noqa: E741
        rest = cut(rest.where(f"j > {k}").join(l, "i").join(r, "j").select("i", "j", update("tile", "l", "r").alias("tile")), replacing=rest)
    out = done[0]
    for column in done[1:]:
        out = out.unionByName(column)
    return out


def inverse(a: DataFrame, n: int, b: int) -> DataFrame:
    """The inverse's tiles by block Gauss-Jordan (Q11): pivot tile k, then its row, its column and all others."""

    @F.pandas_udf("binary")
    def invert(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.linalg.inv(tile_of(x, b)).tobytes())

    @F.pandas_udf("binary")
    def changed(i: pd.Series, j: pd.Series, k: pd.Series, s: pd.Series, p: pd.Series, l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        out = []
        for i_, j_, k_, x, inv, col, row in zip(i, j, k, s, p, l, r, strict=True):
            pivot = tile_of(inv, b)
            if i_ == k_ and j_ == k_:
                t = pivot
            elif i_ == k_:
                t = pivot @ tile_of(x, b)
            elif j_ == k_:
                t = -tile_of(x, b) @ pivot
            else:
                t = tile_of(x, b) - tile_of(col, b) @ pivot @ tile_of(row, b)
            out.append(t.tobytes())
        return pd.Series(out)

    state = cut(a)
    for k in range(n // b):
        pivot = state.where(f"i = {k} AND j = {k}").select(invert("tile").alias("p"), F.lit(k).cast("long").alias("k"))
        l, r = state.where(f"j = {k}").select("i", F.col("tile").alias("l")), state.where(f"i = {k}").select("j", F.col("tile").alias("r"))  # noqa: E741
        state = cut(state.join(l, "i").join(r, "j").crossJoin(F.broadcast(pivot)).select("i", "j", changed("i", "j", "k", "tile", "p", "l", "r").alias("tile")), replacing=state)
    return state
