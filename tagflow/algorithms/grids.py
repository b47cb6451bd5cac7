"""Stencils and fractals on grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagflow.operators.iterate import loop
from tagflow.storage import cut


def mandelbrot(spark: SparkSession, rows: int, cols: int, depth: int) -> DataFrame:
    """i, j, count over the square from -2 to 2 (Q3); a batch of points is iterated together in numpy."""

    @F.pandas_udf("int")
    def count(re: pd.Series, im: pd.Series) -> pd.Series:
        c = re.to_numpy() + 1j * im.to_numpy()
        out, at, z = np.zeros(len(c), np.int32), np.arange(len(c)), np.zeros(len(c), complex)
        for _ in range(depth):
            inside = np.hypot(z.real, z.imag) < 2.0
            at, z = at[inside], z[inside]
            if not len(at):
                break
            z = z * z + c[at]
            out[at] += 1
        return pd.Series(out)

    cells = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"))
    return cells.repartition("i").select("i", "j", count(F.col("j") * (4.0 / rows) - 2.0, F.col("i") * (4.0 / cols) - 2.0).alias("count"))


def mandelbrot_rows(spark: SparkSession, rows: int, cols: int, depth: int) -> DataFrame:
    """i and counts, an array a row (Q3 by row vectors): a tag is a whole row."""
    cells = mandelbrot(spark, rows, cols, depth)
    return cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "count"))), lambda c: c["count"]).alias("counts"))


def checksum(pixels: DataFrame, cols: int, depth: int) -> DataFrame:
    """The sum of the places of points that never left."""
    return pixels.agg(F.sum(F.when(F.col("count") == depth, F.col("i") * cols + F.col("j")).otherwise(0)).alias("checksum"))


def heat_step(grid: DataFrame, by: Sequence[str], x: str, u: str, alpha: float) -> DataFrame:
    """One explicit step of the heat equation along ``x`` (Q15, I2, I3): ends stay as they are."""
    w = Window.partitionBy(*by).orderBy(x)
    left, right = F.lag(u).over(w), F.lead(u).over(w)
    new = F.when(left.isNull() | right.isNull(), F.col(u)).otherwise(F.col(u) + alpha * (left - 2 * F.col(u) + right))
    return grid.withColumn(u, new)


def heat(grid: DataFrame, x: str, u: str, alpha: float, steps: int) -> DataFrame:
    """``steps`` explicit steps of the heat equation over cells (x, u) of one rod (Q15): a loop over time, each step one
    shuffle of cells to those that read them; ends stay as they are."""

    def step(state: DataFrame, _: int) -> DataFrame:
        near = neighbours(state, ((-1,), (1,)), (x,), u)
        return near.select(x, F.when(F.col("n0").isNull() | F.col("n1").isNull(), F.col(u)).otherwise(F.col(u) + alpha * (F.col("n0") - 2 * F.col(u) + F.col("n1"))).alias(u))

    return loop(grid.select(x, u), step, steps, every=3)


def neighbours(grid: DataFrame, offsets: Sequence[tuple[int, ...]], keys: Sequence[str], value: str) -> DataFrame:
    """Each cell, one row a key, with its neighbours' values as n0, n1, ...; null beyond the edge.

    One shuffle: every cell is sent to the cells that read it, and these gather what arrived in sorted order, which
    spills. What a task sends has nothing to combine, so an aggregate's table would hold all of it. As in a get, a null
    key is nobody's neighbour.
    """
    sent = F.array(*(F.struct(*((F.col(k) - d).alias(k) for k, d in zip(keys, o, strict=True)), F.lit(n).alias("_n")) for n, o in enumerate(offsets)),
                   F.struct(*(F.col(k) for k in keys), F.lit(-1).alias("_n")))
    out = grid.select(F.explode(sent).alias("to"), F.col(value).alias("_v")).select(*(F.col(f"to.{k}").alias(k) for k in keys), "to._n", "_v")
    out = out.where((F.col("_n") == -1) | ~F.array_contains(F.array(*(F.isnull(k) for k in keys)), True))
    cell = Window.partitionBy(*keys).orderBy("_n")
    all_of_it = cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda n: F.max(F.when(F.col("_n") == n, F.col("_v"))).over(all_of_it)
    gathered = out.select(*keys, "_n", F.row_number().over(cell).alias("_row"), at(-1).alias(value), *(at(n).alias(f"n{n}") for n in range(len(offsets))))
    return gathered.where((F.col("_n") == -1) & (F.col("_row") == 1) & F.col(value).isNotNull()).drop("_n", "_row")


CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def jacobi(grid: DataFrame, epsilon: float, most: int = 100) -> DataFrame:
    """Relaxed (i, j, v) and the rounds it took: stops when no cell moves by ``epsilon`` (Q17, A8). Edges are fixed.

    A grid that still moves after ``most`` rounds is an error."""
    state = before = cut(grid.select("i", "j", F.col("v").cast("double").alias("v")))
    for k in range(most):
        near = neighbours(state, CROSS, ("i", "j"), "v")
        mean = (F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")) / 4
        moved = cut(near.select("i", "j", F.coalesce(mean, F.col("v")).alias("v"), F.abs(F.coalesce(mean, F.col("v")) - F.col("v")).alias("delta")), replacing=before)
        before = moved
        state = moved.select("i", "j", "v")
        if (moved.agg(F.max("delta")).first()[0] or 0.0) < epsilon:
            break
    else:
        raise ValueError(f"cells still move by {epsilon} or more after {most} rounds")
    return state.withColumn("rounds", F.lit(k + 1))


def sor(grid: DataFrame, n: int, m: int, omega: float, rounds: int, b: int = 64) -> DataFrame:
    """Successive over-relaxation of a dense n x m grid (i, j, v) in row order (Q16): north and west are new, south and
    east old; edges are fixed.

    The grid is cut into tiles of b x b. In wave I + J + 2k tile (I, J) makes its round k: its northern and western
    neighbours have just made theirs, the others not yet. All tiles of a wave run in parallel, and so do several rounds.
    A wave shuffles tiles and their rims once.
    """
    h, w = F.least(F.lit(b), n - F.col("ti") * b), F.least(F.lit(b), m - F.col("tj") * b)
    cells = grid.select(F.expr(f"i div {b}").alias("ti"), F.expr(f"j div {b}").alias("tj"), F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).alias("c"))
    state = cut(cells.groupBy("ti", "tj").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]).alias("tile")))

    @F.pandas_udf("array<double>")
    def relax(k: pd.Series, i: pd.Series, j: pd.Series, tile: pd.Series, *rims: pd.Series) -> pd.Series:
        return pd.Series([relaxed(i_ * b, j_ * b, x, sides, n, m, omega, b) if 1 <= k_ <= rounds else x for k_, i_, j_, x, *sides in zip(k, i, j, tile, *rims, strict=True)])

    def column(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (h - 1).cast("int")), lambda r: F.get("tile", (r * w + at).cast("int")))

    rims = {"north": (1, 0, F.slice("tile", ((h - 1) * w + 1).cast("int"), w.cast("int"))), "south": (-1, 0, F.slice("tile", F.lit(1), w.cast("int"))), "west": (0, 1, column(w - 1)), "east": (0, -1, column(F.lit(0))), "tile": (0, 0, F.col("tile"))}
    last = -(-n // b) + -(-m // b) - 2 + 2 * rounds
    for wave in range(2, last + 1):
        sent = F.array(*(F.struct((F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), F.lit(name).alias("name"), values.alias("values")) for name, (di, dj, values) in rims.items()))
        got = state.select(F.explode(sent).alias("r")).groupBy("r.ti", "r.tj").agg(*(F.max(F.when(F.col("r.name") == name, F.col("r.values"))).alias(name) for name in rims))
        twice = wave - F.col("ti") - F.col("tj")
        turn = F.when(twice % 2 == 0, twice / 2).otherwise(0).cast("long")
        state = cut(got.where(F.col("tile").isNotNull()).select("ti", "tj", relax(turn, "ti", "tj", "tile", "north", "south", "west", "east").alias("tile")), replacing=state)
    at = state.select("ti", "tj", w.alias("w"), F.posexplode("tile").alias("p", "v"))
    return at.select((F.col("ti") * b + F.expr("p div w")).alias("i"), (F.col("tj") * b + F.expr("p % w")).alias("j"), "v")


def relaxed(i0: int, j0: int, tile: np.ndarray, rims: list, n: int, m: int, omega: float, b: int) -> np.ndarray:
    """One round of a tile whose first cell is (i0, j0): its diagonals one after another, the cells of each together."""
    h, w = min(b, n - i0), min(b, m - j0)
    v = np.zeros((h + 2, w + 2))
    v[1:-1, 1:-1] = np.asarray(tile).reshape(h, w)
    for rim, place in zip(rims, ((0, slice(1, -1)), (-1, slice(1, -1)), (slice(1, -1), 0), (slice(1, -1), -1)), strict=True):
        if rim is not None:
            v[place] = rim
    top, bottom = 1 + (i0 == 0), h - (i0 + h == n)
    left, right = 1 + (j0 == 0), w - (j0 + w == m)
    for s in range(top + left, bottom + right + 1):
        i = np.arange(max(top, s - right), min(bottom, s - left) + 1)
        j = s - i
        v[i, j] = omega / 4 * (v[i + 1, j] + v[i, j + 1] + v[i - 1, j] + v[i, j - 1]) + (1 - omega) * v[i, j]
    return v[1:-1, 1:-1].ravel()


def stencil_3d(grid: DataFrame, coefficients: Sequence[float], steps: int) -> DataFrame:
    """Wave steps of a star stencil in three dimensions (Q18): (x, y, z, u, before), a coefficient for each distance.

    Cells whose star leaves the grid are fixed.
    """
    reach = len(coefficients) - 1
    star = [tuple(d * s if a == axis else 0 for a in range(3)) for d in range(1, reach + 1) for axis in range(3) for s in (-1, 1)]

    def step(state: DataFrame, _: int) -> DataFrame:
        near = neighbours(state.select("x", "y", "z", F.struct("u", "before").alias("s")), star, ("x", "y", "z"), "s")
        total = F.col("s.u") * coefficients[0]
        for n, o in enumerate(star):
            total = total + F.col(f"n{n}.u") * coefficients[sum(map(abs, o))]
        new = 2 * F.col("s.u") - F.col("s.before") + total
        return near.select("x", "y", "z", F.coalesce(new, F.col("s.u")).alias("u"), F.col("s.u").alias("before"))

    return loop(grid, step, steps, every=1)


def boundary(value: Column, default: Column | float) -> Column:
    """A neighbour's value, or the default beyond the edge."""
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def traced(spark: SparkSession, width: int, height: int, spheres: Sequence[tuple[float, ...]], light: tuple[float, float, float]) -> DataFrame:
    """x, y, sphere, shade: the nearest sphere (cx, cy, cz, radius) that the ray through each pixel meets, and how the
    light falls on it (Q21). Rays run along z; the scene is a literal, so all pixels are one map."""
    px, py = (F.col("x") + 0.5) / width * 2 - 1, (F.col("y") + 0.5) / height * 2 - 1
    hits = []
    for k, (cx, cy, cz, radius) in enumerate(spheres):
        inside = radius * radius - (px - cx) * (px - cx) - (py - cy) * (py - cy)
        z = cz - F.sqrt(F.greatest(inside, F.lit(0.0)))
        shade = ((px - cx) * light[0] + (py - cy) * light[1] + (z - cz) * light[2]) / radius
        hits.append(F.when(inside > 0, F.struct(z.alias("z"), F.lit(k).alias("sphere"), shade.alias("shade"))))
    nearest = F.array_min(F.array_compact(F.array(*hits)))
    pixels = spark.range(width * height).select((F.col("id") % width).alias("x"), F.expr(f"id div {width}").alias("y"))
    return pixels.select("x", "y", nearest.alias("hit")).select("x", "y", "hit.sphere", F.greatest(F.col("hit.shade"), F.lit(0.0)).alias("shade"))
