"""Cases of the reference at its own sizes, and an end by the cap that is told."""

import numpy as np
import pytest

from tagflow.algorithms import grids, recursion


def test_ten_queens(spark):
    assert recursion.queens(spark, 10).count() == 724


def test_jacobi_tells_that_it_has_not_converged(spark):
    plate = spark.createDataFrame([(i, j, float(i == 0)) for i in range(6) for j in range(6)], "i long, j long, v double")
    with pytest.raises(ValueError, match="after 2 rounds"):
        grids.jacobi(plate, 1e-6, most=2)


def test_over_relaxation_of_the_whole_plate():
    """100 x 100 cells, 50 rounds: the diagonals of a tile give what a loop in row order gives, bit for bit."""
    n, omega = 100, 0.3
    v = [[(11 * j % 100) * 0.01 for j in range(n)] for _ in range(n)]
    tile = np.array(v).ravel()
    for _ in range(50):
        for i in range(1, n - 1):
            for j in range(1, n - 1):
                v[i][j] = omega / 4 * (v[i + 1][j] + v[i][j + 1] + v[i - 1][j] + v[i][j - 1]) + (1 - omega) * v[i][j]
        tile = grids.relaxed(0, 0, tile, [None] * 4, n, n, omega, n)
    assert (tile.reshape(n, n) == np.array(v)).all()


def test_over_relaxation_in_tiles_of_the_plate(spark):
    """The same plate cut into tiles, four rounds."""
    n, omega = 100, 0.3
    plate = spark.range(n * n).selectExpr(f"id div {n} AS i", f"id % {n} AS j", f"(id % {n} * 11 % 100) * 0.01D AS v")
    tile = np.array([(p % n * 11 % 100) * 0.01 for p in range(n * n)])
    for _ in range(4):
        tile = grids.relaxed(0, 0, tile, [None] * 4, n, n, omega, n)
    got = {(r["i"], r["j"]): r["v"] for r in grids.sor(plate, n, n, omega, 4, 40).collect()}
    assert all(got[k // n, k % n] == tile[k] for k in range(n * n))
