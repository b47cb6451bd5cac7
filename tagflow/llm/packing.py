"""Packing token pieces into windows by non-negative least squares over shallow length combinations.

Documents are cut at the window; what is left over has lengths below it. All combinations of one to three lengths that
fill the window exactly are enumerated, and repeat counts are solved against the histogram of lengths by non-negative
least squares. Of a solution spread over more combinations than MOST_USED, so many are drawn by their weight and solved
for once more, so that the plan stays small. Counts are rounded so that their running sum is, and the residual lengths
are packed greedily, longest first. The histogram has one entry per length, so the plan is bounded; pieces find their
window by their place in the global order of lengths.

Cases: a null text is an empty document, which has its end id alone. Repeated rows are packed like others. A very long
document is cut into as many windows as it fills. An empty table gives an empty result. Only the named columns are read;
``pack`` carries any others along, but replaces columns named _length, _part, _row, sequence_id and offset.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import before_part, ordered, slices
from tagflow.llm.tokens import column_bpe

WINDOW = 2048
#: A piece of this length or more that is a power of two may have a window for itself, as that is not padded.
LONE = WINDOW // 2
#: Rounds of the solver, combinations of a plan, and rounds to solve for these.
ROUNDS, MOST_USED, ROUNDS_USED = 100, 8192, 400


def combinations(hist: np.ndarray, window: int = WINDOW, lone: int = LONE) -> np.ndarray:
    """Rows of three lengths (0: none), longest first, that fill the window, of lengths which occur."""
    have = np.flatnonzero(hist[:window])
    have = have[have > 0]
    out = [np.array([(window, 0, 0)] * bool(hist[window]) + [(a, 0, 0) for a in have.tolist() if a & (a - 1) == 0 and a >= lone], np.int64).reshape(-1, 3)]
    half = have[(2 * have <= window) & (hist[window - have] > 0)]
    out.append(np.stack([window - half, half, np.zeros_like(half)], axis=1))
    for c in have[3 * have <= window].tolist():
        b = have[(have >= c) & (2 * have <= window - c)]
        b = b[hist[window - c - b] > 0]
        out.append(np.stack([window - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(out)


def solve(combos: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with small ||A x - hist||, A[l, j] the times that combination j uses length l: accelerated projected
    gradients, each count stepping by the row sums of A'A, which bound it from above."""
    h = hist.astype(float)
    h[0] = 0
    flat, used, size = combos.ravel(), combos > 0, len(hist)

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (x[:, None] * used).ravel(), size)

    def back(r: np.ndarray) -> np.ndarray:
        r[0] = 0
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    bound = back(apply(np.ones(len(combos))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(apply(y) - h) / bound)
        if ((y - new) * (new - x) * bound).sum() > 0:
            t = 1.0  # the momentum points uphill
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def solved(hist: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Windows as (lengths, times), no more of a length than there are: the rounded solution."""
    combos = combinations(hist, window)
    if not len(combos):
        return []
    x = solve(combos, hist)
    if (some := np.count_nonzero(x)) > MOST_USED:
        drawn = np.sort(np.random.default_rng(0).choice(len(x), min(some, MOST_USED), replace=False, p=x / x.sum()))
        combos = combos[drawn]
        x = solve(combos, hist, ROUNDS_USED)
    order, left, out = np.lexsort(combos.T[::-1]), hist.astype(np.int64).copy(), []
    counts = np.diff(np.floor(np.cumsum(x[order]) + 0.5), prepend=0).astype(np.int64)
    for j, n in zip(order[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
        lengths, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
        if (n := int(min(n, (left[lengths] // times).min()))) > 0:
            left[lengths] -= n * times
            out.append((combos[j][combos[j] > 0].tolist(), n))
    return out


def templates(hist: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Windows as (lengths, times): the rounded solution, then the residual, longest first with the longest that fits."""
    out, left = solved(hist, window), hist.astype(np.int64).copy()
    for lengths, n in out:
        np.subtract.at(left, lengths, n)
    have = [int(a) for a in np.flatnonzero(left) if a > 0]
    while have:
        room, lengths, spent = window, [], {}
        at = len(have) - 1
        while at >= 0 and room:
            a = have[at]
            n = min(room // a, int(left[a]))
            if n:
                lengths += [a] * n
                spent[a] = n
                room -= n * a
            at = min(at - 1, bisect.bisect_right(have, room) - 1)
        n = min(int(left[a]) // k for a, k in spent.items())
        for a, k in spent.items():
            left[a] -= n * k
        have = [a for a in have if left[a] > 0]
        out.append((lengths, n))
    return out


def runs(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, stretches of its pieces: length, first place among them, pieces a window, first window, offset of the first."""
    used, window, rows = {}, 0, []
    for lengths, times in plan:
        offset = 0
        for a in sorted(set(lengths), reverse=True):
            k = lengths.count(a)
            rows.append((a, used.get(a, 0), k, window, offset))
            used[a] = used.get(a, 0) + k * times
            offset += k * a
        window += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "window", "offset"), cols, strict=True))


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents' ids with an end id behind, cut at the window: ``key``, start, length, ids (little-endian unsigned 32-bit), doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = column_bpe(path)
        for b in slices(batches, "text"):
            ids, offs = bpe.encode(b.column("text"))
            ids = np.insert(ids, offs[1:], end_id).astype("<u4")
            offs = offs + np.arange(len(offs))
            sizes = np.diff(offs)
            count = -(-sizes // window)
            doc = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, sizes[doc] - start)
            begin = offs[:-1][doc] + start
            ends = np.concatenate([begin, offs[-1:]]).astype(np.int32) * 4
            raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(doc)), pa.array(start), pa.array(length), raw, pa.array(sizes[doc])], names=["key", "start", "length", "ids", "doc_tokens"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(named.dtypes)["key"]
    return named.mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long").withColumnRenamed("key", key)


def pack(pieces: DataFrame, window: int = WINDOW, length: str = "length", ties: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``ties``: columns that order pieces of one length, for a repeatable result."""
    out, before = ordered(pieces.withColumn("_length", F.col(length).cast("long")), "_length", *ties)
    hist = np.zeros(window + 1, np.int64)
    for a, n in out.groupBy("_length").count().collect():  # one row for each length
        if not 0 < a <= window:
            raise ValueError(f"a piece of {a} ids doesn't fit a window of {window}")
        hist[a] = n
    at, first_of = runs(templates(hist, window)), np.cumsum(hist) - hist
    code = at["length"] * (1 << 48) + at["first"]
    names = [c for c in out.columns if c.lower() not in ("_part", "_row", "_length", "sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("_length").to_numpy()
            place = before_part(before, b.column("_part").to_numpy()) + b.column("_row").to_numpy() - first_of[size]
            i = np.searchsorted(code, size * (1 << 48) + place, side="right") - 1
            turn, nth = np.divmod(place - at["first"][i], at["each"][i])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(at["window"][i] + turn), pa.array(at["offset"][i] + nth * size)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in out.dtypes if n in names)
    return out.mapInArrow(run, f"{schema}, sequence_id long, offset long")
