"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Every vector is rotated by one fixed random rotation and kept as the packed signs of its coordinates, its length and one
correction scalar; these codes are built once. A query is rotated too and rounded to PLANES bits a coordinate, so its
inner product with a code is a few counts of common bits, taken on the packed words. That estimates the inner product of
query and vector; with high probability the error stays within a bound known per vector. In a block, the vectors of the
best upper bounds are scored on the original vectors; the k-th best of these scores is a floor, and every other vector
whose upper bound reaches it is scored too, in double precision.

The stated queries meet all rows in blocks: rows are dealt to blocks of bounded size, queries to blocks of bounded size,
and a task works on a pair of blocks, emitting no more than ``k`` rows a query. Pairs grow with queries times rows, as
asked; what is shuffled grows with that divided by the size of a block. Originals travel with their codes: a query's
survivors in a block are many times fewer than its rows, but those of all queries of a block are more.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Equal scores rank by the smaller id. Rows that repeat are candidates like others; the rows of one query id are one query,
by the least of their vectors, and none of them is its candidate. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagflow.llm.common import written

#: Bytes of a block's vectors, most rows and queries of a block, and queries compared at once.
BLOCK_BYTES, BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 16 << 20, 65536, 8192, 32
#: Standard errors that a bound allows for: 2.5 misses about one vector in 160. Bits of a query's coordinate.
WIDTH, PLANES = 2.5, 4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as words of 64 bits, the last one filled with zeros."""
    filled = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    filled[:, : bits.shape[1]] = bits
    return np.packbits(filled, axis=1).view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and each unit vector's product with its code."""
    most = np.abs(vectors).max(axis=1)
    norms = most * np.linalg.norm(vectors / most[:, None], axis=1)
    turned = ((vectors / most[:, None]) @ turn.T) / (norms / most)[:, None]
    fit = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return packed(turned > 0), norms, fit


class Query:
    """Unit queries, rotated and rounded to PLANES bits a coordinate: low + step * the number that the planes spell."""

    def __init__(self, units: np.ndarray, turn: np.ndarray):
        turned = units @ turn.T
        self.low, span = turned.min(axis=1), np.ptp(turned, axis=1)
        self.step = np.maximum(span, 1e-30) / ((1 << PLANES) - 1)
        number = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * number
        self.sum, self.off = rounded.sum(axis=1), np.linalg.norm(turned - rounded, axis=1)
        self.planes = np.stack([packed(number >> j & 1 > 0) for j in range(PLANES)])

    def estimates(self, bits: np.ndarray, ones: np.ndarray, part: slice) -> np.ndarray:
        """Inner products of these queries with codes whose signs count +1 and -1, by counting common bits."""
        common = np.zeros((len(self.low[part]), len(bits)), np.int32)
        for j in range(PLANES):
            for w in range(bits.shape[1]):
                common += np.bitwise_count(self.planes[j, part, w, None] & bits[None, :, w]).astype(np.int32) << j
        return 2 * (self.low[part, None] * ones + self.step[part, None] * common) - self.sum[part, None]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components, so that equal vectors score equal."""
    out = np.zeros(len(vectors))
    for d in range(len(query)):
        out += vectors[:, d] * query[d]
    return out


def block_best(ids: np.ndarray, vectors: np.ndarray, codes: tuple[np.ndarray, np.ndarray, np.ndarray], q_ids: np.ndarray, queries: np.ndarray, k: int, turn: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The best ``k`` of a block for each query: query id, vector ids, scores."""
    order, dim = np.argsort(ids, kind="stable"), vectors.shape[1]
    ids, vectors, (bits, norms, fit) = ids[order], vectors[order], (c[order] for c in codes)
    longest, ones = norms.max(), np.bitwise_count(bits).sum(axis=1).astype(np.int32)
    most = np.abs(queries).max(axis=1)
    lengths = most * np.linalg.norm(queries / most[:, None], axis=1)
    asked = Query((queries / most[:, None]) / (lengths / most)[:, None], turn)
    scale = norms / longest / fit
    first = min(3 * k, len(ids))
    for at in range(0, len(q_ids), AT_ONCE):
        part = slice(at, min(len(q_ids), at + AT_ONCE))
        error = WIDTH * scale * np.sqrt(np.maximum(0, 1 - fit**2) / max(1, dim - 1) + asked.off[part].max() ** 2 / dim)
        upper = asked.estimates(bits, ones, part) * (scale / np.sqrt(dim)) + error
        for i, row in enumerate(upper, at):
            row[np.searchsorted(ids, q_ids[i]) : np.searchsorted(ids, q_ids[i], side="right")] = -np.inf
            sure = np.argpartition(-row, first - 1)[:first]
            sure = sure[row[sure] > -np.inf]
            if len(sure) == 0:
                continue
            score = exact(vectors[sure], queries[i])
            if len(sure) > k:
                floor = np.partition(score, len(score) - k)[len(score) - k]
                near = np.flatnonzero(row >= floor / (lengths[i] * longest) - 1e-9)
                rough = vectors[near] @ queries[i]
                if len(near) > k:  # rough scores may differ in their last bits; the exact ones decide
                    rough_floor = np.partition(rough, len(rough) - k)[len(rough) - k]
                    near = near[rough >= rough_floor - 1e-9 * lengths[i] * longest]
                sure = near
                score = exact(vectors[sure], queries[i])
            best = np.lexsort((ids[sure], -score))[:k]
            yield int(q_ids[i]), ids[sure[best]], score[best]


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def nearest(table: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows by inner product for each row of ``table`` where ``queries`` holds."""
    good = table.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return good.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    dim, n, asked = sizes[0]
    turn, kind = rotation(dim), good.schema["v"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, norms, fit = encode(b.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.float64), turn)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(norms), pa.array(fit)], names=["id", "v", "asks", "bits", "norm", "fit"])

    coded = good.where(F.size("v") == dim).mapInArrow(code, f"id {dict(good.dtypes)['id']}, v {kind}, asks boolean, bits binary, norm double, fit double")
    coded = written(coded.withColumn("place", F.monotonically_increasing_id()))  # rows are dealt by it: ids may repeat
    blocks = -(-n // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * dim))))
    asked = max(1, asked or 0)
    # No more queries than a block holds, and few enough that all cores have work where there is little of it.
    tasks = table.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(-(-asked // BLOCK_QUERIES), min(-(-asked // AT_ONCE), -(-tasks // blocks)))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = coded.select(dealt("place", blocks).alias("block"), spread(q_blocks).alias("q_block"), F.lit(False).alias("is_query"), "id", "v", "bits", "norm", "fit")
    asks = coded.where("asks").groupBy("id").agg(F.min("v").alias("v")).select(spread(blocks).alias("block"), dealt("id", q_blocks).alias("q_block"), F.lit(True).alias("is_query"), "id", "v")
    asks = asks.withColumns({"bits": F.lit(None).cast("binary"), "norm": F.lit(None).cast("double"), "fit": F.lit(None).cast("double")})

    def work(t: pa.Table) -> pa.Table:
        is_query, ids = t["is_query"].to_numpy(), t["id"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        found = []
        if is_query.any() and not is_query.all():
            mine = ~is_query
            codes = t.filter(pa.array(mine))
            bits = np.frombuffer(b"".join(codes["bits"].to_pylist()), np.uint64).reshape(codes.num_rows, -1)
            found = list(block_best(ids[mine], v[mine].astype(np.float64), (bits, codes["norm"].to_numpy(), codes["fit"].to_numpy()), ids[is_query], v[is_query].astype(np.float64), k, turn))
        asked = [np.full(len(near), q) for q, near, _ in found]
        cols = [np.concatenate([np.zeros(0, kind), *parts]) for kind, parts in ((np.int64, asked), (np.int64, [x[1] for x in found]), (np.float64, [x[2] for x in found]))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    found = rows.unionByName(asks).groupBy("block", "q_block").applyInArrow(work, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
