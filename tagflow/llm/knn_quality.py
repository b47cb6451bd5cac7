"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are hashed pairs of bytes and levels of repetition and layout. Weights use document frequencies over
all documents; a truncated singular value decomposition of a bounded, documented sample of labelled rows gives the
latent space. The labelled vectors (at most MOST_LABELLED rows of RANK numbers) are broadcast, and every document's
exact cosines with all of them are computed in blocks; the nearest vote, weighted by similarity.

Cases: a null or empty text has no terms and gets the labelled rows' share of label 1. Labels that are null or other
than 0 and 1, and rows held out, teach nothing; a document with several labels counts with the smallest, an id with
several texts teaches the one of the least hash. Equal cosines vote in the order of the labelled rows' ids. Without
labelled rows every score is 0.5. Repeated rows are scored as often. An empty table gives an empty result. Labels, ids,
languages and sources are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import slices, unused

#: Labelled rows that are learnt from at most (the smallest hashes of their ids), half for each label where there are as many.
MOST_LABELLED = 4000
#: Hashed byte pairs, steps of each level, dimensions of the latent space, voters, and the power of a voter's cosine.
PAIRS, STEPS, RANK, VOTERS, SHARPNESS = 2048, 24, 48, 25, 8
#: Subspace iterations of the decomposition, and dimensions beyond RANK that they carry.
ITERATIONS, SPARE = 20, 16
#: Documents of a block of cosines.
BLOCK = 512

LEVELS = 7
TERMS = PAIRS + LEVELS * STEPS
#: Weight of a level term against a document's most frequent pairs.
LEVEL_WEIGHT = 10.0


def levels(raw: bytes) -> list[float]:
    """Shares between 0 and 1 that tell how repetitive or broken a text's layout is."""
    words = raw.split()
    n = len(words) or 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    upper = len(raw.translate(None, DELETE_BUT_UPPER))
    letters = len(raw.translate(None, DELETE_LETTERS))
    marks = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return [
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(windows)) / (len(windows) or 1),
        1 - len(set(lines)) / (len(lines) or 1),
        upper / (len(raw) or 1),
        letters / (len(raw) or 1),
        min(1.0, 4 * marks / n),
    ]


DELETE_BUT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
DELETE_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b == 32)


def pair_counts(raw: bytes) -> np.ndarray:
    """How often each hashed pair of neighbouring bytes occurs."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    pairs = ((b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(16)) % np.uint32(PAIRS)
    return np.bincount(pairs, minlength=PAIRS)


def terms(texts: list[bytes]) -> np.ndarray:
    """The term weights of each text before document frequencies: damped counts of byte pairs, and the level terms."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, raw in enumerate(texts):
        if not raw.strip():
            continue
        out[i, :PAIRS] = pair_counts(raw)
        for k, share in enumerate(levels(raw)):
            # A level is spread over two neighbouring steps, so that near levels share terms; small shares have finer steps.
            place = np.sqrt(share) * (STEPS - 1)
            step = min(int(place), STEPS - 2)
            out[i, PAIRS + k * STEPS + step] = 1 - (place - step)
            out[i, PAIRS + k * STEPS + step + 1] = place - step
    pairs = out[:, :PAIRS]
    np.log1p(pairs, out=pairs)
    norm = np.linalg.norm(pairs, axis=1, keepdims=True)
    pairs /= np.where(norm > 0, norm, 1)
    out[:, PAIRS:] *= LEVEL_WEIGHT / np.sqrt(LEVELS) / 4
    return out


def binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest of each row; of equal ones those that come first."""
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosines, near, axis=1).min(axis=1, keepdims=True)
    for i in np.flatnonzero((cosines >= least).sum(axis=1) > k):
        near[i] = np.argsort(-cosines[i], kind="stable")[:k]
    return near


@dataclass
class Model:
    """What the workers get: bounded by TERMS, RANK and MOST_LABELLED."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.basis
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.labels) == 0:
            return np.full(len(x), 0.5)
        z = self.latent(x)
        cosines = z @ self.vectors.T
        k = min(VOTERS, len(self.labels))
        near = nearest(cosines, k)
        w = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float) ** SHARPNESS
        w *= np.where(self.labels[near] == 1, self.prior / max(self.labels.mean(), 1e-9), (1 - self.prior) / max(1 - self.labels.mean(), 1e-9))
        total = w.sum(axis=1)
        out = (w * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, out, self.prior)


def leading(a: np.ndarray, rank: int) -> np.ndarray:
    """The right singular vectors of ``a`` of the largest values, by subspace iteration: no square matrix of the terms."""
    q = np.random.default_rng(0).standard_normal((a.shape[1], rank + SPARE)).astype(np.float32)
    for _ in range(ITERATIONS):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, turn = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ turn.T)[:, :rank].astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, prior: float, frequency: np.ndarray, n_docs: int) -> Model:
    weights = np.ones(TERMS, np.float32)
    weights[:PAIRS] += np.log((1 + n_docs) / (1 + frequency))
    a = x * weights
    if len(a):
        basis = leading(a, RANK)
    else:
        basis = np.zeros((TERMS, RANK), np.float32)
    model = Model(weights, basis, np.zeros((0, RANK), np.float32), y.astype(np.float64), prior)
    model.vectors = model.latent(x)
    return model


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Document frequencies of all documents, and the model of the sample of ``labels`` that isn't held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(PAIRS, np.int64), 0
        for b in slices(batches, "text", 4 << 20):
            for raw in binary(b.column("text")):
                total += pair_counts(raw) > 0
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PAIRS + 1)), pa.array(np.append(total, n))], names=["term", "n"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = named.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = np.zeros(PAIRS + 1, np.int64)
    for term, n in counts.collect():  # one row for each term
        frequency[term] = n
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.min("y").alias("y"))
    shares = dict(map(tuple, known.groupBy("y").count().collect()))
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    half = MOST_LABELLED // 2
    few = [known.where(F.col("y") == v).orderBy(F.xxhash64("key"), "key").limit(max(half, MOST_LABELLED - shares.get(1 - v, 0))) for v in (0, 1)]
    chosen = few[0].unionByName(few[1])  # MOST_LABELLED rows at most

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = terms(binary(pc.fill_null(b.column("text"), "")))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "y", "x"])

    kinds = dict(named.dtypes)["key"], dict(chosen.dtypes)["y"]
    once = named.join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    rows = once.mapInArrow(sample, f"key {kinds[0]}, y {kinds[1]}, x binary").collect()
    rows.sort(key=lambda r: r["key"])
    x, y = np.zeros((len(rows), TERMS), np.float32), np.array([r["y"] for r in rows])
    for i in range(len(rows)):
        x[i], rows[i] = np.frombuffer(rows[i]["x"], np.float32), None
    return fit(x, y, prior, frequency[:-1], int(frequency[-1]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The scores of a column of texts, in blocks."""
    raw = binary(texts)
    return np.concatenate([np.zeros(0), *(model.score(terms(raw[at : at + BLOCK])) for at in range(0, len(raw), BLOCK))])


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted. A column of these names is replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    body = unused("_text", kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, body, 4 << 20):
            s = scores(model, b.column(body))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)
    return docs.select(*kept, F.col(text).alias(body)).mapInArrow(run, f"{schema}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, all columns as they are."""
    body, names = unused("_text", docs.columns), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, body, 4 << 20):
            yield b.select(names).filter(pa.array(scores(model, b.column(body)) >= 0.5))

    return docs.select("*", F.col(text).alias(body)).mapInArrow(run, docs.schema)
