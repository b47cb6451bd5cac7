"""Near-duplicate texts by the exact similarity of their word shingles.

Two texts are linked if the sets of their runs of ``words`` words have a Jaccard similarity of ``least`` or more. Equal
texts are one node from the start. Nodes that share a band of four minimum hashes, of BANDS, meet in a bucket: a pair as
similar as ``least`` shares none with a probability of (1 - least^4)^BANDS, 2.7e-5 at 0.8. Each node has a sketch, the
parities of its shingles' hashes in at least twice as many cells as shingles. Sketches never differ in more cells than
the sets in shingles, so a pair that they rule out is no link; every other pair is compared by its texts before it
counts. What pigeonring filtering of SimHash fingerprints links is compared too; by itself it misses most of these
links, which differ in 5 to 13 bits.

Not all pairs of a bucket need to be compared. First every node meets the least node of each of its buckets. Nodes that
are then connected need no more comparisons with one another; of the others, each node meets the NEAREST of other
components that its buckets hold, and in the end all pairs of different components that the sketches leave. So a large
group of near copies costs a few comparisons a node, and no link between components is lost.

Cases: words are as in ``simhash``; a text of fewer words than a shingle is one shingle. Null and empty texts and white
space are one node. Repeated rows share their component. Rows without an id stay. An empty table gives an empty
result. Only the named columns are read for the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import broadcast_if_small, spread_join, unused, written
from tagflow.llm.components import components
from tagflow.llm.simhash import LOWER, by_cells, cells, links, majority

WORDS, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS = 20, 4
#: Cells of the smallest sketch, and partners of each node in the second round.
SKETCH, NEAREST = 512, 3

#: A character of a word.
WORD_CHARACTER = "[^ \\t\\n\\x0B\\f\\r]"


def name_of(text: Column) -> Column:
    """A 128-bit hash of a text; all texts without words have the same."""
    return F.when(F.coalesce(text, F.lit("")).rlike(WORD_CHARACTER), F.unhex(F.md5(text))).otherwise(F.unhex(F.lit("00" * 16)))


def shingles(text: str | None, words: int) -> set[bytes]:
    found = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    k = min(words, len(found))
    return {b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set()


def cells_of(n: int) -> int:
    return max(SKETCH, 1 << (2 * n - 1).bit_length())


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The sketch and the bands of a set of distinct hashes."""
    cells = cells_of(len(hashes))
    sketch = np.packbits((np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * a + b).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    band = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        band = (band ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return sketch, band.view(np.int64)


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of ``width`` or twice as many bytes as words of ``width`` bytes; halves add up as parities do."""
    raw = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    half = width // 8
    return raw if raw.shape[1] == half else raw[:, :half] ^ raw[:, half:]


def signed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, name, size (distinct shingles), SimHash, sketch and bands of each row; nothing of a text without words."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, sketches, bands = [], [], [], []
            for t in batch.column(2).to_pylist():
                found = shingles(t, words)
                hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))
                sketch, band = signature(hashes, a, b) if found else (None, None)
                sizes.append(len(hashes))
                fps.append(majority(hashes))
                sketches.append(sketch)
                bands.append(band)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "name", "size", "fp", "sketch", "bands"])

    named = docs.select(F.col(key).alias("key"), name_of(F.col(text)).alias("name"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {dict(named.dtypes)['key']}, name binary, size int, fp long, sketch binary, bands array<long>")


def plausible(apart: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets of ``x`` and ``y`` shingles may be links if their sketches are ``apart``, and the bound on that."""
    bound = (x + y) * ((1 - least) / (1 + least)) + 1e-6
    return (apart <= bound) & (np.minimum(x, y) >= least * np.maximum(x, y) - 1e-6), bound


def likely(sizes: np.ndarray, sketches: list[bytes], roots: np.ndarray, side: np.ndarray | None, least: float, nearest: int | None) -> np.ndarray:
    """Index pairs of different components that the sketches leave; between the two sides, if any are given. With
    ``nearest``, those that are among so many nearest of one of the two."""
    width, found = np.fromiter(map(len, sketches), np.int64, len(sketches)), []
    for w in np.unique(width):
        for v in (w, 2 * w) if side is None else (w // 2, w, 2 * w):
            left = np.flatnonzero(width == w) if side is None else np.flatnonzero((width == w) & ~side)
            right = np.flatnonzero(width == v) if side is None else np.flatnonzero((width == v) & side)
            if not len(left) or not len(right):
                continue
            a, b = (folded([sketches[k] for k in at], int(min(v, w))) for at in (left, right))
            apart = np.zeros((len(left), len(right)), np.int64)
            for c in range(a.shape[1]):
                apart += np.bitwise_count(a[:, None, c] ^ b[None, :, c])
            fine, bound = plausible(apart, sizes[left, None], sizes[None, right], least)
            fine &= roots[left, None] != roots[None, right]
            if side is None and v == w:
                fine &= left[:, None] < right[None, :]
            i, j = np.nonzero(fine)
            found.append(np.stack([left[i], right[j], (1e6 * apart[i, j] / bound[i, j]).astype(np.int64)], axis=1))
    pairs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if nearest is not None and len(pairs):
        ends, far, at = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.tile(pairs[:, 2], 2), np.tile(np.arange(len(pairs)), 2)
        order = np.lexsort((far, ends))
        ends, at = ends[order], at[order]
        rank = np.arange(len(ends)) - np.searchsorted(ends, ends)
        pairs = pairs[np.unique(at[rank < nearest])]
    return pairs[:, :2]


def bucketed(nodes: DataFrame) -> DataFrame:
    """seg, val, id and pivot (the bucket's least id) of the buckets that two nodes or more share."""
    banded = nodes.select(F.posexplode("bands").alias("seg", "val"), "id")
    shared = banded.groupBy("seg", "val").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1").drop("n")
    return written(banded.join(shared.hint("merge"), ["seg", "val"]))


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes of one fingerprint with the least of them, and those that pigeonring filtering links."""
    least = written(nodes.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    equal = spread_join(nodes.select("fp", F.col("id").alias("b")), least.select("fp", F.col("id").alias("a")), "fp", least, nodes.count()).select("a", "b").where("a <> b")
    side = lambda c: least.select(F.col("fp").alias(f"fp_{c}"), F.col("id").alias(c))
    linked = links(least).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(side("a").hint("merge"), "fp_a").join(side("b").hint("merge"), "fp_b")
    return equal.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def pivot_pairs(shared: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a, b: pivots and the nodes of their buckets, and what SimHash links, that their sketches leave."""
    pivots = shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    pairs = written(pivots.unionByName(simhash_pairs(nodes)).distinct())
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = spread_join(pairs.join(of("b").hint("merge"), "b"), of("a"), "a", pairs.groupBy("a").agg(F.count("*").alias("n")), pairs.count())
    near = both.where(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            left, right, apart = t.column("sketch_a").to_pylist(), t.column("sketch_b").to_pylist(), []
            for s, o in zip(left, right, strict=True):
                w = min(len(s), len(o))
                apart.append(int(np.bitwise_count(folded([s], w) ^ folded([o], w)).sum()))
            fine, _ = plausible(np.array(apart), t.column("size_a").to_numpy(), t.column("size_b").to_numpy(), least)
            yield t.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return near.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def mixed_buckets(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """seg, val, fp (a node) and root: the buckets that hold nodes of different components."""
    named = shared.join(roots.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("seg", "val", "id", F.coalesce("root", "id").alias("root"))
    named = written(named)
    mixed = named.groupBy("seg", "val").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("seg", "val")
    return written(named.join(mixed.hint("merge"), ["seg", "val"]).withColumnRenamed("id", "fp"))


def bucket_pairs(left: DataFrame, nodes: DataFrame, least: float, nearest: int | None) -> DataFrame:
    """a, b, ra, rb: pairs of nodes of different components (roots) that meet in a bucket and that their sketches leave."""
    of = nodes.select(F.col("id").alias("fp"), "size", "sketch").join(left.select("fp", "root").distinct().hint("merge"), "fp")
    dealt = cells(left.drop("root"), left.groupBy("seg", "val").agg(F.count("*").alias("n"))).join(of.hint("merge"), "fp")

    def emit(t: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, sizes, roots, side, los, his = (t[c].to_numpy() for c in ("fp", "size", "root", "side", "lo", "hi"))
        sizes, sketches, found = sizes.astype(np.int64), t["sketch"].to_pylist(), []
        for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if y - x > 1:
                found.append(x + likely(sizes[x:y], sketches[x:y], roots[x:y], None if los[x] == his[x] else side[x:y], least, nearest))
        if found:
            p, q = np.concatenate(found).T
            low = ids[p] < ids[q]
            p, q = np.where(low, p, q), np.where(low, q, p)
            _, once = np.unique(np.stack([ids[p], ids[q]]), axis=1, return_index=True)
            p, q = p[once], q[once]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[p], ids[q], roots[p], roots[q])], names=["a", "b", "ra", "rb"])

    return by_cells(dealt, emit, "a long, b long, ra long, rb long").distinct()


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, text: str, words: int, least: float) -> DataFrame:
    """The ``pairs`` (written, with a and b) whose texts are as similar as ``least``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = broadcast_if_small(nodes.select("id", "name").join(wanted, "id", "left_semi"))
    texts = docs.select(name_of(F.col(text)).alias("name"), F.col(text).alias("text")).join(wanted, "name").groupBy("id").agg(F.first("text").alias("text"))
    texts = written(texts)
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    both, names = spread_join(pairs.join(side("b").hint("merge"), "b"), side("a"), "a", pairs.groupBy("a").agg(F.count("*").alias("n")), pairs.count()), pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for s, t in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                x, y = shingles(s, words), shingles(t, words)
                kept.append(len(x & y) >= least * len(x | y) - 1e-9)
            yield batch.select(names).filter(pa.array(kept, pa.bool_()))

    return both.select(*names, "text_a", "text_b").mapInArrow(run, pairs.schema)


def connected(docs: DataFrame, nodes: DataFrame, text: str, words: int, least: float) -> DataFrame:
    """node (the id of one of ``nodes``) and root for each node that is linked to another."""
    shared = bucketed(nodes)
    pairs = written(pivot_pairs(shared, nodes, least))
    roots = components(verified(docs, nodes, pairs, text, words, least))
    tried = pairs
    left = None
    for nearest in (NEAREST, None):
        if left is None:
            left = mixed_buckets(shared, roots)
        pairs = written(bucket_pairs(left, nodes, least, nearest).join(tried.hint("merge"), ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue  # all nearest ones have been tried; farther ones may not have been
        tried, found = tried.unionByName(pairs.select("a", "b")), written(verified(docs, nodes, pairs, text, words, least))
        if found.isEmpty():
            continue
        left = None
        merged = components(found, "ra", "rb").select(F.col("node").alias("old"), F.col("root").alias("new"))
        named = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).unionByName(merged.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
        roots = written(named.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).where("node <> root"))
    return roots


def grouped(docs: DataFrame, key: str, text: str, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """key and name of each row, and name, root (the same for the nodes of a component) and first (a node's least key)."""
    marked = written(signed(docs, key, text, words))
    once = marked.groupBy("name").agg(F.min("key").alias("first"), *(F.first(c).alias(c) for c in ("size", "fp", "sketch", "bands")))
    nodes = written(once.withColumn("id", F.monotonically_increasing_id()))
    roots = connected(docs, nodes.where("size > 0"), text, words, least)
    of = nodes.select("id", "name", "first").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return marked.select("key", "name"), of.select("name", F.coalesce("root", "id").alias("root"), "first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``key``, name (of the text) and component (the smallest key reachable) for each row of ``docs``."""
    marked, of = grouped(docs, key, text, words, least)
    of = written(of)
    least_key = of.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n"))
    named = spread_join(of.select("root", "name"), least_key.drop("n"), "root", least_key, of.count()).select("name", "component")
    out = spread_join(marked, named, "name", marked.groupBy("name").agg(F.count("*").alias("n")), marked.count())
    return out.select(F.col("key").alias(key), "name", "component")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id and, should that id have several of its texts, of
    one text. An id of two components stays with a row for each. Rows without an id, which can name none, stay."""
    _, of = grouped(docs.where(F.col(key).isNotNull()), key, text, words, least)
    name, least_key = unused("_name", docs.columns), unused("_least", docs.columns)
    keep = of.groupBy("root").agg(F.min(F.struct("first", "name")).alias("k")).select(F.col("k.first").alias(least_key), F.col("k.name").alias(f"{name}_kept"))
    with_name = docs.withColumn(name, name_of(F.col(text)))
    kept = with_name.join(keep, (F.col(key) == F.col(least_key)) & (F.col(name) == F.col(f"{name}_kept")), "left_semi").dropDuplicates([key, name]).drop(name)
    return kept.unionByName(docs.where(F.col(key).isNull()))
