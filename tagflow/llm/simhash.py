"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint's 64 bits form a ring of five segments. If two fingerprints differ in at most four bits, some segment
starts a chain around the ring whose first l segments differ in at most floor(4 l / 5) bits for every l: none in the
first, one in the first two, two in the first three, and so on. Distinct fingerprints are therefore dealt by two
neighbouring segments, 25 or 26 bits: to the bucket of their own bits and, for the one bit that the second may differ in, to those
where one of its set bits is cleared (of two that differ there, one has it set). Inside a bucket the budgets of the
longer chains prune pairs before the full Hamming check.

Buckets above a bounded size are dealt to pairs of blocks, so that no task holds more than two blocks; a task emits a
spanning forest of the links it finds, never all pairs. Equal texts and fingerprints are one node from the start.

Cases: a null or empty text, or one of white space, has no words and fingerprint zero, linked like any other. Repeated
rows share their component and stay as often. Rows with a null id are linked, but a component's id is null only if all
its ids are. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import spread_join, written
from tagflow.llm.components import components

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Widths of the ring's segments: one more than the bits that may differ.
SEGMENTS = (13, 13, 13, 13, 12)
SHIFTS = tuple(sum(SEGMENTS[k + 1 :]) for k in range(len(SEGMENTS)))
#: Rows of a block; a bucket with more is dealt to pairs of blocks. Pairs that a task looks at together.
BLOCK, PAIRS_AT_ONCE = 1024, 1 << 20

#: A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE_WORDS, len(words))
    spans = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in spans]), ">u8"))


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {dict(named.dtypes)['key']}, fp long")


def dealt_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """seg, val, cleared and the fingerprint's place for each bucket that a fingerprint goes to."""
    out, m = [], len(SEGMENTS)
    value = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(SHIFTS, SEGMENTS, strict=True)]
    for k in range(m):
        first, second, width = value[k], value[(k + 1) % m], SEGMENTS[(k + 1) % m]
        own = (first << np.uint64(width)) | second
        out.append((k, own, False, np.arange(len(fps))))
        for bit in range(width):
            at = np.flatnonzero(second >> np.uint64(bit) & np.uint64(1))
            out.append((k, own[at] ^ np.uint64(1 << bit), True, at))
    sizes = [len(at) for _, _, _, at in out]
    seg, cleared = (np.repeat(np.array([r[c] for r in out]), sizes) for c in (0, 2))
    return seg.astype(np.int32), np.concatenate([r[1] for r in out]).astype(np.int32), cleared, np.concatenate([r[3] for r in out])


def chained(first: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which differences keep every budget of the chain from segment ``first``; the last budget is the full check."""
    m, at, total = len(SEGMENTS), np.arange(len(apart)), np.zeros(len(apart), np.int64)
    shifts, masks = np.array(SHIFTS, np.uint64), np.array([(1 << w) - 1 for w in SEGMENTS], np.uint64)
    for step in range(m):
        s = (first[at] + step) % m
        total = total + np.bitwise_count((apart[at] >> shifts[s]) & masks[s])
        keep = total <= (step + 1) * MAX_BITS // m
        at, total = at[keep], total[keep]
    return at


def within_cells(begins: np.ndarray, ends: np.ndarray, most: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of the rows that share a cell, about ``most`` at a time; ``begins`` and ``ends`` of each cell's rows."""
    sizes = ends - begins
    stop = np.repeat(ends, sizes)
    rows = np.arange(len(stop)) + (begins[0] if len(begins) else 0)
    later = stop - rows - 1
    done = np.cumsum(later)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, side="right")))
        n = later[at:upto]
        i = np.repeat(rows[at:upto], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = upto


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links (node, root) of a spanning forest of ``pairs`` over n nodes."""
    if len(pairs) == 0:
        return []
    root = np.arange(n)
    while True:  # roots only fall, to the least index that a pair reaches
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], root[pairs[:, 0]])
        new = new[new]
        if (new == root).all():
            moved = np.flatnonzero(root != np.arange(n))
            return list(zip(moved.tolist(), root[moved].tolist(), strict=True))
        root = new


def cells(buckets: DataFrame, counted: DataFrame, *carried: str) -> DataFrame:
    """``buckets`` (seg, val, fp) with the cell that a row goes to and ``side``: small buckets are one cell, others all pairs of blocks.

    ``counted``: seg, val and n, the rows of the buckets that are wanted.
    """
    out = buckets.join(counted.select("seg", "val", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).hint("merge"), ["seg", "val"])
    out = out.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return out.select("seg", "val", low.alias("lo"), high.alias("hi"), (F.col("own") == high).alias("side"), "fp", *carried)


def by_cells(dealt: DataFrame, emit: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``emit`` makes of whole cells: it gets a table of some of them, and where each begins, with the end behind."""
    order = ["seg", "val", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cols = [t[c].to_numpy() for c in order]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from emit(t.slice(0, cut), np.concatenate([[0], change]))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from emit(held, np.array([0, held.num_rows]))

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp), enough to connect all that differ in at most MAX_BITS bits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            seg, val, cleared, at = dealt_rows(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(val), pa.array(cleared), pa.array(fp[at])], names=["seg", "val", "cleared", "fp"])

    buckets = fps.select("fp").mapInArrow(deal, "seg int, val int, cleared boolean, fp long")
    own = F.count(F.when(~F.col("cleared"), 1))
    wanted = buckets.groupBy("seg", "val").agg(F.count("*").alias("n"), own.alias("own")).where("n > 1 AND own > 0")

    def emit(t: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        seg, cleared, side, fp = (t[c].to_numpy() for c in ("seg", "cleared", "side", "fp"))
        fp, split = fp.view(np.uint64), t["lo"].to_numpy() != t["hi"].to_numpy()
        for i, j in within_cells(begins[:-1], begins[1:]):
            fine = ~(cleared[i] & cleared[j]) & (~split[i] | (side[i] != side[j]))
            i, j = i[fine], j[fine]
            near = chained(seg[i], fp[i] ^ fp[j])
            if len(near):
                ab = np.array(forest(np.stack([i[near], j[near]], axis=1), len(fp)))
                ab = fp[ab].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

    return by_cells(cells(buckets, wanted, "cleared"), emit, "a long, b long")


def grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """key and fp of each row, and fp, root, least (a fingerprint's least key) and n (its rows) of each fingerprint."""
    marked = written(fingerprinted(docs, key, text))
    nodes = written(marked.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp")))
    return marked, written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, fp (signed) and component (the smallest key reachable) for each row of ``docs``."""
    marked, of = grouped(docs, key, text)
    least = of.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    named = spread_join(of.select("root", "fp"), least.drop("n"), "root", least, of.count()).select("fp", "component")
    return spread_join(marked, named, "fp", of.select("fp", "n"), marked.count()).select(F.col("key").alias(key), "fp", "component")

