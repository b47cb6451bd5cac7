"""Token ids in a binary format: static range asymmetric numeral systems over interleaved lanes.

One frequency table, counted over all ids, is shared by all blocks. A block holds the ids of some documents in order,
dealt over interleaved lanes with 64-bit states. Its checkpoints (lane states, place in the words, checksum of the ids
up to the next one) part it: each part is decoded and checked on its own. A block carries a checksum of its payload too.

A written corpus is a folder with ``blocks`` (a row a block: place of its first id, document table, payload) and
``table`` (id, frequency). Spark writes and reads both, so any file system it knows will do. Blocks are read in one go;
the parts of a block that a long document has for itself are dealt to tasks of their own.

Cases: a null text is empty and gets the end id alone. Documents are in ascending order of their id, nulls first;
repeated ids follow one another, ordered by the text's hash. A very long document is a block of its own. An empty table gives
empty folders. Only the named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.llm.common import slices, written
from tagflow.llm.tokens import column_bpe

# Fixed values of the format.
MAGIC = b"TFR1"
SCALE_BITS = 20
LOW = 1 << 31
HEAD = struct.Struct("<4sIIIII")  # magic, ids, lanes, checkpoint rows, words, crc of the rest
MARK = struct.Struct("<II")  # crc of the ids up to the next checkpoint, place in the words; then the lanes' states
PART = struct.Struct("<III")  # ids, lanes, their crc; then the lanes' states and words

#: Ids of a block, most lanes, and rows between checkpoints.
BLOCK_IDS, LANES, CHECKPOINT_ROWS = 1 << 20, 4096, 128


def scaled(ids: np.ndarray, counts: np.ndarray, size: int, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of all ids below ``size``, 1 at least where an id occurs, that sum to 2**bits."""
    out, whole = np.zeros(size, np.int64), 1 << bits
    if len(ids) == 0:
        return out
    if len(ids) > whole:
        raise ValueError(f"{len(ids)} different ids don't fit {bits} bits")
    share = counts * ((whole - len(ids)) / counts.sum())
    freq = 1 + np.floor(share).astype(np.int64)
    rest = whole - int(freq.sum())
    top = np.argsort(-(share - np.floor(share)), kind="stable")[:rest]
    freq[top] += 1
    out[ids] = freq
    return out


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.begin = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_ROWS) -> bytes:
        while lanes > 1 and len(ids) < 64 * lanes:
            lanes //= 2
        freq, begin = self.freq[ids], self.begin[ids]
        limit = freq << np.uint64(63 - SCALE_BITS)
        states, words, marks, emitted = np.full(lanes, LOW, np.uint64), [], [], 0
        bits, half = np.uint64(SCALE_BITS), np.uint64(32)
        for row in range(-(-len(ids) // lanes) - 1, -1, -1):
            span = slice(row * lanes, min(len(ids), (row + 1) * lanes))
            x, f = states[: span.stop - span.start], freq[span]
            full = x >= limit[span]
            if full.any():
                out = x[full]
                words.append(out.astype(np.uint32))
                emitted += len(out)
                x[full] = out >> half
            q, r = np.divmod(x, f)
            x[:] = (q << bits) + r + begin[span]
            if row % every == 0:
                crc = zlib.crc32(ids[row * lanes : (row + every) * lanes].astype("<u4").tobytes())
                marks.append((crc, emitted, states.copy()))
        tail = b"".join(MARK.pack(crc, emitted - done) + s.astype("<u8").tobytes() for crc, done, s in reversed(marks))
        tail += b"".join(w.astype("<u4").tobytes() for w in reversed(words))
        return HEAD.pack(MAGIC, len(ids), lanes, every, emitted, zlib.crc32(tail)) + tail

    def decode_part(self, part: bytes) -> np.ndarray:
        """The ids of a part; raises if they don't match their checksum."""
        n, lanes, crc = PART.unpack_from(part)
        states = np.frombuffer(part, "<u8", lanes, PART.size).copy()
        words, at = np.frombuffer(part, "<u4", -1, PART.size + 8 * lanes), 0
        out = np.empty(n, np.uint32)
        mask, bits, half, low = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32), np.uint64(LOW)
        for begin in range(0, n, lanes):
            x = states[: min(n - begin, lanes)]
            slot = x & mask
            ids = self.symbol[slot]
            out[begin : begin + lanes] = ids
            x[:] = self.freq[ids] * (x >> bits) + slot - self.begin[ids]
            need = np.flatnonzero(x < low)
            if at + len(need) > len(words):
                raise ValueError("the part is damaged: its words end early")
            x[need] = (x[need] << half) | words[at : at + len(need)]
            at += len(need)
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("the part is damaged: its ids don't match their checksum")
        return out

    def decode(self, block: bytes) -> np.ndarray:
        """The ids of a block; raises if it is damaged."""
        if not whole(block):
            raise ValueError("the block is damaged")
        return np.concatenate([np.zeros(0, np.uint32), *(self.decode_part(p) for p in parts_of(block))])


def whole(block: bytes) -> bool:
    magic, _, _, _, _, crc = HEAD.unpack_from(block)
    return magic == MAGIC and zlib.crc32(memoryview(block)[HEAD.size :]) == crc


def parts_of(block: bytes) -> Iterator[bytes]:
    """The parts of a block from each checkpoint to the next: what decodes by itself."""
    _, n, lanes, every, n_words, _ = HEAD.unpack_from(block)
    count = -(-n // (lanes * every))
    step = MARK.size + 8 * lanes
    words = HEAD.size + count * step
    marks = [MARK.unpack_from(block, HEAD.size + k * step) for k in range(count)] + [(0, n_words)]
    for k in range(count):
        crc, place = marks[k]
        at = HEAD.size + k * step + MARK.size
        ids = min(lanes * every, n - k * lanes * every)
        yield PART.pack(ids, lanes, crc) + block[at : at + 8 * lanes] + block[words + 4 * place : words + 4 * marks[k + 1][1]]


def tokenized(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """The ids of each document, in order within ``_part``; ``_part`` are ranges of ``key``, ``_before`` counts the part's ids so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, before = column_bpe(path), 0
        narrow = np.uint16 if bpe.size <= 1 << 16 else np.uint32
        for b in slices(batches, "text"):
            ids, offs = bpe.encode(b.column("text"))
            ids = np.insert(ids.astype(narrow), offs[1:], end_id)
            offs = offs + np.arange(len(offs))
            raw = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("_part"), pa.array(before + offs[:-1]), b.column("key"), pa.array(np.diff(offs)), raw], names=["_part", "_before", "key", "n", "ids"])
            before += int(offs[-1])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Range bounds are sampled to the driver, so they hold a hash of the text, not the text.
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kind = dict(named.dtypes)["key"]
    return dealt.mapInArrow(run, f"_part int, _before long, key {kind}, n long, ids binary")


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes all texts, an ``end_id`` behind each, into ``folder``. Only frequencies (bounded by the vocabulary) and a count per part reach the driver."""
    size = column_bpe(path).size
    width = 2 if size <= 1 << 16 else 4
    tokens = written(tokenized(docs, path, end_id, key, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), f"<u{width}"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    freq = scaled(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.float64), size)
    seen = np.flatnonzero(freq)
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(freq[i])) for i in seen], "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    before, total = {}, 0
    for part, n in sorted(map(tuple, tokens.groupBy("_part").agg(F.sum("n")).collect())):
        before[part], total = total, total + n
    kind = dict(tokens.dtypes)["key"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, held_n = Coder(freq), [], 0

        def block() -> pa.RecordBatch:
            part, at, keys, sizes, ids = (list(c) for c in zip(*held, strict=True))
            payload = coder.encode(np.frombuffer(b"".join(ids), f"<u{width}"), LANES, CHECKPOINT_ROWS)
            cols = [pa.array([before[part[0]] + at[0]]), pa.array([sum(sizes) > BLOCK_IDS]), pa.array([keys], pa.list_(key_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["start", "long", "keys", "sizes", "payload"])

        for b in batches:
            key_type = b.column("key").type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (held_n + row[3] > BLOCK_IDS or held[-1][0] != row[0] or held[-1][1] + held[-1][3] != row[1]):
                    yield block()
                    held, held_n = [], 0
                held.append(row)
                held_n += row[3]
        if held:
            yield block()

    tokens.select("_part", "_before", "key", "n", "ids").mapInArrow(blocks, f"start long, long boolean, keys array<{kind}>, sizes array<long>, payload binary").write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, vocabulary: int) -> DataFrame:
    """key, start, n, ids (little-endian unsigned 32-bit integers) of each document in ``folder``."""
    freq = np.zeros(vocabulary, np.int64)
    for i, f in spark.read.parquet(f"{folder}/table").collect():  # bounded by the vocabulary
        freq[i] = f
    stored = spark.read.parquet(f"{folder}/blocks")
    kind = stored.select(F.get("keys", F.lit(0)).alias("k")).dtypes[0][1]
    schema = f"key {kind}, start long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            for start, keys, sizes, payload in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ids = coder.decode(payload)
                offs = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
                raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(offs, offs[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start + offs[:-1]), pa.array(np.diff(offs)), pa.array(raw, pa.binary())], names=["key", "start", "n", "ids"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, payload in enumerate(b.column(3)):
                for k, part in enumerate(parts_of(payload.as_py())):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(2).slice(i, 1), pa.array([k]), pa.array([part])], names=["key", "start", "n", "part", "ids"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            ids = [coder.decode_part(p).astype("<u4").tobytes() for p in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], names=["key", "start", "n", "part", "ids"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["part"])) for parts in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], names=["key", "start", "n", "ids"])

    blocks = stored.where("NOT long").select("start", "keys", "sizes", "payload").mapInArrow(run, schema)
    of = f"key {kind}, start long, n long, part long, ids binary"
    lone = stored.where("long").select(F.get("keys", F.lit(0)).alias("key"), "start", F.get("sizes", F.lit(0)).alias("n"), "payload")
    long = lone.mapInArrow(parts, of).repartition("start", "part").mapInArrow(decoded, of)
    long = long.groupBy("key", "start", "n").agg(F.collect_list(F.struct("part", "ids")).alias("parts")).mapInArrow(together, schema)
    return blocks.unionByName(long)
