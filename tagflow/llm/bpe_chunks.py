"""BPE encoding that reuses content-defined chunks, and decoding.

A rolling hash cuts every text into chunks wherever their content says so, so passages that texts share give equal
chunks. Texts and chunks are named by 128-bit hashes. Chunks found more than once are encoded once; each text then joins
their ids with those of its own stretches. A cut may fall inside a token, so every joint is repaired: a window that
reaches a word beyond the place in doubt, on either side, is encoded anew, and stands in for the ids of both sides only
if the re-encoded outer words are, token by token, those of the chunks' own ids; else the window widens on the side that
disagrees, twice as far each time, until it takes in the whole chunk.

Windows begin and end at safe places, before a space that follows a character other than white space: tokens never span
it. Texts and chunks of very many rows are dealt over salts, so that no key is one task's load.

Cases: a null text is empty. A text that holds an added token's string is one chunk and encoded by the library. Repeated
rows and equal texts are chunked and encoded once, and are results as often. An empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagflow.llm.common import for_salts, returning_memory, salted, salts_of, slices, written
from tagflow.llm.tokens import ColumnBPE, added_tokens, column_bpe, decoder, token_sizes

#: Rolling window, least chunk and the hash bits that must be zero at a cut (chunks of about 2**CUT_BITS bytes more).
ROLL, LEAST_CHUNK, CUT_BITS = 32, 128, 9
#: Bytes of text that a task joins at a time; a longer text is by itself.
OPENED_BYTES = 2 << 20

# White space, as bytes of ASCII and as the UTF-8 of the characters beyond.
WHITE_BYTES = b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
WHITE_PAIRS = (b"\xc2\x85", b"\xc2\xa0")
WHITE_TRIPLES = (b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([c]) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80")


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where the rolling hash of the ROLL bytes before says to cut, never inside a character."""
    if len(raw) <= ROLL:
        return np.zeros(0, np.int64)
    h, span, factor = (raw.astype(np.uint32) + 1) * np.uint32(0x9E3779B1), 1, np.uint32(0x01000193)
    while span < ROLL:  # h[i] covers the span bytes up to i
        h[span:] = h[span:] + h[:-span] * factor
        factor, span = np.uint32(int(factor) ** 2 & 0xFFFFFFFF), span * 2
    at = np.flatnonzero((h[:-1] >> np.uint32(32 - CUT_BITS)) == 0) + 1
    return at[(raw[at] & 0xC0) != 0x80]


def chunk_ends(places: np.ndarray, begin: int, end: int) -> list[int]:
    """The ends of the chunks of the text in raw[begin:end]."""
    out, last = [], begin
    for p in places[np.searchsorted(places, begin + LEAST_CHUNK) : np.searchsorted(places, end - LEAST_CHUNK, side="right")].tolist():
        if p - last >= LEAST_CHUNK:
            out.append(p)
            last = p
    return [*out, end]


def texts_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins."""
    col = batch.column(name)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks_of(batch: pa.RecordBatch, name: str, added: list[bytes]) -> Iterator[tuple[int, bytes, list[int]]]:
    """Each text's row, bytes and chunk ends (one chunk if it holds an added token)."""
    raw, offs = texts_of(batch, name)
    places, data = cut_places(raw), raw.tobytes()
    for i, (a, b) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
        text = data[a:b]
        if any(s in text for s in added):
            yield i, text, [len(text)]
        else:
            yield i, text, [e - a for e in chunk_ends(places, a, b)]


def added_strings(path: str) -> list[bytes]:
    return [s.encode() for s in added_tokens(path)]


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Places of spaces behind a character that is not white space."""
    at = np.flatnonzero(raw == 32)
    at = at[at > 0]
    at = at[~np.isin(raw[at - 1], np.frombuffer(WHITE_BYTES, np.uint8))]
    beyond = np.flatnonzero(raw[at - 1] >= 0x80)
    if len(beyond):
        end = at[beyond]
        two = raw[end - 2].astype(np.uint32) << 8 | raw[end - 1]
        three = raw[np.maximum(end - 3, 0)].astype(np.uint32) << 16 | two
        white = np.isin(two, [int.from_bytes(w) for w in WHITE_PAIRS]) | np.isin(three, [int.from_bytes(w) for w in WHITE_TRIPLES])
        at = np.delete(at, beyond[white])
    return at


def chunk_table(docs: DataFrame, path: str) -> DataFrame:
    """th (the name of a text) and the hashes of its chunks, for each row of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = added_strings(path)
        for b in slices(batches, "text", OPENED_BYTES):
            hashes, begins, names = [], [0], []
            for _, text, ends in chunks_of(b, "text", added):
                names.append(xxhash.xxh3_128_digest(text))
                hashes += [xxhash.xxh3_128_digest(text[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
                begins.append(len(hashes))
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(hashes, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), lists], names=["th", "hashes"])

    return docs.select("text").mapInArrow(lambda it: returning_memory(run(it)), "th binary, hashes array<binary>")


def squeezed(docs: DataFrame) -> DataFrame:
    """key, th and the compressed text z of docs (key, text), for the shuffle: a third less than its own compression leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            cols = [pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([packer.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("key"), *cols], names=["key", "th", "z"])

    # Not null, so that both joins see the same rows and share one shuffle.
    schema = T.StructType([docs.schema["key"], *(T.StructField(n, T.BinaryType(), False) for n in ("th", "z"))])
    return docs.select("key", "text").mapInArrow(lambda it: returning_memory(run(it)), schema)


def opened(batches: Iterator[pa.RecordBatch], limit: int = OPENED_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with the compressed column z as text again, cut so that their texts have about ``limit`` bytes."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, begin, held = [], 0, 0
        for i, z in enumerate(batch.column("z").to_pylist()):
            size = zstandard.frame_content_size(z)
            if texts and held + size > limit:
                yield batch.slice(begin, i - begin).append_column("text", pa.array(texts, pa.binary()).cast(pa.string()))
                texts, begin, held = [], i, 0
            texts.append(opener.decompress(z) if size else b"")
            held += size
        if texts:
            yield batch.slice(begin).append_column("text", pa.array(texts, pa.binary()).cast(pa.string()))


class Chunk:
    """A shared chunk in a text: raw[x:y], its ids, where its tokens end, and its safe places.

    Of its ids, those between its places ``p`` and, counted from the end, ``q`` are taken; what lies before and behind
    is in the windows of its joints. -1: no window reaches into that side, as the text begins or ends there.
    """

    __slots__ = ("ends", "ids", "p", "places", "q", "x", "y")

    def __init__(self, x: int, y: int, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, first: bool, last: bool):
        self.x, self.y, self.ids, self.places = x, y, ids, places
        self.ends = np.concatenate([[0], np.cumsum(sizes[ids])]) + x
        self.p, self.q = -1 if first else 1, -1 if last else 1

    def usable(self) -> bool:
        return self.ends[-1] == self.y and max(self.p, 0) + max(self.q, 0) < max(1, len(self.places))

    def begin(self) -> int:
        return self.x if self.p < 0 else int(self.places[self.p])

    def end(self) -> int:
        return self.y if self.q < 0 else int(self.places[len(self.places) - 1 - self.q])

    def between(self, begin: int, end: int) -> np.ndarray | None:
        """The ids of raw[begin:end]; None if tokens do not end at both."""
        i, j = np.searchsorted(self.ends, (begin, end))
        return self.ids[i:j] if self.ends[i] == begin and self.ends[j] == end else None


def agree(window: np.ndarray, sizes: np.ndarray, own: np.ndarray | None, bytes_: int, at_end: bool) -> bool:
    """Whether the window's first (or last) ``bytes_`` bytes have the ids ``own``."""
    if own is None or len(own) > len(window):
        return False
    part = window[len(window) - len(own) :] if at_end else window[: len(own)]
    return bool((part == own).all()) and int(sizes[part].sum()) == bytes_


class Text:
    """raw[begin:end], its shared chunks in order, and the repaired windows between them by their places."""

    def __init__(self, begin: int, end: int, chunks: list[Chunk]):
        self.begin, self.end, self.windows = begin, end, {}
        self.chunks = [c for c in chunks if c.usable()]

    def joints(self) -> list[tuple[Chunk | None, Chunk | None, int, int]]:
        sides = [None, *self.chunks, None]
        return [(a, b, a.end() if a else self.begin, b.begin() if b else self.end) for a, b in zip(sides, sides[1:], strict=False)]

    def open(self) -> list[tuple[int, int]]:
        """Windows still to be encoded."""
        return [(x, y) for _, _, x, y in self.joints() if x < y and (x, y) not in self.windows]

    def repair(self, found: dict[tuple[int, int], np.ndarray], sizes: np.ndarray) -> None:
        """Keeps the windows that agree with both sides; widens the others."""
        for a, b, x, y in self.joints():
            if (x, y) not in found:
                continue
            ids, fine = found[x, y], True
            if a and a.q >= 0:
                margin = int(a.places[len(a.places) - a.q])
                if not agree(ids, sizes, a.between(x, margin), margin - x, False):
                    a.q, fine = 2 * a.q, False
            if b and b.p >= 0:
                margin = int(b.places[b.p - 1])
                if not agree(ids, sizes, b.between(margin, y), y - margin, True):
                    b.p, fine = 2 * b.p, False
            if fine:
                self.windows[x, y] = ids
        self.chunks = [c for c in self.chunks if c.usable()]

    def ids(self) -> np.ndarray:
        out = []
        for _, b, x, y in self.joints():
            if x < y:
                out.append(self.windows[x, y])
            if b:
                out.append(b.between(b.begin(), b.end()))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def joined(data: bytes, texts: list[Text], bpe: ColumnBPE, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of each text, all joints repaired; windows are encoded together, equal ones once."""
    left = texts
    while left:
        asked = [(t, w) for t in left for w in t.open()]
        bodies = {data[x:y]: None for _, (x, y) in asked}
        ids, offs = bpe.encode(pa.array(list(bodies), pa.binary()).cast(pa.string()))
        for k, body in enumerate(bodies):
            bodies[body] = ids[offs[k] : offs[k + 1]]
        for t in left:
            t.repair({w: bodies[data[w[0] : w[1]]] for w in t.open()}, sizes)
        left = [t for t in left if t.open()]
    # A chunk whose tokens don't end at its safe places has been widened away by now.
    return [t.ids() for t in texts]


def assembled(batches: Iterator[pa.RecordBatch], path: str, decode: bool) -> Iterator[pa.RecordBatch]:
    """key, ids and, to ``decode``, the text these decode to for rows of (key, th, z, parts: array of (seq, ids))."""
    bpe, added, sizes = column_bpe(path), added_strings(path), token_sizes(path)
    width = "<u2" if bpe.size <= 1 << 16 else "<u4"
    for b in opened(batches):
        seen: dict[bytes, int] = {}
        of = [seen.setdefault(th, len(seen)) for th in b.column("th").to_pylist()]
        once = b if len(seen) == len(of) else b.take(pa.array(np.unique(of, return_index=True)[1]))
        raw, offs = texts_of(once, "text")
        data, safe, parts, texts = raw.tobytes(), safe_places(raw), once.column("parts").to_pylist(), []
        for i, text, ends in chunks_of(once, "text", added):
            begin, chunks = int(offs[i]), []
            for part in sorted(parts[i] or (), key=lambda p: p["seq"]):
                k = part["seq"]
                if chunks and chunks[-1].y > begin + (ends[k - 1] if k else 0):
                    continue  # the same chunk twice
                x, y = begin + (ends[k - 1] if k else 0), begin + ends[k]
                lo, hi = np.searchsorted(safe, (x + 1, y))
                chunks.append(Chunk(x, y, np.frombuffer(part["ids"], width).astype(np.uint32), sizes, safe[lo:hi], k == 0, y == begin + len(text)))
            texts.append(Text(begin, begin + len(text), chunks))
        found = [ids.astype("<u4").tobytes() for ids in joined(data, texts, bpe, sizes)]
        ids = pa.array(found, pa.binary()).take(pa.array(of, pa.int64()))
        back = [pa.array(decoded(pa.array(found, pa.binary()), path), pa.string()).take(pa.array(of, pa.int64()))] if decode else []
        yield pa.RecordBatch.from_arrays([b.column("key"), ids, *back], names=["key", "ids", "text"][: 2 + decode])


def encoded_chunks(first: DataFrame, path: str) -> DataFrame:
    """hash and ids of the chunks that rows of (key, th, z, wanted: array of (seq, hash)) own, each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, added, last = column_bpe(path), added_strings(path), None
        for b in opened(batches):
            names, wanted, texts, hashes = b.column("th").to_pylist(), b.column("wanted").to_pylist(), [], []
            for i, text, ends in chunks_of(b, "text", added):
                if names[i] == last:
                    continue  # equal texts lie next to one another
                last, begins = names[i], [0, *ends]
                for w in wanted[i]:
                    texts.append(text[begins[w["seq"]] : ends[w["seq"]]].decode())
                    hashes.append(w["hash"])
            ids, offs = bpe.encode(pa.array(texts, pa.string()))
            ids = ids.astype("<u2" if bpe.size <= 1 << 16 else "<u4")
            raw = [ids[x:y].tobytes() for x, y in zip(offs, offs[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(raw, pa.binary())], names=["hash", "ids"])

    return first.select("key", "th", "z", "wanted").mapInArrow(lambda it: returning_memory(run(it)), "hash binary, ids binary")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """key and ids (little-endian unsigned 32-bit integers) of each row of ``docs``, and with ``decode`` the decoded text.

    Texts are shuffled once, compressed; of chunks only hashes are counted, and ids travel for shared chunks alone.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Written first: the texts' workers need the room that an aggregate in the same task would take.
    table = written(written(chunk_table(docs, path)).groupBy("th").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes")))
    rows, chunks = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    each = table.select("th", F.posexplode("hashes").alias("seq", "hash"))
    shared = each.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("th", "seq")).alias("o")).where("n > 1")
    shared = written(shared.select("hash", "n", F.col("o.th").alias("th"), F.col("o.seq").alias("seq")))
    owners = shared.groupBy("th").agg(F.collect_list(F.struct("seq", "hash")).alias("wanted"))
    owners = owners.withColumn("salt", F.pmod(F.size("wanted"), F.lit(1)))  # 0, but no literal: both joins are to share a shuffle
    hot_texts, hot_chunks = salts_of(table, "th", rows), salts_of(shared, "hash", chunks)
    kind = dict(docs.dtypes)["key"]

    docs = salted(squeezed(docs), hot_texts, "th", F.monotonically_increasing_id())
    first = docs.join(owners, ["th", "salt"]).select("key", "th", "z", "wanted")  # the key too: the same columns share a shuffle
    chunk_ids = for_salts(encoded_chunks(first, path), hot_chunks, "hash")
    meet = salted(each, hot_chunks, "hash", F.xxhash64("th", "seq")).join(chunk_ids, ["hash", "salt"])
    parts = for_salts(meet.groupBy("th").agg(F.collect_list(F.struct("seq", "ids")).alias("parts")), hot_texts, "th")
    whole = docs.join(parts, ["th", "salt"], "left").select("key", "th", "z", "parts")
    return whole.mapInArrow(lambda it: returning_memory(assembled(it, path, decode)), f"key {kind}, ids binary" + ", text string" * decode).withColumnRenamed("key", key)


def decode(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``coded`` (key, ids) with the decoded text, as the library decodes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded(b.column(1), path))], names=[key, "ids", "text"])

    return coded.select(key, "ids").mapInArrow(run, f"`{key}` {dict(coded.dtypes)[key]}, ids binary, text string")


def decoded(ids: pa.Array, path: str) -> list[str]:
    table, out = decoder(path), []
    for raw in ids.to_pylist():
        found = table.take(pa.array(np.frombuffer(raw, "<u4")))
        offs = np.frombuffer(found.buffers()[1], np.int64)
        data = found.buffers()[2]
        out.append(bytes(memoryview(data)[offs[0] : offs[len(found)]]).decode("utf-8", "replace") if len(found) else "")
    return out


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens and the SHA-256 of ids and of the text of ``coded`` (key, ids, text)."""
    return coded.select(key, F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
