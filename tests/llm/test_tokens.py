"""Token operators (2, 6, 8) against the tokenizers library itself."""

import hashlib
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagflow.llm import bpe_chunks, packing, queries, rans
from tagflow.llm.tokens import ColumnBPE

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@cache
def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def column(path):
    return ColumnBPE(path)


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


TEXT = st.one_of(st.text(max_size=40), st.text(alphabet=" \t\n\r'aAbsé1.,İ \x00\x1c日", max_size=40), st.lists(st.sampled_from(["it's", " ", "  ", "\n", "the", "THE", "<|endoftext|>", "don't", "12", "é", "…", " "]), max_size=12).map("".join))


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_columns_are_encoded_as_by_the_library(path, texts):
    ids, offs = column(path).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == [ids_of(path, t) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_letter_of_the_first_blocks(path):
    texts = [form.replace("{}", chr(c)) for c in range(0x2100) for form in ("{}", "a{}b", "A {} 1{}2 '{}s")]
    ids, offs = column(path).encode(pa.array(texts, pa.string()))
    want = library(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == [w.ids for w in want]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_range_coding_returns_the_ids_in_order(spark, docs, rows, tmp_path):
    rans.write_ids(docs, f"{tmp_path}/ids", WORD, end_id=1)
    found = [tuple(r) for r in rans.read_ids(spark, f"{tmp_path}/ids", ColumnBPE(WORD).size).collect()]
    assert Counter((k, n, bytes(i)) for k, _, n, i in found) == Counter((r[0], len(e), raw(e)) for r in rows for e in [[*ids_of(WORD, r[1]), 1]])
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == [r[0] for r in order(rows)]
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1]]


def test_range_coding_of_nothing(spark, nothing, tmp_path):
    rans.write_ids(nothing, f"{tmp_path}/ids", WORD, end_id=1)
    assert rans.read_ids(spark, f"{tmp_path}/ids", ColumnBPE(WORD).size).count() == 0


@settings(max_examples=40, deadline=None)
@given(n=st.integers(0, 3000), size=st.integers(1, 300), lanes=st.sampled_from([1, 4, 32]), every=st.sampled_from([1, 3, 128]), seed=st.integers(0, 9))
def test_blocks_decode_from_any_checkpoint(n, size, lanes, every, seed):
    ids = (np.random.default_rng(seed).zipf(1.3, n) % size).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    coder = rans.Coder(rans.scaled(seen, counts.astype(float), size))
    block = coder.encode(ids, lanes, every)
    assert (coder.decode(block) == ids).all()
    used = rans.HEAD.unpack_from(block)[2]
    parts = list(rans.parts_of(block))
    assert len(parts) == -(-(-(-n // used)) // every)
    for k, part in enumerate(parts):
        assert (coder.decode_part(part) == ids[k * every * used : (k + 1) * every * used]).all()
    if n:
        broken = bytearray(block)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            coder.decode(bytes(broken))


def test_a_damaged_part_is_found_and_spoils_no_other():
    ids = (np.random.default_rng(1).zipf(1.3, 5000) % 200).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    coder = rans.Coder(rans.scaled(seen, counts.astype(float), 200))
    parts = list(rans.parts_of(coder.encode(ids, 8, 64)))
    for at in (rans.PART.size - 1, rans.PART.size + 3, len(parts[3]) - 2):
        broken = bytearray(parts[3])
        broken[at] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            coder.decode_part(bytes(broken))
    assert (np.concatenate([coder.decode_part(p) for p in parts]) == ids).all()


def test_long_documents_are_decoded_by_parts(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 1000)
    monkeypatch.setattr(rans, "LANES", 16)
    monkeypatch.setattr(rans, "CHECKPOINT_ROWS", 8)
    rans.write_ids(docs, f"{tmp_path}/ids", WORD, end_id=1)
    stored = spark.read.parquet(f"{tmp_path}/ids/blocks")
    assert stored.where("NOT long").count() > 5
    assert all(len(list(rans.parts_of(r["payload"]))) > 10 for r in stored.where("long").collect())
    found = [tuple(r) for r in rans.read_ids(spark, f"{tmp_path}/ids", ColumnBPE(WORD).size).collect()]
    assert Counter((k, n, bytes(i)) for k, _, n, i in found) == Counter((r[0], len(e), raw(e)) for r in rows for e in [[*ids_of(WORD, r[1]), 1]])


def test_op2_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    start = 0
    got = sorted(queries.op2_rans_tokens(spark, sf_dir).collect())
    assert [r["doc_id"] for r in got] == sorted(docs)
    for r in got:
        ids = [*ids_of(WORD, docs[r["doc_id"]]), 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)


def test_chunked_encoding_is_exact(docs, rows):
    coded = bpe_chunks.encode(docs, BYTE)
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in coded.collect())
    assert got == Counter((r[0], raw(ids_of(BYTE, r[1]))) for r in rows)
    back = Counter((r["doc_id"], r["text"]) for r in bpe_chunks.decode(coded, BYTE).collect())
    both = Counter((r["doc_id"], r["text"]) for r in bpe_chunks.encode(docs, BYTE, decode=True).collect())
    assert back == both == Counter((r[0], library(BYTE).decode(ids_of(BYTE, r[1]), skip_special_tokens=False)) for r in rows)


def test_chunks_are_shared_and_cut_by_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 20_000).astype(np.uint8)
    cuts = [bpe_chunks.cut_places(np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared])) - n for n in (100, 1777)]
    inside = [set(c[c > bpe_chunks.ROLL].tolist()) for c in cuts]
    assert inside[0] == inside[1] and len(inside[0]) > 10


def test_chunked_encoding_of_nothing(nothing):
    assert bpe_chunks.digests(bpe_chunks.encode(nothing, BYTE, decode=True)).count() == 0


def test_op6_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op6_chunked_bpe(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        ids = ids_of(BYTE, docs[r["doc_id"]])
        text = library(BYTE).decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def check_packing(found, rows):
    """Every id lies in one piece, pieces fill sequences without gaps."""
    by_sequence, per_row = defaultdict(list), Counter()
    ids = {}
    for r in rows:
        e = [*ids_of(BYTE, r[1]), 1]
        ids.setdefault((r[0], len(e)), []).append(e)
        for at in range(0, len(e), packing.WINDOW):
            piece = e[at : at + packing.WINDOW]
            per_row[(r[0], at, len(piece), zlib.crc32(raw(piece)), len(e))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == per_row
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
        padding += 0 if end & (end - 1) == 0 else packing.WINDOW - end
    return padding / sum(r["length"] for r in found)


def test_packing(docs, rows):
    check_packing(queries.packed(docs).collect(), rows)


def test_packing_of_nothing(nothing):
    assert queries.packed(nothing).count() == 0


def test_op8_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check_packing(queries.op8_nnls_packing(spark, sf_dir).collect(), docs) < 0.05


def exact_nnls(a, h):
    """Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        w = a.T @ (h - a @ x)
        w[passive] = -np.inf
        if not len(w) or w.max() < 1e-8:
            return x
        passive[w.argmax()] = True
        while True:
            s = np.zeros(len(x))
            s[passive] = np.linalg.lstsq(a[:, passive], h, rcond=None)[0]
            if s[passive].min() > 0:
                break
            low = passive & (s <= 0)
            x = x + (x[low] / (x[low] - s[low])).min() * (s - x)
            passive &= x > 1e-12
        x = s


@pytest.mark.parametrize("seed", range(6))
def test_the_solver_comes_near_exact_least_squares(seed):
    rng = np.random.default_rng(seed)
    window = 48
    hist = np.zeros(window + 1, np.int64)
    hist[1:] = rng.integers(0, 30, window) * (rng.random(window) < 0.7)
    combos = packing.combinations(hist, window, lone=window)
    brute = {tuple(sorted(c, reverse=True)) for a in range(1, window + 1) for b in range(window + 1) for c in [(a, b, window - a - b)] if 0 <= c[2] and all(x == 0 or hist[x] for x in c)}
    assert sorted(map(tuple, combos.tolist())) == sorted(brute)
    a = np.zeros((window + 1, len(combos)))
    for j, c in enumerate(combos):
        for x in c[c > 0]:
            a[x, j] += 1
    miss = lambda x: np.linalg.norm(a @ x - hist)
    found, least = packing.solve(combos, hist, 400), exact_nnls(a, hist.astype(float))
    assert (found >= 0).all() and miss(least) - 1e-6 <= miss(found) <= 1.01 * miss(least) + 0.05


def test_most_windows_come_from_the_solution():
    """Of lengths as documents have them; the plan comes near the ideal, and does not give small pieces windows alone."""
    rng = np.random.default_rng(7)
    sizes = rng.lognormal(6.5, 1, 30_000).astype(int) + 1
    hist = np.bincount(sizes % 2048, minlength=2049)
    hist[0], hist[2048] = 0, (sizes // 2048).sum()
    plan, solution = packing.templates(hist), packing.solved(hist)
    count = lambda windows: sum(n for _, n in windows)
    ideal = (hist * np.arange(2049)).sum() / 2048
    assert count(plan) <= 1.002 * ideal + 2 and count(solution) > 0.8 * count(plan)
    assert len(solution) <= packing.MOST_USED + 1 and not any(len(w) == 1 and w[0] < 1024 for w, _ in solution)


def test_solver_reproduces_a_histogram_that_combinations_fill():
    hist = np.zeros(2049, np.int64)
    for a, b, c, n in ((1000, 1048, 0, 30), (700, 700, 648, 20), (1500, 300, 248, 50)):
        for x in (a, b, c):
            hist[x] += n if x else 0
    plan = packing.templates(hist)
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 2048
        for a in lengths:
            used[a] += n
    assert all(used[a] == hist[a] for a in range(2049))
    assert sum(n for _, n in plan) <= 103


def test_pieces_too_long_for_a_window_are_refused(spark):
    with pytest.raises(ValueError, match="doesn't fit"):
        packing.pack(spark.createDataFrame([(1, 3000)], "id long, length long"))
    assert packing.pack(spark.createDataFrame([(1, 5, "x")], "id long, length long, _length string").drop("_length").withColumn("extra", F.lit(1))).count() == 1
