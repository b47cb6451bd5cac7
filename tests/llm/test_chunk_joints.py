"""Chunked encoding (6): repeated rows, chunks encoded once, and joints repaired until they agree."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from conftest import prose
from test_tokens import BYTE, ids_of, library, raw

from tagflow.llm import bpe_chunks, common
from tagflow.llm.tokens import column_bpe, token_sizes


def test_repeated_rows_take_linear_time(spark):
    """Rows equal in id and text, rows without an id, and copies under ids of their own."""
    rng = random.Random(12)
    long = prose(rng, 4000)
    rows = [(1, long)] * 1500 + [(None, long)] * 1500 + [(10 + i, long) for i in range(1500)] + [(5000, prose(rng, 300) + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    began = time.time()
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in bpe_chunks.encode(df, BYTE).collect())
    assert time.time() - began < 60
    assert got == Counter({(k, raw(ids_of(BYTE, t))): n for (k, t), n in Counter(rows).items()})


def test_hot_texts_and_chunks_are_dealt_over_salts(spark, monkeypatch, docs, rows):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in bpe_chunks.encode(docs, BYTE).collect())
    assert got == Counter((r[0], raw(ids_of(BYTE, r[1]))) for r in rows)


def test_a_shared_chunk_is_encoded_once(spark, monkeypatch):
    rng = random.Random(13)
    passage = prose(rng, 2000)
    rows = [(i, prose(rng, 50) + " " + passage + " " + prose(rng, 50)) for i in range(20)] + [(i % 3, passage) for i in range(40)]
    kept = []
    whole = bpe_chunks.encoded_chunks
    monkeypatch.setattr(bpe_chunks, "encoded_chunks", lambda *a: kept.append(whole(*a)) or kept[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bpe_chunks.encode(df, BYTE).collect()
    hashes = [bytes(r["hash"]) for r in kept[0].collect()]
    assert len(hashes) == len(set(hashes)) > 10


def pieces(text, cuts):
    """The text with its parts between ``cuts`` as shared chunks."""
    data, sizes = text.encode(), token_sizes(BYTE)
    safe, chunks = bpe_chunks.safe_places(np.frombuffer(data, np.uint8)), []
    for x, y in zip(cuts, cuts[1:], strict=False):
        ids = np.array(ids_of(BYTE, data[x:y].decode("utf-8", "ignore")), np.uint32)
        lo, hi = np.searchsorted(safe, (x + 1, y))
        chunks.append(bpe_chunks.Chunk(x, y, ids, sizes, safe[lo:hi], x == 0, y == len(data)))
    return data, sizes, chunks


@pytest.mark.parametrize("seed", range(20))
def test_joints_anywhere_give_the_ids_of_the_whole(seed):
    rng = random.Random(seed)
    text = prose(rng, 300) + rng.choice(["", "  \n\n ", "日本語 テキスト", "'s it's  "]) + prose(rng, 200)
    at = sorted(rng.sample(range(1, len(text)), 8))
    cuts = [0, *(len(text[:k].encode()) for k in at), len(text.encode())]
    data, sizes, chunks = pieces(text, cuts)
    chunks = [c for c in chunks if rng.random() < 0.8]
    got = bpe_chunks.joined(data, [bpe_chunks.Text(0, len(data), chunks)], column_bpe(BYTE), sizes)[0]
    assert got.tolist() == ids_of(BYTE, text)


def test_windows_widen_until_both_sides_agree(monkeypatch):
    """Chunks whose ids near their ends are not those of the text: single bytes in place of words."""
    text = prose(random.Random(14), 400)
    data, sizes, chunks = pieces(text, [0, 900, 1800, len(text)])
    bpe = column_bpe(BYTE)
    single = {bytes(memoryview(t)): i for i, t in enumerate(bpe_chunks.decoder(BYTE).to_pylist()) if len(t) == 1}
    middle = chunks[1]
    near, far = (int(middle.places[k]) for k in (9, -10))  # up to and from here, bytes
    kept = [i for i, e in zip(middle.ids, middle.ends, strict=False) if near <= e < far]
    ids = [single[data[k : k + 1]] for k in range(900, near)] + kept + [single[data[k : k + 1]] for k in range(far, 1800)]
    bad = bpe_chunks.Chunk(900, 1800, np.array(ids, np.uint32), sizes, middle.places, False, False)
    whole = bpe_chunks.Text(0, len(data), [chunks[0], bad, chunks[2]])
    got = bpe_chunks.joined(data, [whole], bpe, sizes)[0]
    assert got.tolist() == ids_of(BYTE, text)
    assert bad in whole.chunks and bad.p == 16 and bad.q == 16  # widened 1, 2, 4, 8, 16 places, the rest kept
    wrong = bpe_chunks.Chunk(900, 1800, np.array([single[data[k : k + 1]] for k in range(900, 1800)], np.uint32), sizes, middle.places, False, False)
    whole = bpe_chunks.Text(0, len(data), [chunks[0], wrong, chunks[2]])
    assert bpe_chunks.joined(data, [whole], bpe, sizes)[0].tolist() == ids_of(BYTE, text)
    assert wrong not in whole.chunks  # widened over the whole chunk


def test_safe_places_are_those_of_the_characters():
    text = "a b  c\n d\x1c e\x85 f\xa0 g  h  i  j  k　 lé m文 n\U0001f642 o  "
    at, offset, want = bpe_chunks.safe_places(np.frombuffer(text.encode(), np.uint8)), 0, []
    for k, c in enumerate(text):
        if c == " " and k and not text[k - 1].isspace():
            want.append(offset)
        offset += len(c.encode())
    assert at.tolist() == want
    assert library(BYTE).decode(ids_of(BYTE, text)) == text
    assert bpe_chunks.safe_places(np.frombuffer(b" \xc3\xa9 ", np.uint8)).tolist() == [3]
