"""Near-duplicate texts (a stage of the pipeline) against all pairs."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import prose

from tagflow.llm import near_texts


def pairs_of(texts, words=5, least=0.8):
    """Index pairs of texts at least as similar, by all pairs."""
    sets = []
    for t in texts:
        w = [x.lower() for x in (t or "").split()]
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9}


def least_ids(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs_of(texts):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    base = [prose(rng, n) for n in (60, 120, 300)]
    out = [*base, None, "", " \n", "one two", "One  two", "two one"]
    for t in base:
        for changes in (1, 1, 2, 2, 4, 8):
            w = t.split()
            for p in rng.sample(range(len(w)), changes):
                w[p] = f"changed{rng.randrange(1000)}"
            out.append(" ".join(w))
    return out


def test_components_are_those_of_all_pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component"] for r in near_texts.near_duplicates(df).collect()}
    assert got == dict(enumerate(least_ids(texts)))


def test_the_stage_links_five_word_shingles_at_four_fifths(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(set(least_ids(texts)))


@pytest.mark.parametrize("block", [4, 1024])
def test_large_groups(spark, monkeypatch, block):
    """Also where bands are dealt to pairs of blocks, and where few partners of a node are compared before all others."""
    monkeypatch.setattr("tagflow.llm.simhash.BLOCK", block)
    monkeypatch.setattr(near_texts, "NEAREST", 1)
    rng = random.Random(9)
    t = prose(rng, 200).split()
    texts = []
    for _ in range(60):
        w = list(t)
        for p in rng.sample(range(len(w)), rng.randint(0, 6)):
            w[p] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in near_texts.near_duplicates(df).collect()}
    assert got == dict(enumerate(least_ids(texts)))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    a = np.ones(near_texts.BANDS * near_texts.ROWS, np.uint64)
    for n in (1, 5, 50, 500, 5000):
        x = rng.integers(0, 1 << 64, n, np.uint64)
        y = np.concatenate([x[n // 5 :], rng.integers(0, 1 << 64, n // 7, np.uint64)])
        s, t = (near_texts.signature(np.unique(v), a, a)[0] for v in (x, y))
        w = min(len(s), len(t))
        apart = np.bitwise_count(near_texts.folded([s], w) ^ near_texts.folded([t], w)).sum()
        assert len(np.setxor1d(x, y)) / 2 < apart + 1 and apart <= len(np.setxor1d(x, y))


def test_a_chain_that_no_pivot_joins(spark):
    """Each text is like its neighbours only; families that are just too far apart stay apart."""
    rng = random.Random(15)
    words, texts = prose(rng, 150).split(), []
    for k in range(40):
        words = list(words)
        words[rng.randrange(len(words))] = f"step{k}"
        texts.append(" ".join(words))
    other = prose(rng, 150).split()
    for far in (3, 5, 6, 7, 8, 9):
        for _ in range(6):
            w = list(other)
            for p in rng.sample(range(len(w)), far):
                w[p] = f"far{far}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component"] for r in near_texts.near_duplicates(df).collect()}
    assert got == dict(enumerate(least_ids(texts)))


def test_an_id_of_two_texts_keeps_both(spark):
    """Once for each component; equal rows once; a copy under a larger id does not stay in its stead."""
    rng = random.Random(10)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, a), (None, a)]
    got = near_texts.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, a), (1, b), (None, a), (None, a)])
