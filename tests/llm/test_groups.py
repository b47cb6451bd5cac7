"""Sharding (4), SimHash (7), nearest neighbours (9), HTML (3) and chats (10) against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagflow.llm import chat, components, html_text, queries, rabitq, sharding, simhash

# Sharding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(60, 120))
def test_best_fit_takes_the_tightest_bin(sizes, capacity):
    sizes.sort(reverse=True)
    bins, expected = [], []
    for s in sizes:
        fits = [(left, k) for k, left in enumerate(bins) if left >= s]
        if not fits:
            bins.append(capacity)
            fits = [(capacity, len(bins) - 1)]
        k = min(fits)[1]
        bins[k] -= s
        expected.append(k)
    runs = sharding.best_fit(sorted(Counter(sizes).items(), reverse=True), capacity)
    got = [k for k, n in runs for _ in range(n)]
    load = lambda places: Counter(v for v in Counter({k: sum(s for s, p in zip(sizes, places, strict=True) if p == k) for k in set(places)}).values())
    assert load(got) == load(expected)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), unique=True, max_size=50))
def test_balanced_tree(keys):
    tree, held = sharding.BalancedTree(), []
    for k in keys:
        tree.insert(k)
        held.append(k)
        if len(held) % 3 == 0:
            tree.remove(held.pop(len(held) // 2))
        for size in (0, 10, 51):
            assert tree.tightest(size) == min((x for x in held if x[0] >= size), default=None)


def check_shards(found, rows, shards):
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, of_group, load = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        of_group[(r["size"], r["text_crc32"])].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_group.values())
    return load


def test_shards(docs, rows):
    check_shards(sharding.shard_by_size(docs, 5).collect(), rows, 5)


def test_more_shards_than_groups_and_nothing(spark, nothing):
    few = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    check_shards(sharding.shard_by_size(few, 24).collect(), [(1, "a"), (2, "a"), (3, None)], 24)
    assert sharding.shard_by_size(nothing, 24).count() == 0


def test_op4_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    load = check_shards(queries.op4_best_fit_shards(spark, sf).collect(), docs, 24)
    mean = sum(load.values()) / 24
    assert max(load.values()) < 1.01 * mean and min(load.values()) > 0.99 * mean


# SimHash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows):
    """doc id -> (fingerprint, smallest id reachable), by all pairs."""
    fps = [fingerprint(r[1]) for r in rows]
    a = np.array(fps, np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4).tolist():
            root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))


def shown(df):
    return Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component"]) for r in df.collect())


def test_near_duplicates(docs, rows):
    assert shown(simhash.near_duplicates(docs)) == grouped(rows)


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_op7_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_pigeonring(spark, sf_dir).collect())
    assert got == grouped(docs)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, block):
    """Also where buckets are dealt to pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(100)}
    base = rng.getrandbits(64)
    for _ in range(80):
        x = base
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        fps.add(x)
    a = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    found = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    parent = {int(x): int(x) for x in a.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for x, y in found:
        parent[find(x)] = find(y)
    for i, x in enumerate(a):
        for y in a[i + 1 :]:
            if int(x ^ y).bit_count() <= 4:
                assert find(int(np.uint64(x).view(np.int64))) == find(int(np.uint64(y).view(np.int64))), (int(x) & mask, int(y) & mask)


def test_dealing_meets_every_pair_within_the_budget():
    """Each pair of at most four bits shares a bucket in which one of the two is by its own bits."""
    rng = random.Random(6)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 4)):
            y ^= 1 << b
        seg, val, cleared, at = simhash.dealt_rows(np.array([x, y], np.uint64))
        of = [{(s, v): c for s, v, c, k in zip(seg.tolist(), val.tolist(), cleared.tolist(), at.tolist(), strict=True) if k == i} for i in (0, 1)]
        met = [s for (s, v), c in of[0].items() if (s, v) in of[1] and not (c and of[1][s, v])]
        assert any(len(simhash.chained(np.array([s]), np.array([x ^ y], np.uint64))) for s in met)
        far = y ^ sum(1 << b for b in rng.sample(range(64), 8))
        assert (int(x ^ far).bit_count() <= 4) == any(len(simhash.chained(np.array([s]), np.array([x ^ far], np.uint64))) for s in range(5))


def test_pairs_within_cells():
    begins, ends = np.array([0, 3, 4, 4]), np.array([3, 4, 4, 9])
    want = [(i, j) for a, b in zip(begins, ends, strict=True) for i in range(a, b) for j in range(i + 1, b)]
    for most in (1, 3, 100):
        got = [(int(i), int(j)) for x, y in simhash.within_cells(begins, ends, most) for i, j in zip(x, y, strict=True)]
        assert got == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 201)} | {500: 400}


# Nearest neighbours


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            out[q] = sorted(((-float((v * w).sum()), i) for i, w in good if i != q))[:k]
    return out


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).astype(np.float32).astype(float).tolist()) for i in range(60)]
    rows += [(60, None), (61, [0.0] * 16), (62, [1.0] * 15 + [float("nan")]), (63, [float("inf")] * 16), (64, [None] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(70 + i, rows[3][1]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "v", "rank", "score", "block")})
    got = defaultdict(list)
    for r in rabitq.nearest(table, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        near = {i: -s for s, i in best}
        assert len(near.keys() & {i for _, i, _ in got[q]}) >= 18
        for _, i, s in got[q]:
            assert i not in near or abs(s - near[i]) < 1e-9


def test_fewer_candidates_than_asked_and_nothing(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 0.5]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in rabitq.nearest(few, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 5.0), (0, 2, 1, 4.0)]
    assert rabitq.nearest(few.where("vec_id > 9"), F.col("vec_id") == 0, 20).count() == 0


def test_rows_of_one_query_id_are_one_query(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1, 40)] + [(0, [1.0] + [0.0] * 7), (0, [0.5] + [0.0] * 7), (0, [0.5] + [0.0] * 7)]
    got = [tuple(r) for r in rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    want = sorted((-0.5 * v[0], i) for i, v in rows if i)[:20]
    assert [r[:3] for r in got] == [(0, k + 1, i) for k, (_, i) in enumerate(want)]


@pytest.mark.parametrize("dim", [5, 64, 100, 200])
def test_estimates_count_bits(dim):
    """The packed estimate is that of the rounded query with the signs; its bound holds but for a few."""
    rng = np.random.default_rng(dim)
    v, q, turn = rng.standard_normal((2000, dim)), rng.standard_normal((20, dim)), rabitq.rotation(dim)
    bits, norms, fit = rabitq.encode(v, turn)
    units = q / np.linalg.norm(q, axis=1)[:, None]
    asked = rabitq.Query(units, turn)
    got = asked.estimates(bits, np.bitwise_count(bits).sum(axis=1), slice(0, 20))
    turned = units @ turn.T
    rounded = asked.low[:, None] + asked.step[:, None] * np.rint((turned - asked.low[:, None]) / asked.step[:, None])
    signs = np.where((v / norms[:, None]) @ turn.T > 0, 1, -1)
    assert np.allclose(got, rounded @ signs.T)
    true = units @ (v / norms[:, None]).T
    error = rabitq.WIDTH / fit * np.sqrt(np.maximum(0, 1 - fit**2) / (dim - 1) + asked.off[:, None] ** 2 / dim)
    assert (np.abs(got / np.sqrt(dim) / fit - true) <= error).mean() > 0.97


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_op9_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    m = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    got = defaultdict(list)
    for r in queries.op9_rotated_bits(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = m @ m[k]
        score[k] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        hits += len(set(ids[best].tolist()) & {r["vec_id"] for r in got[int(ids[k])]})
        total += 20
        for r in got[int(ids[k])]:
            assert abs(r["score"] - score[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-9
    assert hits / total >= 0.97


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, None),
        ("", ""),
        ("<p>One<p>Two  words\n here", "One\n\nTwo words here"),
        ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>after", "- a\n- b\n  1. c\n  2. d\n\nafter"),
        ("<table><tr><th>Name<th>N<tr><td>Long name<td>1<tr><td>x<td>22</table>", "Name       N\nLong name  1\nx          22"),
        ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na  b"),
        ("a<script>no()</script><style>x</style><!-- c --><p hidden>no<p style='display: none'>no</p><p>b", "a\n\nb"),
        ("<head><title>t</title></head><body>x &amp; y&nbsp;z", "x & y\xa0z"),
        ("<pre>  keep\n   this</pre>", "  keep\n   this"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<h1>T</h1>x<div>y</div>z", "T\n\nx\ny\nz"),
        ("<b>bold</b><i>er</i> 1 < 2", "bolder 1 < 2"),
        ("</p></div>stray", "stray"),
        ("<ol start=3><li>x</ol>", "3. x"),
        ("<b>x</p>y", "xy"),
    ],
)
def test_pages(page, text):
    assert html_text.page_text(page) == text


def test_deep_and_long_pages_lose_no_text():
    deep = "".join(f"<div>w{i} " for i in range(3000))
    assert html_text.page_text(deep).split() == [f"w{i}" for i in range(3000)]
    assert len(html_text.page_text("<p>word</p>" * 20_000).split()) == 20_000
    assert html_text.page_text("<" * 50_000).count("<") == 50_000


def test_pages_table(spark, sf_dir):
    pages = spark.createDataFrame([(1, None, "<p>a"), (1, None, "<p>a"), (None, None, None), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert Counter(map(tuple, html_text.extract(pages).collect())) == Counter({(1, "a"): 2, (None, None): 1, (2, ""): 1})
    assert html_text.extract(pages.where("page_id > 5")).count() == 0
    got = queries.op3_html_layout(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and got.where("text = ''").count() == 0


# Chats


def chats(rows):
    convs = defaultdict(list)
    null_first = lambda x: (x is not None, x if x is not None else "")
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), null_first(role), null_first(text), (role, text)))
    whole = {c: tuple(t[3] for t in sorted(ts)) for c, ts in convs.items()}
    groups = defaultdict(list)
    for c, t in whole.items():
        groups[t].append(c)
    prefixes = {t[:k] for t in groups for k in range(1, len(t))}
    return Counter((min(cs, key=lambda c: (c is not None, c or 0)), len(t), len(cs), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t)) for t, cs in groups.items() if t not in prefixes)


def test_snapshots_collapse(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        base = rng.randrange(6)
        rows += [(c, t, "user" if t % 2 else "assistant", f"text {base} {t}") for t in range(rng.randint(1, 5))]
    rows += [(100, 0, None, None), (101, 0, None, None), (101, 1, None, ""), (102, 0, "", None), (103, 1, "a", "b"), (103, 1, "a", "b"), (104, 1, "a", "b"), (None, 0, "user", "lost"), (105, None, "user", "x|y"), (106, 0, "user", "long " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("h", "hash", "turns", "n_turns", "rendered")})
    assert Counter(map(tuple, chat.chat_format(df).collect())) == chats(rows)
    assert chat.chat_format(df.where("turn > 99")).count() == 0
