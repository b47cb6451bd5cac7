"""Host-level rules (1) and the classifier (5)."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.llm import knn_quality, queries, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORDS.findall(text or "")
    lines, earlier, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in earlier
            earlier.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def beta_prior(hosts):
    """Mean and weight of the beta-binomial law with the moments of the hosts' (failures, documents)."""
    if len(hosts) < 2:
        return (hosts[0][0] / hosts[0][1] if hosts else 0.0), 1000.0
    rates = np.array([k / n for k, n in hosts])
    m, v, chance = rates.mean(), rates.var(ddof=1), np.mean([1 / n for _, n in hosts])
    if m in (0, 1) or chance == 1:
        return m, 1000.0
    r = (v / (m * (1 - m)) - chance) / (1 - chance)
    return m, max(1.0, 1 / r - 1) if r > 1 / 1001 else 1000.0


def test_the_prior_does_not_take_chance_for_spread(spark):
    """Hosts of one true rate get a heavy prior however few documents they have; hosts of a beta law get its weight."""
    rng = np.random.default_rng(5)
    alike = [(int(rng.binomial(n, 0.2)), n) for n in rng.integers(2, 9, 3000).tolist()]
    spread = [(int(rng.binomial(n, p)), n) for n, p in zip(rng.integers(2, 9, 3000).tolist(), rng.beta(2, 6, 3000), strict=True)]
    for hosts, low, high in ((alike, 60, 1000), (spread, 6, 11)):
        m, weight = beta_prior(hosts)
        assert low <= weight <= high
        rows = [(str(h), i < k) for h, (k, n) in enumerate(hosts) for i in range(n)]
        got = {r["host"]: r["host_rate"] for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean"), "host", "failed").collect()}
        assert all(abs(got[str(h)] - (k + m * weight) / (n + weight)) < 1e-9 for h, (k, n) in enumerate(hosts))


def verdicts(rows):
    """Brute force: each row's measures and kept."""
    hosts = defaultdict(list)
    for r in rows:
        if r[3] is not None:
            hosts[r[3]].append(measures(r[1])[-1])
    m, weight = beta_prior([(sum(h), len(h)) for h in hosts.values()])
    bad = {h for h, f in hosts.items() if (sum(f) + m * weight) / (len(f) + weight) > quality_rules.MAX_HOST_RATE}
    return [(r[0], *measures(r[1]), not measures(r[1])[-1] and r[3] not in bad) for r in rows]


def test_rules_and_hosts(docs, rows):
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(map(tuple, got.collect())) == Counter(verdicts(rows))


def test_kept_documents_are_the_kept_rows(docs, rows):
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(v[0] for v in verdicts(rows) if v[-1])


def test_a_failing_host_takes_its_documents_along(spark):
    fine, short = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, fine if i % 10 == 0 else short, "en", "bad", 1) for i in range(50)] + [(100 + i, fine, "en", f"good{i % 3}", 1) for i in range(60)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not any(out[i] for i in range(50)) and all(out[100 + i] for i in range(60))


def test_rules_without_a_broadcast_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(quality_rules, "broadcast_if_small", lambda df: df)
    test_rules_and_hosts(docs, rows)
    test_kept_documents_are_the_kept_rows(docs, rows)


def test_rules_on_nothing(nothing):
    assert quality_rules.quality_rules(nothing).count() == 0
    assert quality_rules.kept_documents(nothing).count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op5_knn_quality(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(quality[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    right = np.mean([y == p for y, p, _ in held])
    pos, neg = [s for y, _, s in held if y == 1], [s for y, _, s in held if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert right > 0.85 and auc > 0.9, (right, auc)


def test_held_out_labels_and_other_columns_teach_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(knn_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    a = {r["doc_id"]: r["score"] for r in knn_quality.classify(docs, knn_quality.train(docs, labels)).collect()}
    b = {r["doc_id"]: r["score"] for r in knn_quality.classify(other, knn_quality.train(other, flipped)).collect()}
    assert a == b


def brute_score(model, v):
    """A score by sorting all cosines, equal ones by the labelled row's place; None where the last voter is a close call."""
    cos = np.array([float(v.astype(float) @ w.astype(float)) for w in model.vectors])
    order = np.argsort(-cos, kind="stable")
    k = min(knn_quality.VOTERS, len(order))
    if k < len(order) and cos[order[k - 1]] - cos[order[k]] < 1e-5:
        return None
    w = np.maximum(cos[order[:k]], 0) ** knn_quality.SHARPNESS
    y = model.labels[order[:k]]
    w = w * np.where(y == 1, model.prior / model.labels.mean(), (1 - model.prior) / (1 - model.labels.mean()))
    return (w * y).sum() / w.sum() if w.sum() > 0 else model.prior


def test_classifier_votes_as_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int").dropDuplicates(["doc_id"])
    model = knn_quality.train(docs, labels)
    assert len(model.labels) <= knn_quality.MOST_LABELLED
    z = model.latent(knn_quality.terms([(r[1] or "").encode() for r in rows]))
    got = knn_quality.classify(docs, model)
    assert sorted(set(docs.columns) - {"score", "predicted"}) == sorted(set(got.columns) - {"score", "predicted"})
    by_text = defaultdict(set)
    for r in got.collect():
        by_text[r["text"] or ""].add(r["score"])
    expected = [(r[1] or "", brute_score(model, v)) for r, v in zip(rows, z, strict=True)]
    assert sum(e is not None for _, e in expected) > len(expected) / 2
    assert all(abs(e - s) < 1e-3 for t, e in expected if e is not None for s in by_text[t])
    assert list(by_text[""]) == pytest.approx([model.prior])


def test_equal_cosines_vote_in_the_order_of_the_labelled_rows():
    model = knn_quality.Model(np.ones(knn_quality.TERMS, np.float32), np.eye(knn_quality.TERMS, knn_quality.RANK, dtype=np.float32), np.zeros((60, knn_quality.RANK), np.float32), np.array([0.0, 1.0] * 15 + [1.0] * 30), 0.5)
    model.vectors[:, 0] = 1
    x = np.zeros((3, knn_quality.TERMS), np.float32)
    x[:, 0] = 1
    share, mean = 12 / 25, model.labels.mean()
    expected = share / mean / (share / mean + (1 - share) / (1 - mean))
    assert np.allclose(model.score(x), expected)


def test_a_repeated_id_teaches_one_text_whatever_the_order(spark):
    texts = ["one text here", "another text there", "yet another", None]
    rows = [(i % 7, texts[i % 4] if i % 3 else f"text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(0, 1)], "doc_id long, quality int")
    models = [knn_quality.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 3), (sorted(rows, key=str), 5))]
    assert len(models[0].labels) > 0
    assert all((m.vectors == models[0].vectors).all() and (m.labels == models[0].labels).all() for m in models)


def test_classifier_without_labels_or_documents(plain, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in knn_quality.classify(plain, knn_quality.train(plain, none)).collect()} == {0.5}
    assert knn_quality.classify(nothing, knn_quality.train(nothing, none)).count() == 0


@pytest.mark.parametrize("text", ["", " \n", "x"])
def test_terms_of_very_short_texts(text):
    assert np.isfinite(knn_quality.terms([text.encode()])).all()
