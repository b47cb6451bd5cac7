"""The corpus pipeline against brute force over its own stages."""

import corpus_pipeline
import pytest
from test_near_texts import least_ids
from test_quality import verdicts
from test_tokens import check_packing

from tagflow.llm import knn_quality


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """What each stage leaves, as run() writes it."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir, kept):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in kept[:3]:
        assert df.dtypes == docs.dtypes
    model = knn_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(kept[0]) == ids(knn_quality.classify(docs, model).where("predicted = 1"))
    rows = [tuple(r) for r in kept[0].select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert ids(kept[1]) == sorted(v[0] for v in verdicts(rows) if v[-1])
    rows = sorted(tuple(r) for r in kept[1].select("doc_id", "text").collect())
    assert ids(kept[2]) == sorted({rows[k][0] for k in least_ids([t for _, t in rows])})  # five words, 0.8, all pairs
    check_packing(kept[3].collect(), [tuple(r) for r in kept[2].select("doc_id", "text").collect()])


def test_run_gives_the_last_stage(spark, sf_dir, kept):
    names = kept[-1].columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*names).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_stages_take_odd_documents(spark, docs, nothing, sf_dir):
    for start in (docs, nothing):
        df = start
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
        df.count()
