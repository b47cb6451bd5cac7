"""The driver's entry, with and without the folders of the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["word", "n"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'A4_count_all_words' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "tagflow")):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert "tagflow.llm" not in open(os.path.join(folder, f)).read()
