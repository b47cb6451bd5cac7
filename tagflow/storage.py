"""Cutting lineage: tables written to the folder that all executors share.

All tables of an application lie in one folder there, which ``clear`` removes. A loop that needs only its last table
cuts with ``replacing``, so that the one before is removed as soon as the new one is written.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own, but only if all executors are in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = local_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


@cache
def local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"spark-{application}-")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tagflow-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str = "table") -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str = "snappy", replacing: DataFrame | None = None) -> DataFrame:
    """``df`` computed once, written and read back; a lost executor costs no recomputation.

    ``replacing``: a table that ``cut`` gave and that nothing but ``df`` reads any more; it is removed.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if replacing is not None and "cut_path" in vars(replacing):
        remove(spark, replacing.cut_path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table from any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has cut. Results that read them must have been stored elsewhere."""
    remove(spark, own_dir(spark))
