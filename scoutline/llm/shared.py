"""Shared-folder tables and small helpers for the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scoutline import session


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (with its scheme); a local
    session without the setting gets one from :func:`session.checkpoint_dir`."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (d or session.checkpoint_dir(spark)).rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and lets several
    readers prune columns.  Each call uses a folder of its own;
    :func:`release` deletes all folders of this application.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application in the shared folder, with its scheme."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.  Call it once the
    results that read them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scoutline-llm-{spark.sparkContext.applicationId}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ready(df: DataFrame) -> DataFrame:
    """Make the package importable in the Python workers of ``df``'s session."""
    session.ship_package(df.sparkSession)
    return df
