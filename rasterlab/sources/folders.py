"""Folders and tables in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back: this cuts its lineage and survives lost executors."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` in buckets of ``by``, as many as a shuffle has partitions, and read it back: joins and groupings by
    these columns then don't shuffle it again. It is shuffled once here, so that a bucket is one file."""
    spark = df.sparkSession
    name = f"rasterlab_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *by).write.bucketBy(n, *by).option("path", work_folder(spark)).saveAsTable(name)
    return spark.table(name)
