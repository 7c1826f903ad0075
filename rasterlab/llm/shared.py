"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="spark-")
        root = f"file://{shared_dir.own}"
    return f"{root.rstrip('/')}/rasterlab-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote of ``tables``, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``by``, as many as a shuffle has partitions, and read it back.

    A join or grouping by that column then finds the rows where they lie and doesn't shuffle them. Nothing is shuffled
    to write them either; each task adds a file to the buckets it has rows of.
    """
    spark = df.sparkSession
    name = f"rasterlab_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, by).option("path", shared_dir(spark)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)
