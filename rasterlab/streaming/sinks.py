"""Draining a finite stream into a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlab.sources.folders import work_folder


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` over what is there: its last state (``complete``), or all rows that it emitted (``append``)."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def landed(df: DataFrame) -> DataFrame:
    """A table as the stream of its files."""
    folder = f"{work_folder(df.sparkSession)}/landed"
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(folder)


class EpochSink:
    """A folder with one table per epoch: writing an epoch again replaces it, so repeated batches count once."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows of all epochs, with their ``epoch``."""
        try:
            return spark.read.schema(f"{schema}, epoch long").parquet(self.folder)
        except AnalysisException:  # no epoch yet
            return spark.createDataFrame([], f"{schema}, epoch long")

    def totals(self, spark: SparkSession) -> DataFrame:
        """``(true_class, pred_class, n)`` over all epochs of counts."""
        rows = self.read(spark, "true_class int, pred_class int, n long")
        return rows.groupBy("true_class", "pred_class").agg(F.sum("n").alias("n"))
