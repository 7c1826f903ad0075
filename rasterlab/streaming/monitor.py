"""Streaming score monitoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from rasterlab.operators.metrics import class_iou, confusion_per_image, mean_iou, total_confusion
from rasterlab.operators.prep import class_counts


def stream_confusion(scores: DataFrame) -> DataFrame:
    """Running confusion counts of a stream (or table) with ``true_class`` and ``pred_class``; complete or update mode."""
    return scores.groupBy(F.col("true_class").cast("int").alias("true_class"), F.col("pred_class").cast("int").alias("pred_class")).agg(F.count("*").alias("n"))


def stream_windowed_confusion(scores: DataFrame, window: str = "1 day", watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts per tumbling window: a new window starts from zero, late rows beyond the watermark are dropped by Spark."""
    rows = scores.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    counts = rows.groupBy(F.window(time, window).alias("w"), F.col("true_class").cast("int").alias("true_class"), F.col("pred_class").cast("int").alias("pred_class")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "true_class", "pred_class", "n")


def windowed_iou(counts: DataFrame) -> DataFrame:
    """``(window_start, miou)`` of the windows' counts."""
    return mean_iou(counts, "union", ["window_start"])


def windowed_class_iou(counts: DataFrame) -> DataFrame:
    return class_iou(counts, ["window_start"])


def stream_windowed_iou(scores: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, window: str = "1 day", watermark: str = "1 hour", time: str = "ts"):
    """Start the query: each micro-batch's finished windows are turned into scores and given to ``sink(table, epoch)``."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(windowed_iou(batch), epoch)

    counts = stream_windowed_confusion(scores, window, watermark, time)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)


def stream_class_distribution(masks: DataFrame) -> DataFrame:
    """Running pixel counts per class of arriving packed masks: counted in the tasks first."""
    return class_counts(masks).groupBy("class_id").agg(F.sum("pixel_count").alias("pixel_count"))


def stream_pairs(truth: DataFrame, preds: DataFrame, within: str = "1 hour", watermark: str = "1 hour", key: str = "image_id", time: str = "ts") -> DataFrame:
    """Masks and predictions that arrive apart, joined by ``key`` where their times differ by ``within`` at most.

    ``truth`` has ``labels`` and ``preds`` has ``preds``, both packed, with the time of each. Either may come first: Spark
    keeps a row until the other stream's watermark says that no partner in time can come any more, so the state holds
    what arrives within both spans, however long the stream runs. Rows later than the watermark are dropped by Spark.
    """
    a = truth.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    b = preds.select(F.col(key).alias("_key"), F.col(time).cast("timestamp").alias("pred_time"), "preds").withWatermark("pred_time", watermark)
    near = (F.col("pred_time") >= F.col(time) - F.expr(f"interval {within}")) & (F.col("pred_time") <= F.col(time) + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("_key")) & near).drop("_key")


def stream_joined_confusion(truth: DataFrame, preds: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, within: str = "1 hour", watermark: str = "1 hour", key: str = "image_id", time: str = "ts"):
    """Start-ready writer: each micro-batch's new pairs are counted in their tasks and the counts given to
    ``sink(counts, epoch)``. With a sink that keeps one table per epoch (``sinks.EpochSink``) a batch that runs again
    after a failure changes nothing."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(total_confusion(batch), epoch)

    counts = confusion_per_image(stream_pairs(truth, preds, within, watermark, key, time), key=key)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
