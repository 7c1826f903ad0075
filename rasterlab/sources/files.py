"""Reading image and mask files, pairing them, splits, and the sinks."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rasterlab.config import NUM_CLASSES
from rasterlab.sources.folders import written
from rasterlab.sources.packed import map_rows

SPLITS = ("train", "val", "test")


def stem(path: str = "path"):
    """The file name without folder and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^.]*)?$", 1)


def _decoded(spark: SparkSession, folder: str, pattern: str, on_error: str) -> DataFrame:
    if on_error not in ("fail", "drop", "quarantine"):
        raise ValueError(f"on_error: {on_error}")
    df = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", on_error == "drop").load(folder)
    return df.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _gray(row: dict) -> np.ndarray:
    """One plane: gray as it is, blue-green-red as luma."""
    data = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
    if row["channels"] == 1:
        return data[..., 0]
    return np.floor(data[..., 2] * 0.299 + data[..., 1] * 0.587 + data[..., 0] * 0.114 + 0.5).astype(np.uint8)


def _scan(spark, folder, pattern, on_error, name, convert, dtype):
    def one(row: dict) -> dict:
        out = {"path": row["path"], "image_id": None, "height": row["height"], "width": row["width"], name: None, "error": None}
        if row["height"] < 0:
            if on_error == "fail":
                raise ValueError(f"unreadable image: {row['path']}")
            return out | {"error": "unreadable"}
        return out | {name: np.ascontiguousarray(convert(_gray(row)), dtype).tobytes()}

    rows = map_rows(_decoded(spark, folder, pattern, on_error), one, f"path string, image_id string, height int, width int, {name} binary, error string")
    rows = rows.withColumn("image_id", stem())
    return rows if on_error == "quarantine" else rows.drop("error")


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.jpg", on_error: str = "fail") -> DataFrame:
    """``(path, image_id, height, width, pixels)``: one gray plane of doubles in [0, 1].

    ``on_error``: ``fail``, ``drop``, or ``quarantine``, which keeps unreadable files with a text in ``error``.
    """
    return _scan(spark, folder, pattern, on_error, "pixels", lambda x: x / 255.0, "<f8")


def scan_masks(spark: SparkSession, folder: str, pattern: str = "*.png", num_classes: int = NUM_CLASSES, on_error: str = "fail") -> DataFrame:
    """``(path, image_id, height, width, labels)``: a byte per pixel, clipped to the last class."""
    return _scan(spark, folder, pattern, on_error, "labels", lambda x: np.minimum(x, num_classes - 1), "u1")


def position(df: DataFrame, order: str = "path") -> DataFrame:
    """``df`` with ``position``: the 0-based place in ascending byte order of ``order``, nulls first.

    Rows are dealt to ranges of the order and sorted there, which numbers them within their range; a range's first place
    is the number of rows before it, added up over one row per range. No window holds all rows and nothing leaves the
    JVM. The numbered rows are written in between, as ranges are drawn anew whenever a plan runs again. Rows equal in
    ``order`` follow each other by their other columns.
    """
    key = F.encode(F.col(order).cast("string"), "UTF-8")
    ranges = df.select("*", key.alias("_key"), F.xxhash64(*df.columns).alias("_tie")).repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie")
    rows = written(ranges.drop("_key", "_tie").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")  # fixed by Spark: the range above 33 bits, the row in it below
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    placed = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("position"))


def pair_samples(images: DataFrame, masks: DataFrame, pair: str = "stem") -> DataFrame:
    """Images joined with masks: ``(image_id, image_path, mask_path)`` from listings that have ``path``.

    ``stem`` joins on the file stem; ``position`` on the place in each sorted listing, and fails on unequal counts.
    Join the contents afterwards: only paths are shuffled here.
    """
    a, b = images.select(F.col("path").alias("image_path")), masks.select(F.col("path").alias("mask_path"))
    if pair == "stem":
        joined = a.withColumn("image_id", stem("image_path")).join(b.withColumn("image_id", stem("mask_path")), "image_id")
    elif pair == "position":
        if (m := a.count()) != (n := b.count()):
            raise ValueError(f"{m} images, {n} masks")
        joined = position(a, "image_path").join(position(b, "mask_path"), "position").withColumn("image_id", stem("image_path"))
    else:
        raise ValueError(f"pair: {pair}")
    return joined.select("image_id", "image_path", "mask_path")


def orphans(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``(path, missing)``: files whose stem has no counterpart, and which kind is missing."""
    a, b = images.select("path", stem().alias("s")), masks.select("path", stem().alias("s"))
    return a.join(b, "s", "left_anti").select("path", F.lit("mask").alias("missing")).union(b.join(a, "s", "left_anti").select("path", F.lit("image").alias("missing")))


def select_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of a split; ``train`` and ``val`` are parts of the training folder."""
    if split not in SPLITS:
        raise ValueError(f"split: {split}")
    return df.where(F.col("split") == split)


def write_class_weights(weights: DataFrame, path: str, masks: int, pixels: int) -> None:
    """Keep weights with what they were computed from."""
    weights.withColumn("masks", F.lit(masks).cast("long")).withColumn("pixels", F.lit(pixels).cast("long")).coalesce(1).write.mode("overwrite").parquet(path)


def read_class_weights(spark: SparkSession, path: str, masks: int | None = None, pixels: int | None = None) -> DataFrame | None:
    """Kept weights, or None if there are none or they belong to other masks."""
    try:
        kept = spark.read.parquet(path)
    except AnalysisException:
        return None
    row = kept.select("masks", "pixels").first()
    if row is None or masks is not None and row.masks != masks or pixels is not None and row.pixels != pixels:
        return None
    return kept.drop("masks", "pixels")


def write_samples(df: DataFrame, path: str, shards: int) -> None:
    """Training samples as Parquet by split and epoch, ordered by batch inside each file."""
    keys = [c for c in ("split", "epoch") if c in df.columns]
    out = df.repartition(shards, *keys, *(["batch_id"] if "batch_id" in df.columns else [])).sortWithinPartitions(*keys, *(["batch_id"] if "batch_id" in df.columns else []))
    out.write.mode("overwrite").partitionBy(*keys).parquet(path)


def class_iou_table(runs: DataFrame) -> DataFrame:
    """The columns of the class comparison file, from ``compare_runs``."""
    return runs.select(F.col("class_name").alias("Class"), F.col("iou_a").alias("IoU_TTA"), F.col("iou_b").alias("IoU_baseline"), F.col("improvement").alias("Improvement"))


def write_class_iou_csv(runs: DataFrame, path: str) -> None:
    class_iou_table(runs).coalesce(1).write.mode("overwrite").csv(path, header=True)


def render_report(summary: DataFrame, per_class: DataFrame) -> str:
    """Markdown from the two small metric tables."""
    lines = ["# Evaluation", "", "| Metric | Value |", "| --- | --- |"]
    lines += [f"| {r.metric} | {r.value:.4f} |" for r in summary.orderBy("metric").collect()]
    lines += ["", "| Class | IoU % | Precision % | Recall % | F1 % |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r.class_name} | {r.iou:.2f} | {r.precision:.2f} | {r.recall:.2f} | {r.f1:.2f} |" for r in per_class.orderBy("class_id").collect()]
    return "\n".join(lines) + "\n"
