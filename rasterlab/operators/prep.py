"""Dataset preparation: splits, class balance, geometry, patches, batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rasterlab.config import NUM_CLASSES, OIL, SHIP, DataConfig
from rasterlab.functions import kernels, keyed
from rasterlab.sources import files
from rasterlab.sources.packed import map_rows, packed, steps, unpack


def split_train_val(listing: DataFrame, val_split: float = 0.15, order: str = "path") -> DataFrame:
    """``listing`` with ``split``: the last ``max(1, int(val_split * n))`` rows by ``order`` are val, the others train."""
    placed = files.position(listing, order)
    n = listing.count()
    val = max(1, int(val_split * n))
    return placed.withColumn("split", F.when(F.col("position") >= n - val, "val").otherwise("train")).drop("position")


def clip_labels(label: Column | str, num_classes: int = NUM_CLASSES) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.least(F.greatest(label, F.lit(0)), F.lit(num_classes - 1))


def class_counts(masks: DataFrame, num_classes: int = NUM_CLASSES, by: str | None = None) -> DataFrame:
    """``([by,] class_id, pixel_count)`` of packed masks; counted in the tasks, so at most one row per class and image
    is shuffled. Values beyond the last class count as the last."""

    def run(batches):
        for batch in (part for whole in batches for part in steps(whole)):
            if by is None:
                total = np.zeros(num_classes, np.int64)
                for data in batch["labels"]:
                    total += np.bincount(np.minimum(np.frombuffer(data.as_py(), np.uint8), num_classes - 1), minlength=num_classes)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(num_classes, dtype=np.int32)), pa.array(total)], names=["class_id", "pixel_count"])
            else:
                counts = [np.bincount(np.minimum(np.frombuffer(x.as_py(), np.uint8), num_classes - 1), minlength=num_classes) for x in batch["labels"]]
                keys = batch[by].take(pa.array(np.repeat(np.arange(batch.num_rows), num_classes)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(num_classes, dtype=np.int32), batch.num_rows)), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], names=[by, "class_id", "pixel_count"])

    columns = [by] if by else []
    kind = f"{by} {masks.schema[by].dataType.simpleString()}, " if by else ""
    return masks.select(*columns, "labels").mapInArrow(run, kind + "class_id int, pixel_count long")


def class_distribution(masks: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """``(class_id, pixel_count)`` over all packed masks; classes that don't occur have 0."""
    return fill_classes(class_counts(masks, num_classes).groupBy("class_id").agg(F.sum("pixel_count").alias("pixel_count")), num_classes)


def class_distribution_long(pixels: DataFrame, label: str = "true_class", num_classes: int = NUM_CLASSES) -> DataFrame:
    """The same from one row per pixel."""
    return fill_classes(pixels.groupBy(clip_labels(label, num_classes).alias("class_id")).agg(F.count("*").alias("pixel_count")), num_classes)


def fill_classes(counts: DataFrame, num_classes: int) -> DataFrame:
    every = counts.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("class_id"))
    return every.join(F.broadcast(counts), "class_id", "left").select("class_id", F.coalesce("pixel_count", F.lit(0)).cast("long").alias("pixel_count"))


def class_weights(distribution: DataFrame) -> DataFrame:
    """``(class_id, pixel_count, freq, weight)``: inverse frequencies that add up to 1. The table has a row per class."""
    total = Window.partitionBy(F.lit(0))
    freq = F.col("pixel_count") / (F.sum("pixel_count").over(total) + 1e-12)
    out = distribution.withColumn("freq", freq).withColumn("raw", 1.0 / (F.col("freq") + 1e-6))
    return out.select("class_id", "pixel_count", "freq", (F.col("raw") / F.sum("raw").over(total)).alias("weight"))


def normalise_pixels(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double") / 255.0


def auto_rescale(pixels: DataFrame, value: str = "v", key: str = "image_id") -> DataFrame:
    """Divide an image by 255 if any of its values exceeds 1; decided for each image alone."""
    top = pixels.groupBy(key).agg(F.max(value).alias("top"))
    return pixels.join(top, key).withColumn(value, F.when(F.col("top") > 1.0, F.col(value) / 255.0).otherwise(F.col(value))).drop("top")


def fix_channels(pixels: DataFrame, expected: int, values: str = "values") -> DataFrame:
    """An array column of channels made ``expected`` long: one is repeated, several are averaged first."""
    x = F.col(values)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return pixels.withColumn(values, F.when(F.size(x) == expected, x).otherwise(F.array_repeat(mean, expected)))


def resize(images: DataFrame, height: int, width: int, method: str = "bilinear", column: str = "pixels", dtype: str = "<f8") -> DataFrame:
    """Packed images in another size; other columns pass through."""
    kernel = {"bilinear": kernels.resize_bilinear, "nearest": kernels.resize_nearest}[method]

    def one(row: dict) -> dict:
        return row | {column: packed(kernel(unpack(row, column, dtype), height, width), dtype), "height": height, "width": width}

    return map_rows(images, one, images.schema)


def resize_nearest_long(pixels: DataFrame, size: int, height: int, width: int, key: str = "image_id") -> DataFrame:
    """Nearest resize of ``size`` x ``size`` images in the long form: an equi-join on mapped coordinates."""
    spark = pixels.sparkSession
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("ny"), (F.col("id") % width).cast("int").alias("nx"))
    source = lambda c, n: F.least(F.floor((F.col(c) + 0.5) * size / n), F.lit(size - 1)).cast("int")
    grid = grid.select("ny", "nx", source("ny", height).alias("y"), source("nx", width).alias("x"))
    return pixels.join(grid, ["y", "x"]).drop("y", "x").withColumnsRenamed({"ny": "y", "nx": "x"})


def pad_to_patch(images: DataFrame, size: int, columns: dict[str, str]) -> DataFrame:
    """Zeros at the bottom and right up to ``size``; in a mask, zero is the first class."""

    def one(row: dict) -> dict:
        out = {c: packed(kernels.pad(unpack(row, c, d), size), d) for c, d in columns.items()}
        return row | out | {"height": max(size, row["height"]), "width": max(size, row["width"])}

    return map_rows(images, one, images.schema)


def class_presence(pixels: DataFrame, label: str = "true_class", key: str = "image_id") -> DataFrame:
    """``(key, has_ship, has_oil, target_class, valid)``: ship is the target where it occurs, else oil."""
    out = pixels.groupBy(key).agg(F.bool_or(F.col(label) == SHIP).alias("has_ship"), F.bool_or(F.col(label) == OIL).alias("has_oil"))
    return out.withColumn("target_class", F.when(F.col("has_ship"), SHIP).otherwise(OIL)).withColumn("valid", F.col("has_ship") | F.col("has_oil"))


def sample_target_pixel(pixels: DataFrame, seed: int = 42, epoch: int = 0, label: str = "true_class", key: str = "image_id") -> DataFrame:
    """``(key, cy, cx)``: a uniformly drawn pixel of the target class, by the smallest keyed draw. Images without one are
    left out. One pass: the minimum is kept for ship and for oil, and ship's is taken where there is one."""
    draw = keyed.uniform("target", F.concat_ws("_", F.col(key), F.col("y"), F.col("x")), seed, epoch)
    place = F.struct(draw.alias("u"), F.col("y").alias("cy"), F.col("x").alias("cx"))
    rare = pixels.where(F.col(label).isin(SHIP, OIL))
    both = rare.groupBy(key).agg(F.min(F.when(F.col(label) == SHIP, place)).alias("ship"), F.min(F.when(F.col(label) == OIL, place)).alias("oil"))
    at = F.coalesce("ship", "oil")
    return both.select(key, at["cy"].alias("cy"), at["cx"].alias("cx"))


def patch_plan(images: DataFrame, targets: DataFrame, size: int, seed: int = 42, epoch: int = 0, p_centred: float = 0.5, key: str = "image_id") -> DataFrame:
    """``images`` with ``top`` and ``left`` of one patch each, and ``centred``.

    With ``p_centred`` the patch surrounds the target pixel, as far as the image allows; else, or without a target,
    its place is drawn uniformly. All draws are keyed, so the plan is a pure projection after the join with targets.
    """
    return _placed(images.join(targets, key, "left"), size, seed, epoch, p_centred, key)


def _placed(found: DataFrame, size: int, seed: int, epoch: int, p_centred: float = 0.5, key: str = "image_id") -> DataFrame:
    centred = (keyed.uniform("patch", key, seed, epoch) < p_centred) & F.col("cy").isNotNull()

    def place(c: str, side: str, name: str) -> Column:
        room = F.greatest(side, F.lit(size)) - size
        free = keyed.below(keyed.uniform(name, key, seed, epoch), room + 1)
        return F.when(centred, F.least(F.greatest(F.col(c) - size // 2, F.lit(0)), room)).otherwise(free).cast("int")

    return found.withColumns({"top": place("cy", "height", "top"), "left": place("cx", "width", "left"), "centred": centred}).drop("cy", "cx")


def apply_patches(planned: DataFrame, size: int, columns: dict[str, str]) -> DataFrame:
    """Cut the planned patch out of every packed column, padding first where the image is smaller."""

    def one(row: dict) -> dict:
        top, left = row["top"], row["left"]
        cut = {c: packed(kernels.pad(unpack(row, c, d), size)[top : top + size, left : left + size], d) for c, d in columns.items()}
        return row | cut | {"height": size, "width": size}

    return map_rows(planned, one, planned.schema)


def class_centred_crop(pixels: DataFrame, plan: DataFrame, size: int, key: str = "image_id") -> DataFrame:
    """The long form of a patch: a range filter and a shift."""
    inside = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + size) & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + size)
    cut = pixels.join(plan.select(key, "top", "left"), key).where(inside)
    return cut.withColumn("y", F.col("y") - F.col("top")).withColumn("x", F.col("x") - F.col("left")).drop("top", "left")


def sample_patches(samples: DataFrame, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """One patch of every packed sample (``pixels`` and ``labels``), with ``top``, ``left`` and ``centred``.

    The target pixel is found inside the task: no pixel is shuffled.
    """

    def target(row: dict) -> dict:
        labels = np.frombuffer(row["labels"], np.uint8)
        found = np.flatnonzero(labels == SHIP)
        found = found if len(found) else np.flatnonzero(labels == OIL)
        if not len(found):
            return {"image_id": row["image_id"], "cy": None, "cx": None} | {k: row[k] for k in ("height", "width", "pixels", "labels")}
        at = int(found[keyed.generator("target", row["image_id"], seed, epoch).integers(len(found))])
        return {"image_id": row["image_id"], "cy": at // row["width"], "cx": at % row["width"]} | {k: row[k] for k in ("height", "width", "pixels", "labels")}

    kind = samples.schema["image_id"].dataType.simpleString()
    found = map_rows(samples.select("image_id", "height", "width", "pixels", "labels"), target, f"image_id {kind}, cy int, cx int, height int, width int, pixels binary, labels binary")
    return apply_patches(_placed(found, size, seed, epoch), size, {"pixels": "<f8", "labels": "u1"})


def assign_batches(listing: DataFrame, size: int, drop_remainder: bool = False, order: str = "path") -> DataFrame:
    """``listing`` with ``batch_id`` by ascending ``order``; the last, smaller batch can be dropped."""
    placed = files.position(listing, order).withColumn("batch_id", F.floor(F.col("position") / size).cast("int"))
    if drop_remainder:
        placed = placed.where(F.col("position") < listing.count() // size * size)
    return placed.drop("position")


def shuffle_epoch(listing: DataFrame, seed: int = 42, epoch: int = 0, key: str = "path") -> DataFrame:
    """``listing`` with ``u``, the order of the epoch: a full shuffle that is the same under any partitioning."""
    return listing.withColumn("u", keyed.uniform("shuffle", key, seed, epoch))


def epoch_places(placed: DataFrame, n: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``placed``, which has the ``position`` of each of ``n`` rows, with ``place``: where the row comes in the epoch.

    Positions are taken once, by ``files.position``; every epoch then is an expression on each row: no sort, no shuffle.
    """
    return placed.withColumn("place", keyed.permuted(F.col("position"), n, "epoch", seed, epoch))


def epoch_batch(spark: SparkSession, n: int, size: int, batch: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``(position, place)`` of one batch of an epoch: its ``size`` places, taken back to positions. Nothing else of the
    epoch is computed, so a job that stopped at a batch goes on there."""
    places = spark.range(batch * size, min(n, (batch + 1) * size)).select(F.col("id").alias("place"))
    return places.select(keyed.permuted(F.col("place"), n, "epoch", seed, epoch, inverse=True).alias("position"), "place")


def parse_original(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``(image_id, height, width, pixels, labels)`` in the files' own resolution."""
    return images.select("image_id", "height", "width", "pixels").join(masks.select("image_id", "labels"), "image_id")


def parse_resized(images: DataFrame, masks: DataFrame, size: int = DataConfig.size) -> DataFrame:
    """The same at ``size`` x ``size``: images bilinear, masks nearest."""
    a = resize(images.select("image_id", "height", "width", "pixels"), size, size)
    b = resize(masks.select("image_id", "height", "width", "labels"), size, size, "nearest", "labels", "u1")
    return a.join(b.select("image_id", "labels"), "image_id")


def load_dataset(spark: SparkSession, folder: str, split: str, cfg: DataConfig = DataConfig(), pair: str = "stem", drop_remainder: bool = True, seed: int = 42, epoch: int = 0) -> tuple[DataFrame, DataFrame | None, int]:
    """Samples with ``batch_id`` of one split, the class weights (for train only), and the number of batches.

    For train, one patch of ``cfg.size`` is cut from each image in its own resolution, about half of them around a
    pixel of a rare class, and the batches follow the shuffle of ``seed`` and ``epoch``: so every epoch has other
    patches and another order, and a repeated run has the same. For val and test, images are resized and batches follow
    the paths. Only listings are paired, split, shuffled and numbered; contents join by id afterwards.
    """
    if split not in files.SPLITS:
        raise ValueError(f"split: {split}")
    root = f"{folder}/{'test' if split == 'test' else 'train'}"
    images, masks = files.scan_images(spark, f"{root}/images"), files.scan_masks(spark, f"{root}/labels_1D")
    listing = files.pair_samples(images.select("path"), masks.select("path"), pair)
    listing = listing.withColumn("split", F.lit("test")) if split == "test" else split_train_val(listing, cfg.val_split, "image_path")
    listing = files.select_split(listing, split)
    n = listing.count()
    order = "image_path"
    if split == "train":
        listing, order = shuffle_epoch(listing, seed, epoch, "image_id").withColumn("u", F.format_string("%.17f", "u")), "u"
    batches = assign_batches(listing, cfg.batch_size, drop_remainder and split == "train", order)
    chosen = batches.select("image_id", F.col("image_path").alias("path"), "mask_path", "batch_id")
    images = images.drop("image_id").join(chosen.select("path", "image_id"), "path")
    masks = masks.drop("image_id").join(chosen.select(F.col("mask_path").alias("path"), "image_id"), "path")
    samples = sample_patches(parse_original(images, masks), cfg.size, seed, epoch) if split == "train" else parse_resized(images, masks, cfg.size)
    weights = class_weights(class_distribution(masks)) if split == "train" else None
    return samples.join(chosen.select("image_id", "batch_id"), "image_id"), weights, -(-n // cfg.batch_size)

