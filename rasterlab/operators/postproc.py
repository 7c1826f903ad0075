"""Mask post-processing: threshold, morphology, components, re-weighting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from rasterlab.config import LOOKALIKE, NUM_CLASSES, SHIP, EvalConfig
from rasterlab.functions import kernels
from rasterlab.sources.folders import written
from rasterlab.sources.packed import map_rows, packed, unpack


def class_mask(pixels: DataFrame, class_id: int = SHIP, threshold: float = EvalConfig.ship_threshold, values: str = "probs") -> DataFrame:
    """Long form with ``m`` (int): whether the class's probability exceeds the threshold."""
    return pixels.withColumn("m", (F.col(values)[class_id] > threshold).cast("int"))


def _on_masks(masks: DataFrame, fn, out: str = "u1") -> DataFrame:
    def one(row: dict) -> dict:
        return row | {"mask": packed(fn(unpack(row, "mask", "u1").astype(bool)), out)}

    return map_rows(masks, one, masks.schema)


def morph_open(masks: DataFrame, k: int = 2) -> DataFrame:
    """Packed masks (``mask``, a byte per pixel), opened; an even ``k`` shifts by one (see the kernel)."""
    return _on_masks(masks, lambda m: kernels.morph_open(m, k))


def morph_close(masks: DataFrame, k: int = 5) -> DataFrame:
    return _on_masks(masks, lambda m: kernels.morph_close(m, k))


def dilate_small(masks: DataFrame, min_size: int = EvalConfig.ship_min_size) -> DataFrame:
    """Components of at least ``min_size`` pixels; those below 30 dilated by 5x5 twice, below 100 once; united."""
    return _on_masks(masks, lambda m: kernels.grow_small(kernels.components(m), min_size))


def connected_components(masks: DataFrame) -> DataFrame:
    """``masks`` with ``components``: 64-bit labels, the smallest row-major index of the component, -1 outside."""

    def one(row: dict) -> dict:
        return row | {"components": packed(kernels.components(unpack(row, "mask", "u1").astype(bool)), "<i8")}

    return map_rows(masks, one, StructType([*masks.schema, StructField("components", BinaryType())]))


def component_pixels(labelled: DataFrame) -> DataFrame:
    """``(image_id, y, x, comp_id)`` of the pixels inside components."""
    from rasterlab.sources.packed import explode_pixels

    at = explode_pixels(labelled.select("image_id", "height", "width", F.col("components").alias("comp_id")), {"comp_id": "<i8"})
    return at.where("comp_id >= 0").withColumn("comp_id", F.col("comp_id").cast("long"))


def component_stats(pixels: DataFrame) -> DataFrame:
    """``(image_id, comp_id, area, y0, x0, y1, x1)``."""
    return pixels.groupBy("image_id", "comp_id").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


def filter_components(pixels: DataFrame, stats: DataFrame, min_size: int = EvalConfig.ship_min_size) -> DataFrame:
    return pixels.join(stats.where(F.col("area") >= min_size), ["image_id", "comp_id"], "left_semi")


def boost_and_suppress(pixels: DataFrame, mask: DataFrame, cfg: EvalConfig = EvalConfig(), values: str = "probs") -> DataFrame:
    """Long form: where ``mask`` has a pixel, ships are boosted and look-alikes suppressed; every pixel of an image with
    an entry in ``mask`` is divided by its class sum."""
    at = mask.select("image_id", "y", "x", F.lit(True).alias("on"))
    touched = mask.select("image_id", F.lit(True).alias("touched")).distinct()
    rows = pixels.join(at, ["image_id", "y", "x"], "left").join(touched, "image_id", "left")
    x = F.col(values)

    def changed(c: int) -> Column:
        v = x[c]
        if c == SHIP:
            return F.when(F.col("on"), F.least(F.greatest(v * cfg.ship_boost, F.lit(0.0)), F.lit(1.0))).otherwise(v)
        return F.when(F.col("on"), v * cfg.lookalike_factor).otherwise(v) if c == LOOKALIKE else v

    new = F.array(*(changed(c) for c in range(NUM_CLASSES)))
    rows = rows.withColumn("new", new)
    total = F.aggregate("new", F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn(values, F.when(F.col("touched"), F.transform("new", lambda v: v / total)).otherwise(x)).drop("new", "on", "touched")


def ship_enhancement(scored: DataFrame, cfg: EvalConfig = EvalConfig(), column: str = "probs", kind: str = "prob") -> DataFrame:
    """The whole refinement of packed probabilities, one image at a time. ``kind="log"`` takes their logarithms."""
    if kind not in ("prob", "log"):
        raise ValueError(f"kind: {kind}")

    def one(row: dict) -> dict:
        probs = unpack(row, column)
        probs = np.exp(probs) if kind == "log" else probs
        return row | {column: packed(kernels.ship_enhancement(probs, SHIP, LOOKALIKE, cfg.ship_threshold, cfg.ship_min_size, cfg.ship_boost, cfg.lookalike_factor))}

    return map_rows(scored, one, scored.schema)


def scene_components(tiles: DataFrame, scene_width: int) -> DataFrame:
    """Components of scenes cut into tiles: ``(image_id, comp_id, area)`` over the whole scene.

    A component's id is its smallest row-major index in the scene.
    """
    return scene_labels(tiles, scene_width).groupBy("image_id", "comp_id").agg(F.sum("n").alias("area"))


def scene_labels(tiles: DataFrame, scene_width: int) -> DataFrame:
    """``(image_id, top, left, c, n, comp_id)``: each component of a tile, by its smallest row-major index in the scene
    and its pixels, and the scene's component that it belongs to.

    ``tiles`` has ``image_id, top, left, height, width, mask`` without halo. Each tile is labelled in its task; only
    pixels on tile borders meet in a join, which gives links between tile components; labels then fall to the
    smallest by alternating large and small stars until nothing changes, each round written to the shared folder.
    """
    kind = tiles.schema["image_id"].dataType.simpleString()

    def one(row: dict) -> dict:
        local = kernels.components(unpack(row, "mask", "u1").astype(bool))
        h, w = local.shape
        inside = local >= 0
        scene = (local // w + row["top"]) * scene_width + local % w + row["left"]
        ids, counts = np.unique(scene[inside], return_counts=True)
        rim = np.zeros((h, w), bool)
        rim[[0, -1]] = rim[:, [0, -1]] = True
        y, x = np.nonzero(inside & rim)
        return {
            "image_id": row["image_id"],
            "top": row["top"],
            "left": row["left"],
            "parts": [{"c": int(c), "n": int(n)} for c, n in zip(ids, counts, strict=True)],
            "rim": [{"y": int(a + row["top"]), "x": int(b + row["left"]), "c": int(scene[a, b])} for a, b in zip(y, x, strict=True)],
        }

    found = map_rows(tiles.select("image_id", "top", "left", "height", "width", "mask"), one, f"image_id {kind}, top int, left int, parts array<struct<c:long,n:long>>, rim array<struct<y:int,x:int,c:long>>")
    found = written(found)
    parts = found.select("image_id", "top", "left", F.inline("parts"))
    rim = found.select("image_id", F.inline("rim"))
    near = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    reach = rim.withColumn("o", near).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("c").alias("b"))
    links = rim.join(reach, ["image_id", "y", "x"]).where("c > b").select("image_id", F.col("c").alias("a"), "b").distinct()
    mark = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("image_id", "a", "b")), F.sum(F.col("a") % 1_000_003)).first())
    links = written(links)
    seen = mark(links)
    while seen[0]:
        both = links.union(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("image_id", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, ["image_id", "a"]).where("b > a").select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("image_id", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["image_id", "a"])
        small = small.select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("image_id", "a", F.col("m").alias("b")))
        links = written(small.where("a <> b").select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if (now := mark(links)) == seen:
            break
        seen = now
    return parts.join(links, (parts.image_id == links.image_id) & (parts.c == links.a), "left").select(parts.image_id, "top", "left", "c", "n", F.coalesce("b", "c").alias("comp_id"))
