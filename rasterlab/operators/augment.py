"""Augmentation as plan and apply: draws are columns, and applying them is a pure function of pixels and plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rasterlab.config import AugmentConfig
from rasterlab.functions import kernels, keyed
from rasterlab.functions.arrays import clip
from rasterlab.operators.prep import assign_batches, shuffle_epoch
from rasterlab.sources.packed import map_rows, packed, unpack


def flip_h(pixels: DataFrame, width: int) -> DataFrame:
    """Long form; every value column moves together, so image and mask stay aligned."""
    return pixels.withColumn("x", F.lit(width - 1) - F.col("x"))


def flip_v(pixels: DataFrame, height: int) -> DataFrame:
    return pixels.withColumn("y", F.lit(height - 1) - F.col("y"))


def rot90(pixels: DataFrame, size: int, k: int) -> DataFrame:
    """Counter-clockwise quarter turns of square images in the long form."""
    x, y, last = F.col("x"), F.col("y"), F.lit(size - 1)
    ny, nx = {0: (y, x), 1: (last - x, y), 2: (last - y, last - x), 3: (x, last - y)}[k % 4]
    return pixels.withColumns({"y": ny, "x": nx})


def apply_kernel(images: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], column: str = "pixels", dtype: str = "<f8") -> DataFrame:
    """Packed images through a NumPy function of pixels and row, which keeps the size."""

    def one(row: dict) -> dict:
        return row | {column: packed(fn(unpack(row, column, dtype), row), dtype)}

    return map_rows(images, one, images.schema)


def rotate(images: DataFrame, angle: float, nearest: bool = False, column: str = "pixels", dtype: str = "<f8") -> DataFrame:
    return apply_kernel(images, lambda image, _: kernels.rotate(image, angle, nearest), column, dtype)


def gaussian_blur(images: DataFrame, sigma: float) -> DataFrame:
    return apply_kernel(images, lambda image, _: kernels.blur(image, sigma))


def apply_noise(value: Column, noise: Column) -> Column:
    """Multiplicative speckle with given noise."""
    return clip(value * (1.0 + noise), 0.0, 1.0)


def brightness(value: Column, delta: Column | float) -> Column:
    return clip(value + delta, 0.0, 1.0)


def contrast(pixels: DataFrame, factor: Column | float, value: str = "v", key: str = "image_id") -> DataFrame:
    """Spread around each image's mean, which is aggregated before it is joined."""
    mean = pixels.groupBy(key).agg(F.avg(value).alias("mean"))
    return pixels.join(mean, key).withColumn(value, clip((F.col(value) - F.col("mean")) * factor + F.col("mean"), 0.0, 1.0)).drop("mean")


def gamma(value: Column, exponent: Column | float) -> Column:
    return clip(F.pow(clip(value, 1e-7, 1.0), F.lit(exponent) if isinstance(exponent, float) else exponent), 0.0, 1.0)


def cutout(pixels: DataFrame, patches: Column | str, value: str = "v") -> DataFrame:
    """Zero inside any of the planned rectangles, an array of (top, left, h, w). The mask is left as it is."""
    patches = F.col(patches) if isinstance(patches, str) else patches
    inside = lambda p: (F.col("y") >= p["top"]) & (F.col("y") < p["top"] + p["h"]) & (F.col("x") >= p["left"]) & (F.col("x") < p["left"] + p["w"])
    return pixels.withColumn(value, F.when(F.exists(patches, inside), 0.0).otherwise(F.col(value)))


def augmentation_plan(images: DataFrame, cfg: AugmentConfig = AugmentConfig(), seed: int = 42, epoch: int = 0, key: str = "image_id") -> DataFrame:
    """``images`` with every random parameter as a column: a pure projection that no retry can change."""
    u = lambda name: keyed.uniform(name, key, seed, epoch)

    def maybe(name: str, p: float, value: Column) -> Column:
        return F.when(u(f"{name}?") < p, value)

    def patch(i: int) -> Column:
        share = keyed.between(u(f"cut_size{i}"), *cfg.cutout_size)
        h, w = F.floor(share * F.col("height")).cast("int"), F.floor(share * F.col("width")).cast("int")
        room = lambda n, side: F.greatest(n - side, F.lit(1))
        return F.struct(keyed.below(u(f"cut_top{i}"), room(F.col("height"), h)).alias("top"), keyed.below(u(f"cut_left{i}"), room(F.col("width"), w)).alias("left"), h.alias("h"), w.alias("w"))

    patches = F.slice(F.array(*(patch(i) for i in range(cfg.cutout_patches))), F.lit(1), keyed.below(u("cut_n"), cfg.cutout_patches) + 1)
    return images.withColumns({
        "flip_h": u("flip_h") < cfg.p_flip_h,
        "flip_v": u("flip_v") < cfg.p_flip_v,
        "quarter": F.coalesce(maybe("quarter", cfg.p_rot90, keyed.below(u("quarter"), 3) + 1), F.lit(0)),
        "angle": keyed.between(u("angle"), -cfg.max_rotation, cfg.max_rotation),
        "speckle": u("speckle?") < cfg.p_speckle,
        "delta": maybe("brightness", cfg.p_brightness, keyed.between(u("brightness"), -cfg.brightness, cfg.brightness)),
        "factor": maybe("contrast", cfg.p_contrast, keyed.between(u("contrast"), *cfg.contrast)),
        "gamma": maybe("gamma", cfg.p_gamma, keyed.between(u("gamma"), *cfg.gamma)),
        "sigma": maybe("blur", cfg.p_blur, keyed.between(u("blur"), *cfg.blur_sigma)),
        "patches": maybe("cutout", cfg.p_cutout, patches),
    })


PLAN = ("flip_h", "flip_v", "quarter", "angle", "speckle", "delta", "factor", "gamma", "sigma", "patches")


def _augmented(image: np.ndarray, mask: np.ndarray, plan: dict, rng: np.random.Generator, cfg: AugmentConfig, cut: bool) -> tuple[np.ndarray, np.ndarray]:
    for name, axis in (("flip_h", 1), ("flip_v", 0)):
        if plan[name]:
            image, mask = np.flip(image, axis), np.flip(mask, axis)
    if plan["quarter"]:
        image, mask = np.rot90(image, plan["quarter"]), np.rot90(mask, plan["quarter"])
    else:
        image, mask = kernels.rotate(image, plan["angle"]), kernels.rotate(mask, plan["angle"], nearest=True)
    if plan["speckle"]:
        image = np.clip(image * (1.0 + rng.normal(0.0, cfg.speckle_sigma, image.shape)), 0.0, 1.0)
    if plan["delta"] is not None:
        image = image + plan["delta"]
    if plan["factor"] is not None:
        image = (image - image.mean()) * plan["factor"] + image.mean()
    image = np.clip(image, 0.0, 1.0)
    if plan["gamma"] is not None:
        image = np.clip(np.maximum(image, 1e-7) ** plan["gamma"], 0.0, 1.0)
    if plan["sigma"] is not None:
        image = kernels.blur(image, plan["sigma"])
    for p in (plan["patches"] or []) if cut else []:
        image = image.copy()
        image[p["top"] : p["top"] + p["h"], p["left"] : p["left"] + p["w"]] = 0.0
    return np.clip(image, 0.0, 1.0), mask


def augment(samples: DataFrame, cfg: AugmentConfig = AugmentConfig(), seed: int = 42, epoch: int = 0, mode: str = "intent", keep_plan: bool = False) -> DataFrame:
    """Packed samples (``pixels`` doubles, ``labels`` bytes) with a plan, augmented in one pass without a shuffle.

    An image is turned by quarters or rotated by a small angle, never both. Cutout erases rectangles; ``mode="reference"`` leaves them, as the original implementation's mask of ones does.
    Quarter turns need square images.
    """
    planned = augmentation_plan(samples, cfg, seed, epoch)

    def one(row: dict) -> dict:
        rng = keyed.generator("speckle", row["image_id"], seed, epoch)
        image, mask = _augmented(unpack(row), unpack(row, "labels", "u1"), row, rng, cfg, mode == "intent")
        return row | {"pixels": packed(image), "labels": packed(mask, "u1")}

    out = map_rows(planned, one, planned.schema)
    return out if keep_plan else out.drop(*PLAN)


def apply_augmentation(samples: DataFrame, batch_size: int, cfg: AugmentConfig = AugmentConfig(), seed: int = 42, epoch: int = 0) -> DataFrame:
    """One epoch: ids are shuffled and numbered into full batches; only then are pixels joined and augmented."""
    order = shuffle_epoch(samples.select("image_id"), seed, epoch, "image_id").withColumn("u", F.format_string("%.17f", "u"))
    batches = assign_batches(order, batch_size, drop_remainder=True, order="u")
    return augment(samples.join(batches.select("image_id", "batch_id"), "image_id"), cfg, seed, epoch)


def map_samples(samples: DataFrame, fn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Any user function (image, mask) -> (image, mask) over packed samples."""

    def one(row: dict) -> dict:
        image, mask = fn(unpack(row), unpack(row, "labels", "u1"))
        return row | {"pixels": packed(image), "labels": packed(mask, "u1"), "height": image.shape[0], "width": image.shape[1]}

    return map_rows(samples, one, samples.schema)
