"""Segmentation losses as aggregates: which images and classes does a model fit badly? Values only, no gradients.

The long form has ``image_id, y, x, true_class`` and an array of logits or probabilities; ``weights`` is a list by class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlab.config import NUM_CLASSES, OIL, SHIP, LossConfig
from rasterlab.functions import arrays as A, kernels
from rasterlab.sources.packed import steps, unpack

#: The clip of the stand-alone losses; the hybrid one has its own in the configuration.
EPSILON = 1e-5
RARE = (OIL, SHIP)


def probabilities(logits: str | Column, epsilon: float | None = EPSILON, clip_logits: bool = True) -> Column:
    x = F.col(logits) if isinstance(logits, str) else logits
    p = A.softmax(A.clip_all(x, -100.0, 100.0) if clip_logits else x)
    return p if epsilon is None else A.clip_all(p, epsilon, 1.0 - epsilon)


def weighted_cross_entropy(pixels: DataFrame, weights: list[float], logits: str = "logits", by: list[str] | None = None) -> DataFrame:
    """Smoothed cross-entropy averaged over the classes of a pixel, times the true class's weight, averaged: ``loss``."""
    n = len(weights)
    rows = pixels.withColumn("p", probabilities(logits))
    ce = -A.dot(A.smooth(A.one_hot("true_class", n), n), F.transform("p", lambda v: F.log(v))) / n
    return rows.groupBy(*(by or [])).agg(F.avg(ce * A.weight_of("true_class", weights)).alias("loss"))


def focal_loss(pixels: DataFrame, weights: list[float], gamma: float = 2.0, logits: str = "logits", by: list[str] | None = None) -> DataFrame:
    """As above without smoothing, and with the factor (1 - p)^gamma."""
    rows = pixels.withColumn("p", probabilities(logits)[F.col("true_class")])
    fl = -F.pow(1.0 - F.col("p"), F.lit(gamma)) * F.log("p") / len(weights)
    return rows.groupBy(*(by or [])).agg(F.avg(fl * A.weight_of("true_class", weights)).alias("loss"))


def dice_table(pixels: DataFrame, probs: str, epsilon: float) -> DataFrame:
    """``(image_id, class_id, dice)`` from sums per image and class."""
    rows = pixels.select("image_id", "true_class", F.posexplode(probs).alias("class_id", "p"))
    y = (F.col("true_class") == F.col("class_id")).cast("double")
    sums = rows.groupBy("image_id", "class_id").agg(F.sum(y * F.col("p")).alias("i"), F.sum(y).alias("sy"), F.sum("p").alias("sp"))
    return sums.select("image_id", "class_id", ((2 * F.col("i") + epsilon) / (F.col("sy") + F.col("sp") + epsilon)).alias("dice"))


def dice_loss(pixels: DataFrame, weights: list[float], logits: str = "logits") -> DataFrame:
    """The stand-alone form: the weighted mean is divided by the number of classes once more, so a perfect score is not 0."""
    rows = pixels.withColumn("p", probabilities(logits, epsilon=None))
    dice = dice_table(rows, "p", EPSILON)
    return dice.agg((1.0 - F.avg(F.col("dice") * A.weight_of("class_id", weights) / sum(weights))).alias("loss"))


def hybrid_ce(pixels: DataFrame, weights: list[float] | None, cfg: LossConfig = LossConfig(), probs: str = "probs", num_classes: int = NUM_CLASSES, by: list[str] | None = None) -> DataFrame:
    """Smoothed cross-entropy summed over classes: ``loss`` weighted, ``unweighted`` without weights."""
    ce = _cross_entropy(probs, cfg, num_classes)
    w = A.weight_of("true_class", weights) if weights else F.lit(1.0)
    return pixels.withColumn("ce", ce).groupBy(*(by or [])).agg(F.avg(F.col("ce") * w).alias("loss"), F.avg("ce").alias("unweighted"))


def _cross_entropy(probs: str, cfg: LossConfig, num_classes: int) -> Column:
    p = A.clip_all(F.col(probs), cfg.epsilon, 1.0 - cfg.epsilon)
    y = A.one_hot("true_class", num_classes)
    y = A.smooth(y, num_classes, cfg.smoothing) if cfg.smoothing > 0 else y
    return -A.dot(y, F.transform(p, lambda v: F.log(v)))


def hybrid_focal(pixels: DataFrame, weights: list[float] | None, cfg: LossConfig = LossConfig(), probs: str = "probs", num_classes: int = NUM_CLASSES, by: list[str] | None = None) -> DataFrame:
    """Unweighted cross-entropy times (1 - p of the true class)^gamma, then weighted."""
    p = A.clip(F.col(probs)[F.col("true_class")], cfg.epsilon, 1.0 - cfg.epsilon)
    w = A.weight_of("true_class", weights) if weights else F.lit(1.0)
    return pixels.withColumn("fl", _cross_entropy(probs, cfg, num_classes) * F.pow(1.0 - p, F.lit(cfg.gamma)) * w).groupBy(*(by or [])).agg(F.avg("fl").alias("loss"))


def hybrid_dice(pixels: DataFrame, weights: list[float] | None, cfg: LossConfig = LossConfig(), probs: str = "probs", num_classes: int = NUM_CLASSES, reduction: str = "mean") -> DataFrame:
    """Weighted soft Dice of each image, averaged. ``reduction="reference"`` sums over images but divides by the weights
    once, so it depends on how many images there are."""
    clipped = pixels.withColumn("p", A.clip_all(F.col(probs), cfg.epsilon, 1.0 - cfg.epsilon))
    weights = weights or [1.0] * num_classes
    dice = dice_table(clipped, "p", cfg.epsilon)
    score = F.sum(F.col("dice") * A.weight_of("class_id", weights)) / sum(weights)
    if reduction == "reference":
        return dice.agg((1.0 - score).alias("loss"))
    return dice.groupBy("image_id").agg((1.0 - score).alias("loss")).agg(F.avg("loss").alias("loss"))


def sobel_edges(images: DataFrame, column: str = "plane") -> DataFrame:
    """Packed planes of doubles, replaced by |Gx| + |Gy|."""
    from rasterlab.operators.augment import apply_kernel

    return apply_kernel(images, lambda plane, _: kernels.sobel(plane), column)


def edges_of_classes(x: np.ndarray, layout: str = "planes") -> np.ndarray:
    """Edges of each class of an (H, W, C) array. ``layout="reference"`` reshapes the interleaved classes into planes
    without transposing them, as the original does."""
    h, w, c = x.shape
    if layout == "reference":
        return np.stack([kernels.sobel(p) for p in x.reshape(c, h, w)]).reshape(h, w, c)
    return np.stack([kernels.sobel(x[..., i]) for i in range(c)], axis=-1)


def boundary_sums(scored: DataFrame, weights: list[float] | None, boost: float = 2.0, num_classes: int = NUM_CLASSES, layout: str = "planes") -> DataFrame:
    """``(image_id, total, cells, weight, pixels)``: the sums that the boundary loss is made of, one row per image."""
    kind = scored.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in steps(whole)):
            out = []
            for row in batch.to_pylist():
                truth = unpack(row, "labels", "u1").astype(int)
                y = np.eye(num_classes)[truth]
                et, ep = edges_of_classes(y, layout), edges_of_classes(unpack(row, "probs"), layout)
                mask = np.clip(et.sum(axis=-1, keepdims=True), 0, 1) * (1.0 + np.isin(truth, RARE)[..., None] * (boost - 1.0))
                w = np.ones(num_classes) if weights is None else np.array(weights)
                out.append((row["image_id"], float((np.square(et - ep) * mask).sum()), et.size, float(w[truth].sum()), truth.size))
            if out:
                types = (batch["image_id"].type, pa.float64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["image_id", "total", "cells", "weight", "pixels"])

    return scored.select("image_id", "height", "width", "labels", "probs").mapInArrow(run, f"image_id {kind}, total double, cells long, weight double, pixels long")


def boundary_loss(scored: DataFrame, weights: list[float] | None, boost: float = 2.0, num_classes: int = NUM_CLASSES, layout: str = "planes") -> DataFrame:
    """Mean squared edge difference near true boundaries, times the mean pixel weight."""
    sums = boundary_sums(scored, weights, boost, num_classes, layout)
    return sums.agg((F.sum("total") / F.sum("cells") * (F.sum("weight") / F.sum("pixels"))).alias("loss"))


def lovasz_softmax(pixels: DataFrame, probs: str = "probs", by: list[str] | None = None, num_classes: int = NUM_CLASSES, buckets: int = 128) -> DataFrame:
    """Lovász-Softmax: mean over the classes in the truth of errors, largest first, times the steps of the Jaccard loss.

    Pixels with equal errors telescope to one step, so rows are first aggregated by class and error; ``by=["image_id"]``
    gives one value per image. Without ``by`` the order is global: errors fall into ``buckets`` for each
    halving of the error, whose sums give every bucket its offset, and the running sums stay inside a bucket. The small
    errors of a good model, which lie close to each other, are parted by their logarithm.
    """
    by = by or []
    rows = pixels.select(*by, "true_class", F.posexplode(probs).alias("class_id", "p"))
    fg = (F.col("true_class") == F.col("class_id")).cast("long")
    steps = rows.withColumn("fg", fg).withColumn("err", F.abs(F.col("fg") - F.col("p"))).groupBy(*by, "class_id", "err").agg(F.count("*").alias("n"), F.sum("fg").alias("fg"))
    steps = steps.withColumn("bucket", F.lit(0) if by else F.floor(-F.log2(F.greatest(F.least("err", F.lit(1.0)), F.lit(1e-30))) * buckets).cast("int"))
    sums = steps.groupBy(*by, "class_id", "bucket").agg(F.sum("n").alias("bn"), F.sum("fg").alias("bfg"))
    whole = Window.partitionBy(*by, "class_id")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "class_id", "bucket", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("bfg").over(earlier), F.lit(0)).alias("f0"), F.sum("bfg").over(whole).alias("g"))
    at = Window.partitionBy(*by, "class_id", "bucket").orderBy(F.col("err").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.join(sums, [*by, "class_id", "bucket"]).where("g > 0")
    steps = steps.withColumn("i", F.col("n0") + F.sum("n").over(at)).withColumn("f", F.col("f0") + F.sum("fg").over(at))

    def jaccard(i: Column, f: Column) -> Column:
        return F.coalesce(1.0 - F.try_divide((F.col("g") - f).cast("double"), (F.col("g") + i - f).cast("double")), F.lit(0.0))

    gain = jaccard(F.col("i"), F.col("f")) - jaccard(F.col("i") - F.col("n"), F.col("f") - F.col("fg"))
    per_class = steps.groupBy(*by, "class_id").agg(F.sum(F.col("err") * gain).alias("loss"))
    return per_class.groupBy(*by).agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def hybrid_loss(pixels: DataFrame, scored: DataFrame, weights: list[float] | None, cfg: LossConfig = LossConfig(), num_classes: int = NUM_CLASSES, layout: str = "planes", reduction: str = "mean") -> DataFrame:
    """``(ce, focal, dice, boundary, lovasz, total)``: the weighted parts of one-row aggregates, put side by side.

    ``pixels`` is the long form and ``scored`` the packed form of the same predictions.
    """
    one = lambda df, name: df.select(F.col("loss").alias(name))
    clipped = pixels.withColumn("probs", A.clip_all(F.col("probs"), cfg.epsilon, 1.0 - cfg.epsilon))
    out = one(hybrid_ce(pixels, weights, cfg, num_classes=num_classes), "ce")
    out = out.crossJoin(one(hybrid_focal(pixels, weights, cfg, num_classes=num_classes), "focal"))
    out = out.crossJoin(one(hybrid_dice(pixels, weights, cfg, num_classes=num_classes, reduction=reduction), "dice"))
    out = out.crossJoin(one(boundary_loss(scored, weights, cfg.boundary_boost, num_classes, layout), "boundary"))
    lovasz = one(lovasz_softmax(clipped, num_classes=num_classes), "lovasz") if cfg.lovasz else pixels.sparkSession.range(1).select(F.lit(0.0).alias("lovasz"))
    out = out.crossJoin(lovasz)
    return out.withColumn("total", cfg.ce * F.col("ce") + cfg.focal * F.col("focal") + cfg.dice * F.col("dice") + cfg.boundary * F.col("boundary") + cfg.lovasz * F.col("lovasz"))


