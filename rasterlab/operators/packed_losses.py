"""Losses of packed predictions: one reading gives all sums of an image, and the global Lovász order moves as sorted runs.

``scored`` has a row per image with ``image_id``, ``height``, ``width``, ``labels`` (bytes) and ``probs`` (doubles, classes
fastest). No pixel becomes a row. An image without pixels adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rasterlab.config import NUM_CLASSES, LossConfig
from rasterlab.operators.losses import RARE, edges_of_classes
from rasterlab.sources.packed import STEP_BYTES, STEP_ROWS, steps, unpack

#: Ranges of errors for each halving, and pixels in a range from which it is cut further.
BUCKETS, RANGE_PIXELS = 8, 1 << 22
#: Bytes and images of predictions whose errors are sorted at once.
RUN_BYTES, RUN_ROWS = 16 << 20, 1 << 20

_SUMS = "pixels long, ce double, unweighted double, focal double, dice double, boundary double, cells long, weight double"


def _images(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES, most: int = STEP_ROWS) -> Iterator[list[dict]]:
    for batch in batches:
        for part in steps(batch, limit, most):
            if rows := [r for r in part.to_pylist() if r["height"] * r["width"]]:
                yield rows


def _columns(scored: DataFrame) -> DataFrame:
    return scored.select("image_id", "height", "width", "labels", "probs")


def hybrid_sums(scored: DataFrame, weights: list[float] | None, cfg: LossConfig = LossConfig(), num_classes: int = NUM_CLASSES, layout: str = "planes") -> DataFrame:
    """``(image_id, pixels, ce, unweighted, focal, dice, boundary, cells, weight)``: what an image adds to each part.

    ``ce``, ``unweighted`` and ``focal`` are sums over pixels, ``dice`` is the image's loss, ``boundary`` a sum over ``cells``
    scores, ``weight`` the sum of the pixels' weights.
    """
    kind = scored.schema["image_id"].dataType
    w = np.ones(num_classes) if weights is None else np.array(weights, float)

    def one(row: dict) -> tuple:
        truth = unpack(row, "labels", "u1").astype(np.intp)
        probs = unpack(row, "probs").reshape(*truth.shape, num_classes)
        p, y = np.clip(probs, cfg.epsilon, 1.0 - cfg.epsilon), np.eye(num_classes)[truth]
        smooth = y * (1.0 - cfg.smoothing) + cfg.smoothing / num_classes if cfg.smoothing > 0 else y
        ce, own = -(smooth * np.log(p)).sum(axis=-1), np.take_along_axis(p, truth[..., None], -1)[..., 0]
        dice = (2 * (y * p).sum(axis=(0, 1)) + cfg.epsilon) / (y.sum(axis=(0, 1)) + p.sum(axis=(0, 1)) + cfg.epsilon)
        et, ep = edges_of_classes(y, layout), edges_of_classes(probs, layout)
        near = np.clip(et.sum(axis=-1, keepdims=True), 0, 1) * (1.0 + np.isin(truth, RARE)[..., None] * (cfg.boundary_boost - 1.0))
        of_pixel = w[truth]
        return (row["image_id"], truth.size, (ce * of_pixel).sum(), ce.sum(), (ce * (1.0 - own) ** cfg.gamma * of_pixel).sum(), 1.0 - (dice * w).sum() / w.sum(), (np.square(et - ep) * near).sum(), et.size, of_pixel.sum())

    def run(batches):
        for rows in _images(batches):
            ids, *columns = zip(*map(one, rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), *(pa.array(np.array(c)) for c in columns)], names=["image_id", *(x.split()[0] for x in _SUMS.split(", "))])

    return _columns(scored).mapInArrow(run, f"image_id {kind.simpleString()}, {_SUMS}")


def hybrid_loss_packed(scored: DataFrame, weights: list[float] | None, cfg: LossConfig = LossConfig(), num_classes: int = NUM_CLASSES, layout: str = "planes", reduction: str = "mean") -> DataFrame:
    """``(ce, focal, dice, boundary, lovasz, total)`` from one reading of the predictions; Lovász, where it has a weight,
    reads them twice more. ``layout`` and ``reduction`` as in the losses of the long form. Without pixels all are null."""
    sums = hybrid_sums(scored, weights, cfg, num_classes, layout)
    mean = lambda name: F.sum(name) / F.sum("pixels")
    dice = F.avg("dice") if reduction == "mean" else 1.0 - F.sum(1.0 - F.col("dice"))
    out = sums.agg(mean("ce").alias("ce"), mean("focal").alias("focal"), dice.alias("dice"), (F.sum("boundary") / F.sum("cells") * mean("weight")).alias("boundary"))
    lovasz = F.lit(0.0)
    if cfg.lovasz:
        lovasz = lovasz_packed(scored, num_classes, clip=cfg.epsilon).select("loss").scalar()
    total = cfg.ce * F.col("ce") + cfg.focal * F.col("focal") + cfg.dice * F.col("dice") + cfg.boundary * F.col("boundary") + cfg.lovasz * F.col("lovasz")
    return out.withColumn("lovasz", lovasz).withColumn("total", total)


def _errors(row: dict, num_classes: int, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """Errors and indicators of an image, a row for each class."""
    probs = unpack(row, "probs").reshape(-1, num_classes).T
    hit = unpack(row, "labels", "u1").ravel() == np.arange(num_classes)[:, None]
    return np.abs(hit - (np.clip(probs, clip, 1.0 - clip) if clip else probs)), hit


def _merged(err: np.ndarray, n: np.ndarray, fg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct errors, largest first, with their counts."""
    values, at = np.unique(-err, return_inverse=True)
    count = lambda x: np.bincount(at, x, len(values)).astype(np.int64)
    return -values, count(n), count(fg)


def _gains(err: np.ndarray, n: np.ndarray, fg: np.ndarray, before: int, fg_before: int, total: int) -> float:
    """What distinct errors, largest first, add to the loss of a class with ``total`` true pixels."""
    i, f = np.append(before, before + np.cumsum(n)), np.append(fg_before, fg_before + np.cumsum(fg))
    return float((err * np.diff(1.0 - (total - f) / np.maximum(total + i - f, 1))).sum())


def lovasz_of_images(scored: DataFrame, num_classes: int = NUM_CLASSES, clip: float = 0.0) -> DataFrame:
    """``(image_id, loss)``: Lovász-Softmax of each image by itself, computed where the image lies."""
    kind = scored.schema["image_id"].dataType

    def one(row: dict) -> float:
        parts = []
        for err, hit in zip(*_errors(row, num_classes, clip), strict=True):
            if total := int(hit.sum()):
                parts.append(_gains(*_merged(err, np.ones(err.size), hit), 0, 0, total))
        return sum(parts) / len(parts)

    def run(batches):
        for rows in _images(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r["image_id"] for r in rows], to_arrow_type(kind)), pa.array([one(r) for r in rows])], names=["image_id", "loss"])

    return _columns(scored).mapInArrow(run, f"image_id {kind.simpleString()}, loss double")


def _place(err: np.ndarray) -> np.ndarray:
    """Where an error lies on the scale of ranges; larger errors come first, each halving takes BUCKETS ranges."""
    return -np.log2(np.clip(np.nan_to_num(err, nan=1.0), 1e-30, 1.0)) * BUCKETS


def error_histogram(scored: DataFrame, num_classes: int = NUM_CLASSES, clip: float = 0.0) -> DataFrame:
    """``(class_id, bucket, n)``: pixels in each range of errors, counted in the tasks; at most 100 * BUCKETS rows a class."""

    def run(batches):
        for rows in _images(batches):
            for c in range(num_classes):
                place = np.concatenate([_place(_errors(r, num_classes, clip)[0][c]) for r in rows]).astype(np.int32)
                bucket, n = np.unique(place, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c, np.int32)), pa.array(bucket), pa.array(n)], names=["class_id", "bucket", "n"])

    return _columns(scored).mapInArrow(run, "class_id int, bucket int, n long").groupBy("class_id", "bucket").agg(F.sum("n").alias("n"))


def error_runs(scored: DataFrame, num_classes: int = NUM_CLASSES, clip: float = 0.0, range_pixels: int = RANGE_PIXELS) -> DataFrame:
    """``(class_id, bucket, part, n, fg, err, ns, fgs)``: for each RUN_BYTES of predictions, class and range of errors one
    row with its distinct errors, largest first, and their counts as packed arrays.

    Ranges with more than ``range_pixels`` pixels are cut into parts of equal width on the logarithm, which is narrow
    enough for the density to be even; equal errors stay together, and are one entry for each run.
    """
    hot = {(r.class_id, r.bucket): -(-r.n // range_pixels) for r in error_histogram(scored, num_classes, clip).where(F.col("n") > range_pixels).collect()}

    def run(batches):
        for rows in _images(batches, RUN_BYTES, RUN_ROWS):
            both = [_errors(r, num_classes, clip) for r in rows]
            for c in range(num_classes):
                err, n, fg = _merged(np.concatenate([e[c] for e, _ in both]), np.ones(sum(e.shape[1] for e, _ in both)), np.concatenate([h[c] for _, h in both]))
                place = _place(err)
                bucket = place.astype(np.int32)
                names, first = np.unique(bucket, return_index=True)
                k = np.array([hot.get((c, int(b)), 1) for b in names])[np.searchsorted(names, bucket)]
                part = np.minimum(((place - bucket) * k).astype(np.int64), k - 1)
                cuts = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(part) != 0)))
                ends = np.append(cuts[1:], len(err))
                pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cuts), c, np.int32)), pa.array(bucket[cuts]), pa.array(part[cuts]), pa.array(np.add.reduceat(n, cuts)), pa.array(np.add.reduceat(fg, cuts)), pack(err), pack(n), pack(fg)],
                    names=["class_id", "bucket", "part", "n", "fg", "err", "ns", "fgs"],
                )

    return _columns(scored).mapInArrow(run, "class_id int, bucket int, part long, n long, fg long, err binary, ns binary, fgs binary")


def lovasz_packed(scored: DataFrame, num_classes: int = NUM_CLASSES, clip: float = 0.0, range_pixels: int = RANGE_PIXELS) -> DataFrame:
    """Lovász-Softmax over all pixels together: ``(loss,)``, 0 without a pixel.

    Tasks sort their errors by class and range; only these runs move, and each range is merged by itself. The counts of
    the ranges before it, one row for each, say where a range begins in the order of all pixels. The runs are written
    first, as both the counts and the merges read them.
    """
    from rasterlab.sources.folders import written

    runs = written(error_runs(scored, num_classes, clip, range_pixels))
    keys = ["class_id", "bucket", "part"]
    sums = runs.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("fg").alias("fg"))
    whole = Window.partitionBy("class_id")
    earlier = whole.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    starts = sums.select(*keys, none(F.sum("n").over(earlier)).alias("n0"), none(F.sum("fg").over(earlier)).alias("f0"), F.sum("fg").over(whole).alias("g")).where("g > 0")

    def merge(table: pa.Table) -> pa.Table:
        arrays = [np.concatenate([np.frombuffer(x.as_py(), t) for x in table[c]]) for c, t in (("err", "<f8"), ("ns", "<i8"), ("fgs", "<i8"))]
        at = {c: table[c][0].as_py() for c in ("class_id", "n0", "f0", "g")}
        return pa.table({"class_id": pa.array([at["class_id"]], pa.int32()), "loss": [_gains(*_merged(*arrays), at["n0"], at["f0"], at["g"])]})

    parts = runs.select(*keys, "err", "ns", "fgs").join(starts, keys).groupBy(*keys).applyInArrow(merge, "class_id int, loss double")
    return parts.groupBy("class_id").agg(F.sum("loss").alias("loss")).agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))
