"""Inference fan-out over scales and variants, and the fusion of predictions. The model is the user's callable."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from rasterlab.config import NUM_CLASSES, EvalConfig
from rasterlab.functions import kernels
from rasterlab.functions.arrays import clip_all
from rasterlab.sources.packed import map_rows, packed, steps, unpack

#: The rotations of the variants, and the scales that are off unless asked for.
ANGLES = (-math.pi / 12, math.pi / 12, -math.pi / 6, math.pi / 6)
SCALES = (0.75, 1.25)
LOW, HIGH = 1e-7, 1.0 - 1e-7
INFO = "struct<kind:string,angle:double,scale:double,orig_h:int,orig_w:int>"

Predict = Callable[[np.ndarray], np.ndarray]


def variant_list(n: int = 8, flips: bool = True, rotations: bool = True, scales: bool = False, original: bool = True) -> list[tuple[str, float | None, float | None]]:
    """(kind, angle, scale) in order, cut to ``n``; the original comes first and is never cut."""
    out: list[tuple[str, float | None, float | None]] = [("original", None, None)] if original else []
    out += [(k, None, None) for k in ("h_flip", "v_flip", "h_flip_v_flip")] if flips else []
    out += [("rotate", a, None) for a in ANGLES] if rotations else []
    out += [("scale", None, s) for s in SCALES] if scales else []
    return out[:n]


def tta_variants(spark: SparkSession, **options) -> DataFrame:
    """``(variant, kind, angle, scale)``: a handful of rows, to be cross-joined with images as a literal table."""
    rows = [(i, *v) for i, v in enumerate(variant_list(**options))]
    return spark.createDataFrame(rows, "variant int, kind string, angle double, scale double")


def scale_variants(images: DataFrame, scales: tuple[float, ...] = EvalConfig.scales) -> DataFrame:
    """``images`` once per scale with ``scaled_h`` and ``scaled_w``: truncated, then rounded up to a multiple of 8."""
    size = lambda side: (F.ceil(F.floor(F.col(side) * F.col("scale")) / 8) * 8).cast("int")
    out = images.withColumn("scale", F.explode(F.array(*(F.lit(float(s)) for s in scales))))
    return out.withColumn("scaled_h", size("height")).withColumn("scaled_w", size("width"))


def scaled_size(n: int, scale: float) -> int:
    return -(-int(n * scale) // 8) * 8


def forward(image: np.ndarray, kind: str, angle: float | None, scale: float | None, size: tuple[int, int]) -> np.ndarray:
    """A variant of an image in the model's size; an unknown kind is the original."""
    if kind in ("h_flip", "h_flip_v_flip"):
        image = np.flip(image, 1)
    if kind in ("v_flip", "h_flip_v_flip"):
        image = np.flip(image, 0)
    if kind == "rotate":
        image = kernels.rotate(image, angle)
    if kind == "scale":
        image = kernels.resize_bilinear(image, max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale)))
    return kernels.resize_bilinear(image, *size) if image.shape[:2] != size else image


def backward(scores: np.ndarray, kind: str, angle: float | None, size: tuple[int, int]) -> np.ndarray:
    """The prediction for a variant, brought back to the original's geometry and size."""
    if kind in ("h_flip", "h_flip_v_flip"):
        scores = np.flip(scores, 1)
    if kind in ("v_flip", "h_flip_v_flip"):
        scores = np.flip(scores, 0)
    if kind == "rotate":
        scores = kernels.rotate(scores, -angle)
    return kernels.resize_bilinear(scores, *size) if scores.shape[:2] != size else scores


def augment_variant(images: DataFrame, variants: list[tuple[str, float | None, float | None]], model_h: int, model_w: int) -> DataFrame:
    """One row per image and variant: ``variant``, ``info`` (what the inverse needs) and the pixels in the model's size."""
    kind = images.schema["image_id"].dataType.simpleString()
    table = F.array(*(F.struct(F.lit(i).alias("variant"), F.lit(k).alias("kind"), F.lit(a).cast("double").alias("angle"), F.lit(s).cast("double").alias("scale")) for i, (k, a, s) in enumerate(variants)))
    rows = images.select("image_id", "height", "width", "pixels", F.explode(table).alias("v")).select("image_id", "height", "width", "pixels", "v.*")

    def one(row: dict) -> dict:
        image = forward(unpack(row), row["kind"], row["angle"], row["scale"], (model_h, model_w))
        info = {"kind": row["kind"], "angle": row["angle"], "scale": row["scale"], "orig_h": row["height"], "orig_w": row["width"]}
        return {"image_id": row["image_id"], "variant": row["variant"], "info": info, "height": model_h, "width": model_w, "pixels": packed(image)}

    return map_rows(rows, one, f"image_id {kind}, variant int, info {INFO}, height int, width int, pixels binary")


def reverse_variant(scored: DataFrame, column: str = "logits") -> DataFrame:
    """Packed predictions with ``info``, brought back to the original geometry and size."""

    def one(row: dict) -> dict:
        info = row["info"]
        out = backward(unpack(row, column), info["kind"], info["angle"], (info["orig_h"], info["orig_w"]))
        return row | {column: packed(out), "height": info["orig_h"], "width": info["orig_w"]}

    return map_rows(scored, one, scored.schema)


#: Bytes of all classes' scores that one call of the model makes, and of pixels that wait in a task for a call.
SCORE_BYTES, QUEUE_BYTES = 96 << 20, 128 << 20


class SizeQueue:
    """Images of a task that wait for a call of the model, by their size.

    ``add`` gives the groups that are ready: one that has as many images as a call takes, and the largest one where more
    than QUEUE_BYTES wait in all, as many sizes may each have few images. Groups grow over the borders of Arrow
    batches; ``rest`` gives what is left at the end. A call takes as many images as its scores fit SCORE_BYTES, at
    most ``most``; ``classes`` is corrected once the model has answered.
    """

    def __init__(self, most: int, classes: int, itemsize: int = 8, least_pixels: int = 0, score_bytes: int | None = None):
        self.most, self.classes, self.itemsize, self.least_pixels = most, classes, itemsize, least_pixels
        self.score_bytes = score_bytes or SCORE_BYTES
        self.groups: dict[tuple, list[dict]] = {}
        self.waiting = 0

    def room(self, size: tuple) -> int:
        """Images of this (height, width, bytes) in a call."""
        pixels = max(size[0] * size[1], self.least_pixels)
        return max(1, min(self.most, self.score_bytes // max(1, pixels * self.classes * self.itemsize)))

    def _take(self, size: tuple) -> list[dict]:
        self.waiting -= size[2] * len(self.groups[size])
        return self.groups.pop(size)

    def add(self, row: dict) -> Iterator[list[dict]]:
        size = (row["height"], row["width"], len(row["pixels"]))
        self.groups.setdefault(size, []).append(row)
        self.waiting += size[2]
        if len(self.groups[size]) >= self.room(size):
            yield self._take(size)
        elif self.waiting > QUEUE_BYTES:
            yield self._take(max(self.groups, key=lambda k: k[2] * len(self.groups[k])))

    def rest(self) -> Iterator[list[dict]]:
        for size in list(self.groups):
            yield self._take(size)


def _queued(batches: Iterator[pa.RecordBatch], queue: SizeQueue) -> Iterator[list[dict]]:
    """The rows of all batches in groups for the model; few rows are Python objects besides those that wait."""
    for batch in batches:
        for part in steps(batch):
            for row in part.to_pylist():
                yield from queue.add(row)
    yield from queue.rest()


def predict_images(images: DataFrame, make_predict: Callable[[], Predict], batch_size: int = 64, num_classes: int = NUM_CLASSES) -> DataFrame:
    """``images`` with ``logits``: the callable gets (N, H, W, 1) and gives (N, H, W, C). It is built once per task.

    A call takes up to ``batch_size`` images of one size, from wherever in the task they come (``SizeQueue``).
    """
    schema = StructType([*images.drop("logits").schema, StructField("logits", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        predict, queue = make_predict(), SizeQueue(batch_size, num_classes)
        for rows in _queued(batches, queue):
            scores = predict(np.stack([unpack(r) for r in rows])[..., None])
            queue.classes = scores.shape[-1]
            for a in range(0, len(rows), 4):
                yield pa.RecordBatch.from_pylist([r | {"logits": packed(x)} for r, x in zip(rows[a : a + 4], scores[a : a + 4], strict=True)], arrow)

    return images.mapInArrow(run, schema)


def fuse(scored: DataFrame, keys: list[str], values: str = "probs", num_classes: int | None = None) -> DataFrame:
    """Mean probabilities over all rows of ``keys`` (long form, arrays by class), clipped, as logarithms in ``fused``.

    One shuffle, with a partial mean for each class in the tasks before it. Arrays have any number of classes, all the
    same: it is read off the first row unless given, and another number in any row raises an error.
    """
    if num_classes is None:
        first = scored.where(F.col(values).isNotNull()).select(F.size(values)).first()
        num_classes = first[0] if first else NUM_CLASSES
    wrong = F.concat(F.lit(f"{values}: {num_classes} classes were expected, not "), F.size(values).cast("string"))
    rows = scored.where(F.when(F.size(values) == num_classes, True).when(F.col(values).isNull(), True).otherwise(F.raise_error(wrong).cast("boolean")))
    means = rows.groupBy(*keys).agg(*(F.avg(F.col(values)[c]).alias(f"p{c}") for c in range(num_classes)))
    out = means.select(*keys, F.array(*(F.col(f"p{c}") for c in range(num_classes))).alias("p"))
    return out.select(*keys, F.transform(clip_all(F.col("p"), LOW, HIGH), lambda v: F.log(v)).alias("fused"))


def fuse_tta(scored: DataFrame, values: str = "probs") -> DataFrame:
    return fuse(scored, ["image_id", "y", "x"], values)


def fuse_scales(scored: DataFrame, values: str = "probs") -> DataFrame:
    """The second level; its input are the softmaxes of the first level's logarithms, which are its means again."""
    return fuse(scored, ["image_id", "y", "x"], values)


def match_prediction_size(preds: DataFrame, truth: DataFrame, column: str = "probs") -> DataFrame:
    """Predictions resized to the size of their truth where it differs."""
    sized = preds.join(truth.select("image_id", F.col("height").alias("true_h"), F.col("width").alias("true_w")), "image_id")

    def one(row: dict) -> dict:
        scores = unpack(row, column)
        if scores.shape[:2] != (row["true_h"], row["true_w"]):
            scores = kernels.resize_bilinear(scores, row["true_h"], row["true_w"])
        return row | {column: packed(scores), "height": row["true_h"], "width": row["true_w"]}

    return map_rows(sized, one, sized.schema).drop("true_h", "true_w")


def model_input(images: np.ndarray, channels: int) -> np.ndarray:
    """(H, W, N, K) images with the model's channels: several are averaged to one, one is repeated; others stay.

    An image whose values exceed 1 is divided by 255; that is decided for each image alone.
    """
    if images.shape[-1] != channels and channels == 1:
        images = images.mean(axis=-1, keepdims=True)
    elif images.shape[-1] == 1 and channels > 1:
        images = np.repeat(images, channels, axis=-1)
    top = images.max(axis=(0, 1, 3), keepdims=True, initial=0.0)
    return np.where(top > 1.0, images / 255.0, images)


def _scores(stack: np.ndarray, predict: Predict, on_error: str, dtype: str, errors: list[str]) -> tuple[np.ndarray | None, np.ndarray]:
    """(H, W, N, C) predictions for (H, W, N, K) images in one call, and which succeeded.

    Where the call fails and ``on_error`` isn't ``fail``, each image is tried alone, so one bad image costs no other;
    ``errors`` keeps what was last said of each.
    """
    batch, n = np.ascontiguousarray(stack.transpose(2, 0, 1, 3)), stack.shape[2]
    try:
        return np.moveaxis(np.asarray(predict(batch), dtype), 0, 2), np.ones(n, bool)
    except Exception:
        if on_error == "fail":
            raise
    done: dict[int, np.ndarray] = {}
    for i in range(n):
        try:
            done[i] = np.asarray(predict(batch[i : i + 1]), dtype)[0]
        except Exception as e:
            errors[i] = f"{type(e).__name__}: {e}"
    good = np.isin(np.arange(n), list(done))
    return (np.stack([done.get(i, np.zeros_like(next(iter(done.values())))) for i in range(n)], axis=2), good) if done else (None, good)


def _tta(images: np.ndarray, predict: Predict, variants: list, on_error: str, dtype: str, errors: list[str]) -> tuple[np.ndarray | None, np.ndarray]:
    """Logarithms of the mean softmax over the variants for (H, W, N, K) images, and which have any prediction.

    Images of one size lie behind each other as channels, so flips, rotations and resizes run once for all of them.
    """
    h, w, n, k = images.shape
    total, count = None, np.zeros(n)
    flat = images.reshape(h, w, n * k)
    for kind, angle, scale in variants:
        scores, good = _scores(forward(flat, kind, angle, scale, (h, w)).reshape(h, w, n, k), predict, on_error, dtype, errors)
        if scores is None:
            continue
        c = scores.shape[-1]
        p = kernels.softmax(backward(scores.reshape(*scores.shape[:2], n * c), kind, angle, (h, w)).reshape(h, w, n, c))
        p *= good[:, None]
        total, count = (p if total is None else np.add(total, p, out=total)), count + good
    if total is not None:
        total /= np.maximum(count, 1)[:, None]
        np.log(np.clip(total, LOW, HIGH, out=total), out=total)
    return total, count > 0


def multi_scale_predict(
    images: DataFrame,
    make_predict: Callable[[], Predict],
    scales: tuple[float, ...] = EvalConfig.scales,
    tta: bool = True,
    model_size: tuple[int, int] | None = None,
    on_error: str = "fail",
    finish: Callable[[np.ndarray], np.ndarray] | None = None,
    channels: int = 1,
    batch_size: int = 64,
    num_classes: int = NUM_CLASSES,
    dtype: str = "<f8",
    score_bytes: int = SCORE_BYTES,
) -> DataFrame:
    """``(image_id, height, width, probs)``: all scales and variants of an image in one task, without a shuffle.

    Images get the model's ``channels`` and are brought to [0, 1] (``model_input``), then resized to the scaled size
    and on to the model's (their own if not given). Up to ``batch_size`` images of one size share a call of the model,
    as many as the scores of ``num_classes`` fit ``score_bytes``: 17 of 384 x 384 pixels with five classes, twice as many
    with ``dtype="<f4"``, which also halves the memory (about eight times ``score_bytes`` at the peak, of each task).
    With ``on_error="quarantine"`` failed variants are left out of the mean, and an image without any prediction gets
    null probabilities and what the model said in ``error``; class 0 is never invented. ``finish`` is applied to the
    probabilities.
    """
    variants = variant_list() if tta else [("original", None, None)]
    kind = images.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, height int, width int, probs binary, error string"

    def together(rows: list[dict], predict: Predict, queue: SizeQueue, errors: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size, n = (rows[0]["height"], rows[0]["width"]), len(rows)
        stack = model_input(np.stack([unpack(r).reshape(*size, -1) for r in rows], axis=2), channels).astype(dtype, copy=False)
        flat = stack.reshape(*size, -1)
        total, count = 0.0, np.zeros(n)
        for s in scales:
            scaled = kernels.resize_bilinear(flat, scaled_size(size[0], s), scaled_size(size[1], s))
            scaled = kernels.resize_bilinear(scaled, *(model_size or size))
            fused, good = _tta(scaled.reshape(*scaled.shape[:2], n, -1), predict, variants, on_error, dtype, errors)
            if fused is not None:
                queue.classes = c = fused.shape[-1]
                back = kernels.softmax(kernels.resize_bilinear(fused.reshape(*fused.shape[:2], n * c), *size).reshape(*size, n, c))
                back *= good[:, None]
                total, count = np.add(total, back, out=back), count + good
        return total, count

    def run(batches):
        predict = make_predict()
        queue = SizeQueue(batch_size, num_classes, np.dtype(dtype).itemsize, math.prod(model_size or (0,)), score_bytes)
        for rows in _queued(batches, queue):
            errors = ["no prediction"] * len(rows)
            total, count = together(rows, predict, queue, errors)
            for a in range(0, len(rows), 4):
                part = range(a, min(a + 4, len(rows)))
                made = [np.clip(total[:, :, i] / count[i], LOW, HIGH) if count[i] else None for i in part]
                made = [finish(p) if finish is not None and p is not None else p for p in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i]["image_id"] for i in part], arrow_id),
                        *(pa.array([rows[i][c] for i in part], pa.int32()) for c in ("height", "width")),
                        pa.array([None if p is None else packed(p) for p in made], pa.binary()),
                        pa.array([None if p is not None else errors[i] for i, p in zip(part, made, strict=True)], pa.string()),
                    ],
                    names=["image_id", "height", "width", "probs", "error"],
                )

    arrow_id = to_arrow_schema(images.select("image_id").schema).field(0).type
    return images.select("image_id", "height", "width", "pixels").mapInArrow(run, schema)


def argmax_labels(scored: DataFrame, column: str = "probs", out: str = "preds") -> DataFrame:
    """Packed scores as one byte per pixel; the scores are dropped."""
    schema = StructType([*scored.drop(column).schema, StructField(out, BinaryType())])

    def one(row: dict) -> dict:
        scores = row.pop(column)
        n = row["height"] * row["width"]
        return row | {out: packed(np.frombuffer(scores, "<f8").reshape(n, -1).argmax(axis=1), "u1")}

    return map_rows(scored, one, schema)


def from_log(values: Column, kind: str = "prob") -> Column:
    """Probabilities from ``prob`` as they are, or from ``log``."""
    return F.transform(values, lambda v: F.exp(v)) if kind == "log" else values
