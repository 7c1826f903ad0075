"""Evaluation from confusion counts: everything after the first reduction works on a few rows per image or in all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlab.config import NUM_CLASSES, EvalConfig, baseline, classes
from rasterlab.functions import keyed
from rasterlab.sources.packed import steps


def confusion_matrix(pixels: DataFrame, by: list[str] | None = None, true: str = "true_class", pred: str = "pred_class") -> DataFrame:
    """``(by..., true_class, pred_class, n)`` of one row per pixel, in exact 64-bit counts."""
    keys = [*(by or []), F.col(true).cast("int").alias("true_class"), F.col(pred).cast("int").alias("pred_class")]
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"))


def confusion_per_image(scored: DataFrame, num_classes: int = NUM_CLASSES, key: str = "image_id") -> DataFrame:
    """The same for each row of packed ``labels`` and ``preds``: counted in the task, without a shuffle."""
    kind = scored.schema[key].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in steps(whole)):
            owner, cells, counts = [], [], []
            for i in range(batch.num_rows):
                t, p = (np.frombuffer(batch[c][i].as_py(), np.uint8).astype(np.int64) for c in ("labels", "preds"))
                n = np.bincount(t * num_classes + p, minlength=num_classes**2)
                on = np.flatnonzero(n)
                owner.append(np.full(len(on), i))
                cells.append(on)
                counts.append(n[on])
            if owner:
                cell = np.concatenate(cells)
                yield pa.RecordBatch.from_arrays(
                    [batch[key].take(pa.array(np.concatenate(owner))), pa.array((cell // num_classes).astype(np.int32)), pa.array((cell % num_classes).astype(np.int32)), pa.array(np.concatenate(counts))],
                    names=[key, "true_class", "pred_class", "n"],
                )

    return scored.select(key, "labels", "preds").mapInArrow(run, f"{key} {kind}, true_class int, pred_class int, n long")


def confusion_packed(scored: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """Over all packed rows: a task adds its images up first, so it shuffles a row per cell at most."""

    def run(batches):
        total = np.zeros(num_classes**2, np.int64)
        for batch in batches:
            for t, p in zip(batch["labels"], batch["preds"], strict=True):
                total += np.bincount(np.frombuffer(t.as_py(), np.uint8).astype(np.int64) * num_classes + np.frombuffer(p.as_py(), np.uint8), minlength=num_classes**2)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((on // num_classes).astype(np.int32)), pa.array((on % num_classes).astype(np.int32)), pa.array(total[on])], names=["true_class", "pred_class", "n"])

    return total_confusion(scored.select("labels", "preds").mapInArrow(run, "true_class int, pred_class int, n long"))


def total_confusion(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    return confusion.groupBy(*(by or []), "true_class", "pred_class").agg(F.sum("n").alias("n"))


def confusion_dense(confusion: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """All cells, zeros included."""
    cells = confusion.sparkSession.range(num_classes**2).select(F.floor(F.col("id") / num_classes).cast("int").alias("true_class"), (F.col("id") % num_classes).cast("int").alias("pred_class"))
    return cells.join(F.broadcast(confusion), ["true_class", "pred_class"], "left").select("true_class", "pred_class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_wide(confusion: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """A row per true class, a column ``p0, p1, ...`` per predicted class."""
    wide = confusion_dense(confusion, num_classes).groupBy("true_class").pivot("pred_class", list(range(num_classes))).sum("n")
    return wide.select("true_class", *(F.col(str(c)).alias(f"p{c}") for c in range(num_classes)))


def class_totals(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., class_id, tp, true_n, pred_n)``: both margins in one aggregation."""
    sides = F.array(
        F.struct(F.col("true_class").alias("class_id"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred_class").alias("class_id"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
    )
    hit = F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)
    rows = confusion.select(*(by or []), hit.alias("hit"), F.explode(sides).alias("s"))
    return rows.groupBy(*(by or []), F.col("s.class_id").alias("class_id")).agg(
        F.sum(F.when(F.col("s.t") > 0, F.col("hit")).otherwise(0)).cast("long").alias("tp"), F.sum("s.t").alias("true_n"), F.sum("s.p").alias("pred_n")
    )


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_iou(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., class_id, tp, true_n, pred_n, iou)``; 0 where the union is empty."""
    tp, t, p = F.col("tp"), F.col("true_n"), F.col("pred_n")
    return class_totals(confusion, by).withColumn("iou", _ratio(tp, t + p - tp))


def mean_iou(confusion: DataFrame, mean_over: str = "truth", by: list[str] | None = None) -> DataFrame:
    """``(by..., miou)``: over the classes that occur in the truth, or (``union``) in truth or prediction; 0 if none."""
    counted = {"truth": F.col("true_n") > 0, "union": F.col("true_n") + F.col("pred_n") > 0}[mean_over]
    return class_iou(confusion, by).groupBy(*(by or [])).agg(F.coalesce(F.avg(F.when(counted, F.col("iou"))), F.lit(0.0)).alias("miou"))


def precision_recall_f1(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., class_id, precision, recall, f1)``; 0 where a denominator is 0."""
    rows = class_totals(confusion, by).withColumn("precision", _ratio(F.col("tp"), F.col("pred_n"))).withColumn("recall", _ratio(F.col("tp"), F.col("true_n")))
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select(*(by or []), "class_id", "precision", "recall", f1.alias("f1"))


def pixel_accuracy(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    hit = F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0))
    return confusion.groupBy(*(by or [])).agg((hit / (F.coalesce(F.sum("n"), F.lit(0)) + 1e-12)).alias("accuracy"))


def frequency_weighted_iou(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    rows = class_iou(confusion, by)
    return rows.groupBy(*(by or [])).agg((F.sum(F.col("true_n") * F.col("iou")) / (F.sum("true_n") + 1e-12)).alias("fwiou"))


def cohens_kappa(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Agreement beyond chance; 0 without pixels, 1 where chance agrees fully."""
    rows = class_totals(confusion, by).groupBy(*(by or [])).agg(F.sum("tp").cast("double").alias("hit"), F.sum("true_n").cast("double").alias("n"), F.sum(F.col("true_n").cast("double") * F.col("pred_n")).alias("chance"))
    po, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    kappa = F.when(F.coalesce(F.col("n"), F.lit(0.0)) == 0, 0.0).when(pe >= 1.0, 1.0).otherwise((po - pe) / (1.0 - pe))
    return rows.select(*(by or []), kappa.alias("kappa"))


class SplitDraws:
    """How often each of ``n`` images is drawn in ``n`` draws with replacement, for all replicates at once.

    A range of images is halved: of the draws that fall into it, a binomial number falls into its first half. The draw of
    a range is keyed by the range, so every task finds the counts of its own images by going down to them, and all find
    the same. The way down to the last image is kept; ascending images share most of it.
    """

    def __init__(self, n: int, replicates: int, seed: int):
        self.seed = seed
        self.path = [(0, n, np.full(replicates, n, np.int64), None)]

    def times(self, i: int) -> np.ndarray:
        while not self.path[-1][0] <= i < self.path[-1][1]:
            self.path.pop()
        while (top := self.path[-1])[1] - top[0] > 1:
            low, high, draws, first = top
            middle = (low + high) // 2
            if first is None:
                first = keyed.generator("split", f"{low}_{high}", self.seed, 0).binomial(draws, (middle - low) / (high - low))
                self.path[-1] = (low, high, draws, first)
            self.path.append((low, middle, first, None) if i < middle else (middle, high, draws - first, None))
        return self.path[-1][2]


def _weighted_counts(per_image: DataFrame, key: str, replicates: int, make_times: Callable[[], Callable[[object], np.ndarray]]) -> DataFrame:
    """``(replicate, true_class, pred_class, n)``: every image's counts times its weight in each replicate.

    Added up in the tasks: a task sends one matrix of replicates by cells.
    """

    def run(batches):
        times_of = make_times()
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            places: dict = {}
            row = np.array([places.setdefault(x, len(places)) for x in batch[key].to_pylist()], np.int64)
            cells, column = np.unique(batch["true_class"].to_numpy().astype(np.int64) * 4096 + batch["pred_class"].to_numpy(), return_inverse=True)
            images = list(places)
            for a in range(0, len(images), 1024):  # so many rows of draws at once
                part = images[a : a + 1024]
                on = (row >= a) & (row < a + len(part))
                counts = np.zeros((len(part), len(cells)))
                np.add.at(counts, (row[on] - a, column[on]), batch["n"].to_numpy()[on])
                for c, n in zip(cells.tolist(), counts.T @ np.stack([times_of(x) for x in part]), strict=True):
                    total[c] = total.get(c, 0) + n
        for c, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(np.full(replicates, c // 4096, np.int32)), pa.array(np.full(replicates, c % 4096, np.int32)), pa.array(n.astype(np.int64))], names=["replicate", "true_class", "pred_class", "n"])

    parts = per_image.select(key, "true_class", "pred_class", "n").mapInArrow(run, "replicate int, true_class int, pred_class int, n long")
    return parts.groupBy("replicate", "true_class", "pred_class").agg(F.sum("n").alias("n")).where("n > 0")


def bootstrap_replicates(per_image: DataFrame, replicates: int = EvalConfig.bootstrap, mode: str = "exact", seed: int = 42, key: str = "image_id") -> DataFrame:
    """``(replicate, miou)`` over resampled images; ``per_image`` is ``confusion_per_image``'s table.

    ``exact`` draws as many images as there are, with replacement, by keyed draws over their order by ``key``; it makes
    replicates times images rows, for SQL and for small sets. ``split`` has the same distribution without a row per
    draw: each task finds how often its own images are drawn (``SplitDraws``), whatever the partitioning. ``poisson``
    weighs every image by a Poisson(1) count for each replicate, keyed by image, without an order of the images.
    """
    spark = per_image.sparkSession
    if mode in ("exact", "split"):
        from rasterlab.sources.files import position

        ids = position(per_image.select(F.format_string("%020d", F.col(key).cast("long")).alias("order"), key).distinct(), "order")
        n = ids.count()
    if mode == "exact":
        draws = spark.range(replicates * n).select(F.floor(F.col("id") / n).cast("int").alias("replicate"), (F.col("id") % n).alias("i"))
        draws = draws.withColumn("position", F.floor(keyed.uniform("bootstrap", F.concat_ws("_", "replicate", "i"), seed) * n).cast("long"))
        weights = draws.groupBy("replicate", "position").agg(F.count("*").alias("times")).join(ids.select("position", key), "position")
        drawn = weights.join(per_image, key).groupBy("replicate", "true_class", "pred_class").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    elif mode == "split":
        placed = per_image.join(ids.select(key, "position"), key).repartitionByRange("position").sortWithinPartitions("position")
        drawn = _weighted_counts(placed, "position", replicates, lambda: SplitDraws(n, replicates, seed).times)
    elif mode == "poisson":
        drawn = _weighted_counts(per_image, key, replicates, lambda: lambda x: keyed.generator("poisson", x, seed, 0).poisson(1.0, replicates))
    else:
        raise ValueError(f"mode: {mode}")
    return mean_iou(drawn, "truth", ["replicate"])


def bootstrap_ci(replicates: DataFrame, confidence: float = EvalConfig.confidence, value: str = "miou") -> DataFrame:
    """``(ci_low, ci_high)``: exact percentiles with linear interpolation."""
    alpha = 1.0 - confidence
    return replicates.agg(F.percentile(value, alpha / 2).alias("ci_low"), F.percentile(value, 1 - alpha / 2).alias("ci_high"))


def class_report(confusion: DataFrame, num_classes: int = NUM_CLASSES) -> DataFrame:
    """``(class_id, class_name, iou, precision, recall, f1)`` in percent, every class."""
    rows = class_iou(confusion).join(precision_recall_f1(confusion), "class_id")
    named = classes(confusion.sparkSession).where(F.col("class_id") < num_classes)
    pct = lambda c: (100.0 * F.coalesce(c, F.lit(0.0))).alias(c)
    return named.join(F.broadcast(rows), "class_id", "left").select("class_id", "class_name", pct("iou"), pct("precision"), pct("recall"), pct("f1"))


def summary(confusion: DataFrame) -> DataFrame:
    """``(metric, value)``: everything in percent but kappa. ``confusion`` is small; persist it first."""
    parts = [
        mean_iou(confusion, "truth").select(F.lit("mean_iou").alias("metric"), (100 * F.col("miou")).alias("value")),
        mean_iou(confusion, "union").select(F.lit("mean_iou_union"), 100 * F.col("miou")),
        pixel_accuracy(confusion).select(F.lit("pixel_accuracy"), 100 * F.col("accuracy")),
        frequency_weighted_iou(confusion).select(F.lit("fw_iou"), 100 * F.col("fwiou")),
        cohens_kappa(confusion).select(F.lit("kappa"), F.col("kappa")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def evaluate(per_image: DataFrame, replicates: int = 0, mode: str = "split", cfg: EvalConfig = EvalConfig()) -> tuple[DataFrame, DataFrame]:
    """The summary (with the bootstrap interval if ``replicates``) and the class report of per-image counts.

    The counts are added up once, at the call.
    """
    counts = total_confusion(per_image)
    total = per_image.sparkSession.createDataFrame(counts.collect(), counts.schema)  # a row per pair of classes
    table = summary(total)
    if replicates:
        ci = bootstrap_ci(bootstrap_replicates(per_image, replicates, mode), cfg.confidence)
        table = table.union(ci.select(F.expr("stack(2, 'ci_low', 100 * ci_low, 'ci_high', 100 * ci_high) AS (metric, value)")))
    return table, class_report(total)


def compare_to_baseline(report: DataFrame) -> DataFrame:
    """``(class_name, model_iou, baseline_iou, delta)`` for every class and their mean."""
    spark: SparkSession = report.sparkSession
    rows = report.select("class_id", F.col("iou").alias("model_iou")).join(F.broadcast(baseline(spark)), "class_id").select("class_name", "model_iou", F.col("iou").alias("baseline_iou"))
    mean = rows.agg(F.lit("mean").alias("class_name"), F.avg("model_iou").alias("model_iou"), F.avg("baseline_iou").alias("baseline_iou"))
    return rows.union(mean).withColumn("delta", F.col("model_iou") - F.col("baseline_iou"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(class_id, class_name, iou_a, iou_b, improvement)`` of two confusion tables."""
    x, y = class_iou(a).select("class_id", F.col("iou").alias("iou_a")), class_iou(b).select("class_id", F.col("iou").alias("iou_b"))
    both = x.join(y, "class_id", "full").na.fill(0.0)
    return both.join(F.broadcast(classes(a.sparkSession)), "class_id").select("class_id", "class_name", "iou_a", "iou_b", (F.col("iou_a") - F.col("iou_b")).alias("improvement"))
