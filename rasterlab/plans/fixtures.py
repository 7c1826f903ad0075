"""Labelled tiles, predictions, listings and score streams derived from the given tables by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterlab.functions.arrays import r6
from rasterlab.sources.packed import map_rows, packed, steps

SIDE = 8
#: Intensities at which the classes' scores peak.
CENTRES = (0.50, 0.25, 0.35, 0.88, 0.68)
WEIGHTS = [0.05, 0.25, 0.2, 0.4, 0.1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value(i: Column) -> Column:
    x = F.col("embedding")[i].cast("double") + 0.5
    return r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, x, v, v2)``: an 8 x 8 tile for each embedding; ``v2`` is the next pixel's value."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i"))
    return rows.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), _value(F.col("i")).alias("v"), _value((F.col("i") + 1) % (SIDE * SIDE)).alias("v2"))


def _classes(x: Column, ship: float, land: float, oil: float, lookalike: float) -> Column:
    return F.when(x >= ship, 3).when(x >= land, 4).when(x < oil, 1).when(x < lookalike, 2).otherwise(0)


def scored_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tiles`` with ``s``, ``true_class`` and ``pred_class``."""
    rows = tiles(spark, sf_dir).withColumn("s", 0.8 * F.col("v") + 0.2 * F.col("v2"))
    return rows.withColumn("true_class", _classes(F.col("v"), 0.80, 0.62, 0.30, 0.38)).withColumn("pred_class", _classes(F.col("s"), 0.76, 0.60, 0.33, 0.40))


def logits_of(x: Column) -> Column:
    return F.array(*(-40.0 * ((x - m) * (x - m)) for m in CENTRES))


def logit_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored_tiles`` with ``logits`` from ``s``."""
    return scored_tiles(spark, sf_dir).withColumn("logits", logits_of(F.col("s")))


def _tile_values(lists: pa.Array) -> np.ndarray:
    x = np.asarray(lists.flatten(), np.float64).reshape(len(lists), SIDE * SIDE) + 0.5
    return np.floor(np.clip(x, 0.0, 1.0) * 1e6 + 0.5) / 1e6


def packed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, height, width, pixels, labels, preds, mask, probs)``: the same tiles, one row each.

    ``probs`` are the softmax of the logits, ``mask`` is ``v >= 0.5``.
    """

    def run(batches):
        for batch in (part for whole in batches for part in steps(whole)):
            v = _tile_values(batch["embedding"])
            s = 0.8 * v + 0.2 * np.roll(v, -1, axis=1)
            pick = lambda x, a, b, c, d: np.select([x >= a, x >= b, x < c, x < d], [3, 4, 1, 2], 0).astype(np.uint8)
            logits = -40.0 * (s[..., None] - np.array(CENTRES)) ** 2
            e = np.exp(logits - logits.max(axis=-1, keepdims=True))
            probs = e / e.sum(axis=-1, keepdims=True)
            n = batch.num_rows
            data = {"pixels": v, "labels": pick(v, 0.80, 0.62, 0.30, 0.38), "preds": pick(s, 0.76, 0.60, 0.33, 0.40), "mask": (v >= 0.5).astype(np.uint8), "probs": probs}
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(np.full(n, SIDE, np.int32)), pa.array(np.full(n, SIDE, np.int32)), *(pa.array([x.tobytes() for x in d], pa.binary()) for d in data.values())],
                names=["image_id", "height", "width", *data],
            )

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "image_id long, height int, width int, pixels binary, labels binary, preds binary, mask binary, probs binary")


def mosaic_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed_tiles`` as 4 x 4 tiles of scenes of 32 x 32 pixels, with their places in the scene. A scene whose ids
    aren't all there has holes."""
    k = F.col("image_id") % 16
    place = {"ty": F.floor(k / 4).cast("int"), "tx": (k % 4).cast("int"), "top": (F.floor(k / 4) * SIDE).cast("int"), "left": (k % 4 * SIDE).cast("int"), "image_id": F.floor(F.col("image_id") / 16)}
    return packed_tiles(spark, sf_dir).withColumns(place)


def whole_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, height, width, pixels)`` of the scenes, put together from their 16 tiles; an unfinished last row of
    tiles is left out."""
    at = F.sort_array(F.collect_list(F.struct("top", "left", "pixels"))).alias("tiles")
    rows = mosaic_tiles(spark, sf_dir).groupBy("image_id").agg(at).where(F.size("tiles") % 4 == 0)

    def one(row: dict) -> dict:
        grid = np.stack([np.frombuffer(t["pixels"], "<f8").reshape(SIDE, SIDE) for t in row["tiles"]]).reshape(-1, 4, SIDE, SIDE)
        image = grid.transpose(0, 2, 1, 3).reshape(-1, 4 * SIDE)
        return {"image_id": row["image_id"], "height": len(image), "width": 4 * SIDE, "pixels": packed(image)}

    return map_rows(rows, one, "image_id long, height int, width int, pixels binary")


def line_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, true_class, pred_class)``: a row of the largest table for each pixel."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_discount").cast("double") > 0.07).cast("int").alias("off"))
    return rows.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 5).cast("int").alias("true_class"), ((F.col("l_partkey") + F.col("off")) % 5).cast("int").alias("pred_class"))


def event_scores(events: DataFrame, *more: Column | str) -> DataFrame:
    """``(ts, true_class, pred_class)`` of a stream or table of events, with ``more`` of its columns."""
    kinds = F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view")))
    true = (F.array_position(kinds, F.col("event_type")) - 1).cast("int")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), true.alias("true_class"), ((true + (F.col("value") > 80).cast("int")) % 5).alias("pred_class"), *more)


def listing(spark: SparkSession, sf_dir: str, folder: str = "images", extension: str = "jpg", orphans: bool = False) -> DataFrame:
    """``(path)`` of an image or mask for each embedding; with ``orphans`` every 97th is missing."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    rows = rows.where(F.col("vec_id") % 97 != 0) if orphans else rows
    return rows.select(F.concat(F.lit(f"{folder}/img_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(f".{extension}")).alias("path"))


#: The same tables in SQL, to be put in front of a query.
_V = "floor(greatest(0.0, least(1.0, CAST(embedding[{} + 1] AS DOUBLE) + 0.5)) * 1e6 + 0.5) / 1e6 + 0.0"
_CASE = "CAST(CASE WHEN {x} >= {a} THEN 3 WHEN {x} >= {b} THEN 4 WHEN {x} < {c} THEN 1 WHEN {x} < {d} THEN 2 ELSE 0 END AS INTEGER)"
_TRUE = _CASE.format(x="v", a=0.80, b=0.62, c=0.30, d=0.38)
_PRED = _CASE.format(x="s", a=0.76, b=0.60, c=0.33, d=0.40)


def logits_sql(x: str) -> str:
    return "[" + ", ".join(f"CAST(-40.0 AS DOUBLE) * (({x} - {m}) * ({x} - {m}))" for m in CENTRES) + "]"


def softmax_sql(logits: str) -> str:
    e = f"list_transform({logits}, lambda q: exp(q - list_max({logits})))"
    return f"list_transform({e}, lambda w: w / list_sum({e}))"


CTES = f"""WITH RECURSIVE
tiles AS (SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {_V.format("i")} AS v, {_V.format("((i + 1) % 64)")} AS v2
    FROM embeddings, range(64) r(i)),
scored AS (SELECT *, {_TRUE} AS true_class, {_PRED} AS pred_class FROM (SELECT *, CAST(0.8 AS DOUBLE) * v + CAST(0.2 AS DOUBLE) * v2 AS s FROM tiles)),
logit AS (SELECT *, {logits_sql("s")} AS logits, {logits_sql("v")} AS logits2 FROM scored),
probs AS (SELECT image_id, y, x, v, s, true_class, pred_class, {softmax_sql("logits")} AS p FROM logit),
mask AS (SELECT image_id, y, x, CAST(v >= 0.5 AS INTEGER) AS m FROM tiles),
mosaic AS (SELECT image_id // 16 AS image_id, CAST(8 * (image_id % 16 // 4) + y AS INTEGER) AS y, CAST(8 * (image_id % 4) + x AS INTEGER) AS x, v, p FROM probs),
line AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 5 AS INTEGER) AS true_class, CAST((l_partkey + CASE WHEN CAST(l_discount AS DOUBLE) > 0.07 THEN 1 ELSE 0 END) % 5 AS INTEGER) AS pred_class FROM lineitem),
confusion AS (SELECT true_class, pred_class, count(*) AS n FROM scored GROUP BY 1, 2),
ids AS (SELECT unnest(range(5)) AS c),
totals AS (SELECT CAST(c AS INTEGER) AS class_id, CAST(coalesce(sum(CASE WHEN true_class = c AND pred_class = c THEN n END), 0) AS BIGINT) AS tp,
    CAST(coalesce(sum(CASE WHEN true_class = c THEN n END), 0) AS BIGINT) AS true_n, CAST(coalesce(sum(CASE WHEN pred_class = c THEN n END), 0) AS BIGINT) AS pred_n FROM ids, confusion GROUP BY 1),
iou AS (SELECT *, CASE WHEN true_n + pred_n - tp > 0 THEN CAST(tp AS DOUBLE) / (true_n + pred_n - tp) ELSE 0.0 END AS iou FROM totals),
images AS (SELECT 'images/img_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.jpg' AS path, 'img_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS stem, vec_id FROM embeddings),
placed AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS position, count(*) OVER () AS n FROM images),
scores AS (SELECT *, (true_class + CASE WHEN value > 80 THEN 1 ELSE 0 END) % 5 AS pred_class FROM (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS true_class FROM events))
"""
