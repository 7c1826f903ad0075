"""Defaults of the operators, as plain dataclasses, and the class table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Class names in order of their ids, and published IoU of a baseline model in percent.
CLASS_NAMES = ("Sea Surface", "Oil Spill", "Look-alike", "Ship", "Land")
BASELINE_IOU = (96.43, 53.38, 55.40, 27.63, 92.44)
NUM_CLASSES = len(CLASS_NAMES)
OIL, LOOKALIKE, SHIP = 1, 2, 3


@dataclass(frozen=True)
class DataConfig:
    size: int = 384
    val_split: float = 0.15
    batch_size: int = 16


@dataclass(frozen=True)
class AugmentConfig:
    p_flip_h: float = 0.5
    p_flip_v: float = 0.3
    max_rotation: float = math.radians(15.0)
    p_rot90: float = 0.2
    speckle_sigma: float = 0.15
    p_speckle: float = 0.7
    p_brightness: float = 0.4
    brightness: float = 0.2
    p_contrast: float = 0.4
    contrast: tuple[float, float] = (0.8, 1.2)
    p_gamma: float = 0.3
    gamma: tuple[float, float] = (0.7, 1.5)
    p_blur: float = 0.2
    blur_sigma: tuple[float, float] = (0.5, 1.5)
    p_cutout: float = 0.3
    cutout_size: tuple[float, float] = (0.05, 0.15)
    cutout_patches: int = 3


@dataclass(frozen=True)
class LossConfig:
    ce: float = 0.35
    focal: float = 0.25
    dice: float = 0.30
    boundary: float = 0.10
    lovasz: float = 0.0
    gamma: float = 2.0
    smoothing: float = 0.1
    boundary_boost: float = 2.5
    epsilon: float = 1e-7


@dataclass(frozen=True)
class EvalConfig:
    scales: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5)
    scales_plain: tuple[float, ...] = (0.75, 1.0, 1.25)
    tta_variants: int = 8
    ship_threshold: float = 0.25
    ship_min_size: int = 8
    ship_boost: float = 1.35
    lookalike_factor: float = 0.7
    bootstrap: int = 1000
    confidence: float = 0.95


def classes(spark: SparkSession) -> DataFrame:
    """``(class_id, class_name)``; a handful of rows."""
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, class_name string")


def baseline(spark: SparkSession) -> DataFrame:
    """``(class_id, class_name, iou)`` of the published baseline, in percent."""
    rows = [(i, n, v) for i, (n, v) in enumerate(zip(CLASS_NAMES, BASELINE_IOU, strict=True))]
    return spark.createDataFrame(rows, "class_id int, class_name string, iou double")
