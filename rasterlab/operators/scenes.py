"""Filters and ship refinement of scenes larger than a row, kept as tiles.

A tile is ``image_id, ty, tx, top, left, height, width`` and packed columns, without halo; ``top`` and ``left`` are its
first pixel in the scene. Tiles of a scene are a full grid of squares of one size, smaller only at the bottom and right;
with ``holes`` some may be missing (an unfinished scene), and their pixels count as outside of it. Without, a missing
tile is an error.
A filter that looks ``halo`` pixels around gets them by one exchange: each tile sends the strips along its borders to
its neighbours, keyed by the neighbour's place. Tiles stored by ``store_tiles`` lie in buckets of that key, so that the
strips come to them and their own pixels aren't shuffled, whatever filters follow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from rasterlab.config import LOOKALIKE, SHIP, EvalConfig
from rasterlab.functions import kernels
from rasterlab.operators.postproc import scene_labels
from rasterlab.sources.folders import bucketed, written
from rasterlab.sources.packed import map_rows, packed, steps, unpack

KEY = ["image_id", "ty", "tx"]
PLACE = [*KEY, "top", "left", "height", "width"]
#: Filters get the extended arrays of a tile, by name, and ``inside`` (where the scene has pixels), and give arrays of the
#: same size.
Filter = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def store_tiles(tiles: DataFrame) -> DataFrame:
    """``tiles`` written once in buckets of their place: later exchanges and joins by place don't shuffle them."""
    return bucketed(tiles, *KEY)


def border_strips(tiles: DataFrame, columns: dict[str, str], size: int, halo: int) -> DataFrame:
    """``(image_id, ty, tx, strips)``: for each place, what its neighbours have of its surroundings.

    A strip is ``y, x, height, width`` in the scene and the packed columns. A neighbour is any tile within ``halo``
    pixels, so there are eight, or more where tiles are smaller than the halo. Only strips are shuffled.
    """
    kinds = StructType([tiles.schema[c] for c in KEY] + [StructField(n, tiles.schema["top"].dataType) for n in ("y", "x", "h", "w")] + [StructField(c, BinaryType()) for c in columns])
    arrow = to_arrow_schema(kinds)
    reach = -(-halo // size)
    offsets = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy or dx]

    def overlap(begin: int, length: int, place: int) -> tuple[int, int]:
        """The part of a tile's rows or columns that lies within the halo of the tile at ``place``."""
        return max(begin, place * size - halo), min(begin + length, (place + 1) * size + halo)

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                out = []
                for row in part.to_pylist():
                    arrays = {c: unpack(row, c, d) for c, d in columns.items()}
                    for dy, dx in offsets:
                        ty, tx = row["ty"] + dy, row["tx"] + dx
                        (y0, y1), (x0, x1) = overlap(row["top"], row["height"], ty), overlap(row["left"], row["width"], tx)
                        if ty >= 0 and tx >= 0 and y0 < y1 and x0 < x1:
                            inside = np.s_[y0 - row["top"] : y1 - row["top"], x0 - row["left"] : x1 - row["left"]]
                            out.append({"image_id": row["image_id"], "ty": ty, "tx": tx, "y": y0, "x": x0, "h": y1 - y0, "w": x1 - x0} | {c: packed(a[inside], columns[c]) for c, a in arrays.items()})
                yield pa.RecordBatch.from_pylist(out, arrow)

    sent = tiles.select(*PLACE, *columns).mapInArrow(run, kinds)
    strip = F.struct("y", "x", F.col("h").alias("height"), F.col("w").alias("width"), *columns)
    return sent.groupBy(*KEY).agg(F.collect_list(strip).alias("strips"))


def _extended(row: dict, columns: dict[str, str], holes: bool) -> tuple[dict[str, np.ndarray], tuple[slice, slice]]:
    """The tile with what its neighbours sent, and where it lies therein. At the scene's edges there is no more."""
    pieces = [{"y": row["top"], "x": row["left"], **{c: row[c] for c in ("height", "width", *columns)}}, *(row["strips"] or [])]
    y0, x0 = min(p["y"] for p in pieces), min(p["x"] for p in pieces)
    h, w = max(p["y"] + p["height"] for p in pieces) - y0, max(p["x"] + p["width"] for p in pieces) - x0
    if not holes and sum(p["height"] * p["width"] for p in pieces) != h * w:
        raise ValueError(f"scene {row['image_id']} isn't a full grid of tiles around row {row['ty']}, column {row['tx']}")
    inside = np.zeros((h, w), bool)
    for p in pieces:
        inside[p["y"] - y0 : p["y"] - y0 + p["height"], p["x"] - x0 : p["x"] - x0 + p["width"]] = True
    out = {"inside": inside}
    for c, dtype in columns.items():
        for p in pieces:
            part = unpack(p, c, dtype)
            if c not in out:
                out[c] = np.zeros((h, w, *part.shape[2:]), part.dtype)
            out[c][p["y"] - y0 : p["y"] - y0 + p["height"], p["x"] - x0 : p["x"] - x0 + p["width"]] = part
    return out, np.s_[row["top"] - y0 : row["top"] - y0 + row["height"], row["left"] - x0 : row["left"] - x0 + row["width"]]


def map_tiles(tiles: DataFrame, fn: Filter, columns: dict[str, str], out: dict[str, str], size: int, halo: int, holes: bool = False) -> DataFrame:
    """``tiles`` with the packed columns ``out`` (name to dtype) that ``fn`` makes of ``columns`` and ``halo`` pixels
    around them; pixels further than that must not matter. Other columns stay, columns of these names are replaced.
    Pixels of missing tiles are zero, or an error without ``holes``."""
    schema = StructType([*tiles.drop(*out).schema, *(StructField(c, BinaryType()) for c in out)])
    joined = tiles.join(border_strips(tiles, columns, size, halo).hint("shuffle_hash"), KEY, "left")

    def one(row: dict) -> dict:
        arrays, own = _extended(row, columns, holes)
        made = fn(arrays)
        return {f: row[f] for f in schema.names if f not in out} | {c: packed(made[c][own], d) for c, d in out.items()}

    return map_rows(joined, one, schema)


def scene_blur(tiles: DataFrame, sigma: float, size: int, column: str = "pixels", holes: bool = False) -> DataFrame:
    """The 5x5 Gaussian over whole scenes; only the scene's own edges darken."""
    return map_tiles(tiles, lambda a: {column: kernels.blur(a[column], sigma, a["inside"])}, {column: "<f8"}, {column: "<f8"}, size, 2, holes)


def scene_sobel(tiles: DataFrame, size: int, column: str = "plane", holes: bool = False) -> DataFrame:
    return map_tiles(tiles, lambda a: {column: kernels.sobel(a[column])}, {column: "<f8"}, {column: "<f8"}, size, 1, holes)


def _on_masks(tiles: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, halo: int, holes: bool) -> DataFrame:
    return map_tiles(tiles, lambda a: {"mask": fn(a["mask"].astype(bool), a["inside"])}, {"mask": "u1"}, {"mask": "u1"}, size, halo, holes)


def scene_open(tiles: DataFrame, size: int, k: int = 2, holes: bool = False) -> DataFrame:
    return _on_masks(tiles, lambda m, inside: kernels.morph_open(m, k, inside), size, 2 * (k // 2), holes)


def scene_close(tiles: DataFrame, size: int, k: int = 5, holes: bool = False) -> DataFrame:
    return _on_masks(tiles, lambda m, inside: kernels.morph_close(m, k, inside), size, 2 * (k // 2), holes)


#: Names of the components' places: no scene has so many columns.
STRIDE = 1 << 31


def scene_dilate_small(tiles: DataFrame, size: int, min_size: int = EvalConfig.ship_min_size, holes: bool = False) -> DataFrame:
    """``tiles`` with ``mask``: components of the whole scene with at least ``min_size`` pixels, small ones dilated.

    The areas of the components, however many tiles they reach over, come back to the tiles that hold a part, one row
    per tile component. Dilation then reaches four pixels over the borders.
    """
    tiles = written(tiles)
    labels = written(scene_labels(tiles, STRIDE))
    areas = labels.groupBy("image_id", "comp_id").agg(F.sum("n").alias("area"))
    known = labels.join(areas, ["image_id", "comp_id"]).groupBy("image_id", "top", "left").agg(F.collect_list(F.struct("c", "area")).alias("areas"))

    def sized(row: dict) -> dict:
        local = kernels.components(unpack(row, "mask", "u1").astype(bool))
        place = (local // row["width"] + row["top"]) * STRIDE + local % row["width"] + row["left"]
        area = {a["c"]: a["area"] for a in row.pop("areas") or []}
        ids, inverse = np.unique(np.where(local >= 0, place, -1), return_inverse=True)
        of = np.array([0 if i < 0 else area[i] for i in ids.tolist()], np.int64)[inverse].reshape(local.shape)
        return row | {"mask": packed(kernels.growth(of, min_size), "u1")}

    steps_of = written(map_rows(tiles.join(known, ["image_id", "top", "left"], "left").select(*tiles.columns, "areas"), sized, tiles.schema))
    return map_tiles(steps_of, lambda a: {"mask": kernels.grown(a["mask"])}, {"mask": "u1"}, {"mask": "u1"}, size, 4, holes)


def scene_ship_enhancement(tiles: DataFrame, size: int, cfg: EvalConfig = EvalConfig(), column: str = "probs", holes: bool = False) -> DataFrame:
    """The ship refinement of whole scenes of probabilities, as ``postproc.ship_enhancement`` does for a row.

    Probabilities are read twice, for the mask and at the end, and shuffled only if ``tiles`` aren't stored. What moves
    between is the mask, a byte per pixel. Scenes without a ship pixel stay as they are.
    """

    def ships(row: dict) -> dict:
        mask = unpack(row, column)[..., SHIP] > cfg.ship_threshold
        return {c: row[c] for c in PLACE} | {"any": bool(mask.any()), "mask": packed(mask, "u1")}

    kinds = StructType([*tiles.select(*PLACE).schema, *StructType.fromDDL("any boolean, mask binary")])
    found = written(map_rows(tiles.select(*PLACE, column), ships, kinds))
    clean = _on_masks(found.drop("any"), lambda m, inside: kernels.morph_close(kernels.morph_open(m, inside=inside), inside=inside), size, 6, holes)
    refined = scene_dilate_small(clean, size, cfg.ship_min_size, holes).select(*KEY, F.col("mask").alias("refined"))
    touched = found.groupBy("image_id").agg(F.max("any").alias("touched"))
    refined = refined.join(touched, "image_id")

    def boosted(row: dict) -> dict:
        probs, mask, on = unpack(row, column), np.frombuffer(row.pop("refined"), "u1"), row.pop("touched")
        if on:
            row[column] = packed(kernels.boosted(probs, mask.reshape(probs.shape[:2]).astype(bool), SHIP, LOOKALIKE, cfg.ship_boost, cfg.lookalike_factor))
        return row

    return map_rows(tiles.join(refined.hint("shuffle_hash"), KEY).select(*tiles.columns, "refined", "touched"), boosted, tiles.schema)
