"""Packed images (one row each, pixels as bytes) and the long form (one row per pixel)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes and rows of a batch that become Python objects at once, and pixels of the long form that are handed on at once.
STEP_BYTES, STEP_ROWS, STEP_PIXELS = 8 << 20, 512, 1 << 16


def steps(batch: pa.RecordBatch, limit: int = STEP_BYTES, most: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in parts of about ``limit`` bytes and ``most`` rows at most, one row at least."""
    rows = max(1, min(most, batch.num_rows * limit // max(1, batch.nbytes)))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to every row inside Arrow batches, without a shuffle.

    STEP_ROWS rows of about STEP_BYTES become Python objects at once, and rows are handed on whenever about STEP_BYTES of packed
    columns are made, as ``fn`` may make large images of small ones. ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds
    the batches that Spark sends; 16 to 64 suits large images.
    """
    types = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(types)

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                out, made = [], 0
                for row in part.to_pylist():
                    out.append(fn(row))
                    made += sum(len(v) for v in out[-1].values() if isinstance(v, bytes))
                    if made >= STEP_BYTES:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, made = [], 0
                yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, types)


def unpack(row: dict, name: str = "pixels", dtype: str = "<f8") -> np.ndarray:
    """The (H, W) or (H, W, C) array of a packed column, row-major, channels fastest."""
    flat = np.frombuffer(row[name], dtype)
    shape = (row["height"], row["width"])
    return flat.reshape(shape) if flat.size == shape[0] * shape[1] else flat.reshape(*shape, -1)


def packed(image: np.ndarray, dtype: str = "<f8") -> bytes:
    return np.ascontiguousarray(image, dtype).tobytes()


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of images with STEP_PIXELS pixels together, or a larger image alone."""
    for batch in batches:
        for part in steps(batch):
            rows, pixels = [], 0
            for row in part.to_pylist():
                n = row["height"] * row["width"]
                if rows and pixels + n > STEP_PIXELS:
                    yield rows
                    rows, pixels = [], 0
                rows.append(row)
                pixels += n
            if rows:
                yield rows


def _places(rows: list[dict], key: str, kind: pa.DataType) -> list[pa.Array]:
    """The key, row and column of every pixel of ``rows``."""
    places = [np.divmod(np.arange(r["height"] * r["width"], dtype=np.int32), np.int32(r["width"])) for r in rows]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(y) for y, _ in places])
    return [pa.array([r[key] for r in rows], kind).take(pa.array(owner)), *(pa.array(np.concatenate(p)) for p in zip(*places, strict=True))]


def explode_pixels(df: DataFrame, columns: dict[str, str], key: str = "image_id") -> DataFrame:
    """``(key, y, x, column...)``: one row per pixel, row-major. ``columns`` gives the dtype of each packed column.

    A column of one byte gives an INT, any other a DOUBLE; a column of C channels an ARRAY of them.
    """
    arrow = {c: (pa.int32() if d.endswith("u1") else pa.float64()) for c, d in columns.items()}
    first = df.select(key).schema[0].dataType.simpleString()
    kind = to_arrow_schema(df.select(key).schema).field(0).type

    def run(batches):
        for rows in _images(batches):
            out = _places(rows, key, kind)
            for c, d in columns.items():
                out.append(pa.array(np.concatenate([np.frombuffer(r[c], d) for r in rows])).cast(arrow[c]))
            yield pa.RecordBatch.from_arrays(out, names=[key, "y", "x", *columns])

    fields = ", ".join(f"{c} {'int' if d.endswith('u1') else 'double'}" for c, d in columns.items())
    return df.select(key, "height", "width", *columns).mapInArrow(run, f"{key} {first}, y int, x int, {fields}")


def explode_channels(df: DataFrame, column: str, channels: int, key: str = "image_id", dtype: str = "<f8") -> DataFrame:
    """``(key, y, x, values array<double>)`` of a packed column with ``channels`` values for each pixel."""
    first = df.select(key).schema[0].dataType.simpleString()

    kind = to_arrow_schema(df.select(key).schema).field(0).type

    def run(batches):
        for rows in _images(batches):
            out = _places(rows, key, kind)
            values = pa.array(np.concatenate([np.frombuffer(r[column], dtype).astype("<f8") for r in rows]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(out[0]) + 1) * channels, channels, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([*out, lists], names=[key, "y", "x", "values"])

    return df.select(key, "height", "width", column).mapInArrow(run, f"{key} {first}, y int, x int, values array<double>")


def pack_pixels(df: DataFrame, value: str = "v", key: str = "image_id", dtype: str = "<f8") -> DataFrame:
    """``(key, height, width, pixels)`` from the long form; the image must be a full grid, its rows in any order."""
    grid = df.groupBy(key).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sort_array(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v")))).alias("at"))
    grid = grid.select(key, "height", "width", F.col("at.v").alias("values"))
    kind = grid.schema[0].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in steps(whole)):
            lists = batch["values"]
            data = [np.asarray(lists[i].values).astype(dtype).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch[key], batch["height"], batch["width"], pa.array(data, pa.binary())], names=[key, "height", "width", "pixels"])

    return grid.mapInArrow(run, f"{key} {kind}, height int, width int, pixels binary")


def tile_image(df: DataFrame, size: int, halo: int = 0, dtype: str = "<f8", column: str = "pixels") -> DataFrame:
    """Cut scenes into tiles of ``size`` with ``halo`` pixels of context: ``image_id, ty, tx, top, left, height, width, pixels``.

    ``top`` and ``left`` are the tile's own first pixel in the scene, without the halo; edges have less context.
    """
    kind = df.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in steps(whole)):
            for row in batch.to_pylist():
                image = unpack(row, column, dtype)
                out = []
                for top in range(0, row["height"], size):
                    for left in range(0, row["width"], size):
                        part = image[max(0, top - halo) : top + size + halo, max(0, left - halo) : left + size + halo]
                        out.append((row["image_id"], top // size, left // size, top, left, part.shape[0], part.shape[1], packed(part, dtype)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch["image_id"].type, *[pa.int32()] * 6, pa.binary()), strict=True)],
                    names=["image_id", "ty", "tx", "top", "left", "height", "width", "pixels"],
                )

    rows = df.select("image_id", "height", "width", column)
    return rows.mapInArrow(run, f"image_id {kind}, ty int, tx int, top int, left int, height int, width int, pixels binary")
