"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm import kernels as K
from rasterlab.llm.shared import materialise

#: Shingles of an item's sketch; the chance that a contaminated document shows too few of them.
SKETCH, MISS, SHINGLE = 16, 1e-6, 5
#: Bits of a size partition's bitmap, at least and at most.
LEAST_BITS, MOST_BITS = 16, 26
#: The partition number under which the bitmap of all items' shingles goes.
_ALL = -1


def needed(percent: int, drawn: int = SKETCH, miss: float = MISS) -> int:
    """How many of ``drawn`` sketch shingles a document holds that contains ``percent`` of an item, but for ``miss``."""
    p, total = percent / 100, 0.0
    for t in range(drawn + 1):
        total += math.comb(drawn, t) * p**t * (1 - p) ** (drawn - t)
        if total > miss:
            return max(1, t)
    return drawn


def item_shingles(items: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """``(item_id, item_key, n, part, h, drawn)``: the distinct shingles of each item, and its sketch.

    ``part`` is the size partition, the logarithm of the number of shingles; ``drawn`` marks the sketch, the SKETCH
    shingles whose mixed hashes are smallest (a MinHash of the smallest values), or all of a smaller item.
    """

    def run(batches):
        for batch in K.parts(batches, "text"):
            value, offs = K.shingles(*K.words(*K.text_buffer(batch["text"])), k)
            drawn = np.ones(len(value), bool)
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                if b - a > SKETCH:
                    order = np.argsort(K.mix(value[a:b] ^ K.U(101)))
                    drawn[a:b][order[SKETCH:]] = False
            n = np.diff(offs)
            row = np.repeat(np.arange(len(n)), n)
            part = np.floor(np.log2(n[row])).astype(np.int64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(at), batch["item_key"].take(at), pa.array(n[row]), pa.array(part), K.longs(value), pa.array(drawn)], names=["item_id", "item_key", "n", "part", "h", "drawn"])

    narrow = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    narrow = narrow.withColumn("item_key", F.xxhash64("item_id", "text")).dropDuplicates(["item_key"])
    return narrow.mapInArrow(run, "item_id long, item_key long, n long, part long, h long, drawn boolean")


def _bitmaps(shingle: DataFrame) -> dict[int, np.ndarray]:
    """For each size partition the bits of its sketches' hashes, and under ``_ALL`` those of all shingles.

    Spark gathers the bits into 64-bit words; at most 2**MOST_BITS / 64 of them per partition reach the driver, and
    partitions are logarithms of sizes.
    """
    rows = shingle.where("drawn").select("part", "h").union(shingle.select(F.lit(_ALL).cast("long"), "h"))
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    width = {p: 1 << min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length())) for p, n in sizes.items()}
    out = {p: np.zeros(w // 64, np.int64) for p, w in width.items()}
    if not out:
        return {}
    place = F.col("h").bitwiseAND(F.create_map(*(F.lit(x) for pair in width.items() for x in pair))[F.col("part")] - 1)
    words = rows.groupBy("part", F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    for r in words.toLocalIterator():
        out[r.part][r.w] = r.bits
    return {p: x.view(K.U) for p, x in out.items()}


def _holds(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = value & K.U(64 * len(bits) - 1)
    return (bits[(at >> K.U(6)).astype(np.int64)] >> (at & K.U(63)) & K.U(1)).astype(bool)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 75,
    k: int = SHINGLE,
) -> DataFrame:
    """``(doc_id, text_key, item_id, n_item, n_shared, containment)``: documents that hold ``percent`` of an item.

    Containment is the share of an item's distinct ``k``-word shingles (A-Z folded, ASCII white space) found anywhere
    in the document. Steps:

    1. items are partitioned by size, a power of two each, and sketched by their SKETCH smallest hashes, so a partition's
       bitmap holds a bounded number of hashes for each item, however long it is. A small item's sketch is all of it;
    2. a document is looked up in the bitmaps of those partitions whose items it is large enough to contain. A document
       that contains the share c of an item holds each hash of its sketch with probability c, whatever the document's
       own length;
    3. pairs with enough sketch hashes in common (``needed``: at 75 percent 3 of 16, missed once in a million; all
       that the threshold asks for where the sketch is the item) are the candidates;
    4. candidates alone are verified: all of the item's shingles are counted in the document.

    Documents are read once: one with hashes of a sketch also gives its shingles that any item has, for step 4. Bitmaps
    only save work, as hits are joined on their full hashes.

    Null or blank texts and items contain and match nothing; an item with fewer than ``k`` words is its whole sequence.
    Each text is judged by itself, also where rows share an id or have none (``doc_id`` is null then): ``text_key`` is
    xxhash64 of the text, with which a row is found again. Equal rows count once. Items without an id are left out; of
    items that share an id each is searched, and the one contained most is returned. Other columns are ignored.
    """
    spark = docs.sparkSession
    shingle = materialise(item_shingles(items, item_col, item_text_col, k))
    bitmaps = spark.sparkContext.broadcast(_bitmaps(shingle))

    def run(batches):
        maps = bitmaps.value
        for batch in K.parts(batches, "text"):
            value, offs = K.shingles(*K.words(*K.text_buffer(batch["text"])), k)
            n = np.diff(offs)
            row = np.repeat(np.arange(len(n)), n)
            found = np.zeros(len(n), bool)
            for part, bits in sorted(maps.items(), reverse=True):  # the bitmap of all shingles comes last
                large = found if part == _ALL else n * 100 >= percent * 2**part
                on = slice(None) if large.all() else np.flatnonzero(large[row])
                v, r = value[on], row[on]
                hit = np.flatnonzero(_holds(bits, v))
                if part != _ALL:
                    found[r[hit]] = True
                at = pa.array(r[hit])
                if len(hit):
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["text_key"].take(at), pa.array(n[r[hit]]), pa.array(np.full(len(hit), part, np.int64)), K.longs(v[hit])], names=["doc_id", "text_key", "n_doc", "part", "h"])

    text = F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    hits = materialise(narrow.mapInArrow(run, "doc_id long, text_key long, n_doc long, part long, h long"))
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("d"), F.xxhash64("text_key", F.col("doc_id").isNull()).alias("k")]  # a key without nulls
    hits = hits.select(*key, *hits.columns)
    sketch = shingle.where("drawn").select("item_id", "item_key", "n", "part", "h")
    pair = ["d", "k", "item_key"]
    common = hits.where(F.col("part") != _ALL).join(sketch, ["part", "h"]).where(F.col("n_doc") * 100 >= F.col("n") * percent)
    common = common.groupBy(*pair).agg(F.count_distinct("h").alias("common"), *(F.first(c).alias(c) for c in ("doc_id", "text_key", "item_id", "n")))
    enough = F.when(F.col("n") <= SKETCH, F.col("common") * 100 >= F.col("n") * percent).otherwise(F.col("common") >= needed(percent))
    candidates = materialise(common.where(enough).drop("common"))
    owned = candidates.join(shingle.select("item_key", "h"), "item_key")
    shared = owned.join(hits.where(F.col("part") == _ALL).select("d", "k", "h").distinct(), ["d", "k", "h"], "left_semi")
    out = shared.groupBy(*pair).agg(F.count("*").alias("n_shared"), *(F.first(c).alias(c) for c in ("doc_id", "text_key", "item_id", "n")))
    out = out.where(F.col("n_shared") * 100 >= F.col("n") * percent).withColumn("containment", F.col("n_shared") / F.col("n"))
    best = out.groupBy("d", "k", "item_id").agg(F.max(F.struct("containment", "n", "n_shared")).alias("x"), F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"))
    return best.select("doc_id", "text_key", "item_id", F.col("x.n").alias("n_item"), F.col("x.n_shared").alias("n_shared"), F.col("x.containment").alias("containment"))
