"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rasterlab.llm import kernels as K
from rasterlab.llm.graph import components
from rasterlab.llm.shared import materialise

BANDS, ROWS, SHINGLE = 32, 4, 5
#: Sketch bits that are compared before texts are: 256 of every document, 2048 of those in buckets of several components.
BITS, MORE_BITS = 256, 2048
#: How many deviations from what pairs at the threshold show on average is still compared: one pair in 20 million, or in
#: a million, falls below.
SLACK, MORE_SLACK = 5.3, 4.8
#: Members of one bucket that are compared in one block.
BLOCK = 1000


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, text_key, n_shingles, set_key, b0..b3, bands)``, one row per document.

    ``text_key`` is xxhash64 of the text, ``set_key`` is a digest of the whole set, ``bands`` one hash per band, ``b0..b3`` two bits of each sketch coordinate.
    """
    t = bands * rows

    def run(batches):
        for batch in K.parts(batches, "text"):
            value, offs = K.shingles(*K.words(*K.text_buffer(batch["text"])), k)
            sketch = K.fast_sketch(value, offs, t)
            salt = K.mix(np.arange(t, dtype=K.U) + K.U(11))
            band = K.mix((K.mix(sketch + salt) * K.U(3)).reshape(-1, bands, rows).sum(axis=2, dtype=K.U) + np.arange(bands, dtype=K.U))
            bits = np.packbits(np.concatenate([K.mix(sketch) & K.U(1), (K.mix(sketch) >> K.U(1)) & K.U(1)], axis=1).astype(np.uint8), axis=1)
            word = np.zeros((len(bits), 32), np.uint8)
            word[:, : min(32, bits.shape[1])] = bits[:, :32]
            word = word.view(np.int64)
            size = np.diff(offs)
            keys = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offs[:-1], offs[1:], strict=True)]
            band_offs = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(size), pa.array(keys, pa.binary()), *(pa.array(np.ascontiguousarray(word[:, i])) for i in range(4)), K.long_lists(band[size > 0].ravel(), band_offs)],
                names=["doc_id", "text_key", "n_shingles", "set_key", "b0", "b1", "b2", "b3", "bands"],
            )

    text = F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, b0 long, b1 long, b2 long, b3 long, bands array<long>")


def _alike(x: str, y: str, percent: int) -> Column:
    """What pairs at the threshold meet: sizes within it, and enough equal sketch bits."""
    differ = sum((F.bit_count(F.col(f"{x}b{i}").bitwiseXOR(F.col(f"{y}b{i}"))) for i in range(4)), F.lit(0))
    sizes = F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * percent
    s, half = percent / 100, BITS / 2
    deviation = (half * ((1 - s) / 2 + s * (1 - s))) ** 0.5  # two bits of each of 128 coordinates
    return sizes & (differ <= half * (1 - s) + SLACK * deviation)


def _more_alike(x: str, y: str, percent: int) -> Column:
    n = MORE_BITS // 64
    differ = sum((F.bit_count(F.col(f"{x}m{i}").bitwiseXOR(F.col(f"{y}m{i}"))) for i in range(n)), F.lit(0))
    p = (1 - percent / 100) / 2
    return differ <= MORE_BITS * p + MORE_SLACK * (MORE_BITS * p * (1 - p)) ** 0.5


def more_bits(texts: DataFrame, k: int) -> DataFrame:
    """``(id, m0, m1, ...)``: one bit of each of MORE_BITS sketch coordinates."""
    n = MORE_BITS // 64

    def run(batches):
        for batch in K.parts(batches, "text", 1 << 20):
            value, offs = K.shingles(*K.words(*K.text_buffer(batch["text"])), k)
            for a in range(0, batch.num_rows, 512):
                b = min(batch.num_rows, a + 512)
                sketch = K.fast_sketch(value[offs[a] : offs[b]], offs[a : b + 1] - offs[a], MORE_BITS)
                word = np.packbits((K.mix(sketch) & K.U(1)).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *(pa.array(np.ascontiguousarray(word[:, i])) for i in range(n))], names=["id", *(f"m{i}" for i in range(n))])

    return texts.select("doc_id", "text").mapInArrow(run, "id long, " + ", ".join(f"m{i} long" for i in range(n)))


def verify_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those ``(a, b)`` whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in K.parts(batches, "ta", 2 << 20):
            va, oa = K.shingles(*K.words(*K.text_buffer(batch["ta"])), k)
            vb, ob = K.shingles(*K.words(*K.text_buffer(batch["tb"])), k)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared) and shared > 0
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge")
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge")
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    k: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when their sets of ``k``-word shingles (A-Z folded, split at ASCII white space) have a
    Jaccard similarity of at least ``percent``/100. Steps:

    1. every document gets a fast-similarity sketch of ``bands * rows`` coordinates;
    2. documents with equal sets form a class, and one of them stands for it;
    3. representatives that share a band meet in a bucket. Each is first paired with the bucket's smallest and largest
       id only (a star, not all pairs); pairs whose sketches allow it are verified on the full sets of their texts and
       give first components. Only in buckets that still hold several components are members of different components
       compared, in blocks and by longer sketches, and verified too: members outside the bucket's largest component with
       all others, so that a large group of copies is never compared within itself. So a large bucket of copies costs
       one pair for each member, and links between different texts of the same bucket are not lost;
    4. components of the verified links give ``component_id``, the smallest reachable id.

    A pair at similarity s shares a band with probability ``1 - (1 - s**rows)**bands``: all but 5 in a million at 0.75.

    Sets are compared as 64-bit hashes of their shingles. Null, empty and blank texts have no shingles and are linked
    with nothing. A row with a null id is linked with
    nothing, has a null ``component_id`` and is kept. Rows that share an id are one document: each of its texts is
    compared, and links of any of them are its links.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    sketches = materialise(sketch_documents(docs, k=k, bands=bands, rows=rows))
    known = sketches.where("doc_id is not null and n_shingles > 0")
    # ids with several texts, few as a rule: all but one of these get a node of their own, above all ids
    several = materialise(sketches.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_key").alias("first_key"), F.max("text_key").alias("last_key")).where("first_key < last_key").select("doc_id", "first_key"))
    own = F.xxhash64("doc_id", "text_key").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)

    def nodes(rows: DataFrame) -> DataFrame:
        return rows.join(several, "doc_id", "left").withColumn("node", F.when(F.col("first_key") < F.col("text_key"), own).otherwise(F.col("doc_id"))).drop("first_key")

    known = nodes(known)
    classes = known.groupBy("set_key").agg(F.min("node").alias("class_id"))
    reps = materialise(
        known.join(classes, (known.set_key == classes.set_key) & (known.node == classes.class_id), "left_semi").dropDuplicates(["node"]).withColumnRenamed("node", "id").drop("doc_id", "text_key")
    )
    entries = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low < high")
    members = materialise(entries.join(hubs, "bucket"))
    marks = reps.select("id", F.col("n_shingles").alias("n"), "b0", "b1", "b2", "b3")
    star = members.select("id", F.explode(F.array("low", "high")).alias("hub")).where("id <> hub")
    star = star.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).groupBy("a", "b").agg(F.count("*").alias("votes"))
    star = star.join(marks.toDF("a", *(f"x{c}" for c in marks.columns[1:])), "a").join(marks.toDF("b", *(f"y{c}" for c in marks.columns[1:])), "b")
    star = materialise(star.where(_alike("x", "y", percent)).select("a", "b", "votes"))
    near = members.select(F.col("id").alias("doc_id")).distinct().hint("merge")  # grows with the documents: no broadcast
    texts = nodes(docs).select(F.col("node").alias("doc_id"), "text")
    texts = materialise(texts.join(near, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    first = star.groupBy("a").agg(F.max_by("b", "votes").alias("b"))
    links = materialise(verify_pairs(first, texts, k, percent))
    found = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs that the components so far do not join."""
        for end in "ab":
            names = found.toDF(end, f"c{end}")
            pairs = pairs.join(names, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        return pairs.where("ca <> cb").select("a", "b").distinct()

    more = materialise(verify_pairs(materialise(apart(star.select("a", "b"))), texts, k, percent))
    links = links.union(more)
    found = components(links)
    named = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components")).where("components > 1").select("bucket", "main")
    left = named.join(mixed, "bucket").join(reps.select("id", "bands", *(F.col(c) for c in marks.columns[2:]), F.col("n_shingles").alias("n")), "id")
    left = materialise(left.select("id", "band", "bands", "bucket", "component", "main", "n", "b0", "b1", "b2", "b3", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    near = left.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    left = left.join(more_bits(texts.join(near, "doc_id", "left_semi"), k), "id")
    x = left.where("component <> main").select(*(F.col(c).alias(f"x{c}") for c in left.columns), F.pmod(F.hash("id"), F.col("blocks")).alias("xblock"))
    x = x.withColumn("yblock", F.explode(F.sequence(F.lit(0), F.col("xblocks") - 1)))
    y = left.select(*(F.col(c).alias(f"y{c}") for c in left.columns), F.pmod(F.hash("id"), F.col("blocks")).alias("block"))
    meet = (F.col("xbucket") == F.col("ybucket")) & (F.col("yblock") == F.col("block"))
    earlier = lambda side: F.slice(f"{side}bands", F.lit(1), F.col(f"{side}band"))
    first_met = ~F.arrays_overlap(earlier("x"), earlier("y"))  # a pair comes out of the first of its common buckets
    differ = F.col("xcomponent") != F.col("ycomponent")
    once = (F.col("ycomponent") == F.col("ymain")) | (F.col("xcomponent") < F.col("ycomponent"))
    rest = x.join(y, meet & differ & once & _alike("x", "y", percent) & _more_alike("x", "y", percent) & first_met)
    rest = materialise(rest.select(F.greatest("xid", "yid").alias("a"), F.least("xid", "yid").alias("b")).distinct())
    last = materialise(verify_pairs(rest, texts, k, percent))
    named = nodes(sketches.join(several, "doc_id", "left_semi").where("n_shingles > 0")).join(classes, "set_key").select("doc_id", "class_id")
    one = named.groupBy("doc_id").agg(F.min("class_id").alias("b"))
    same = named.join(one, "doc_id").select(F.col("class_id").alias("a"), "b").where("a <> b").distinct()
    found = components(found.where("node <> component").toDF("a", "b").union(last).union(same))

    named = classes.join(found, classes.class_id == found.node, "left").select("set_key", F.coalesce("component", "class_id").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    shared = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("shared"))
    out = out.join(shared, "doc_id", "left").withColumn("component_id", F.coalesce("shared", "component_id")).drop("shared")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
