"""Document fingerprints from closed syncmers, with DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

#: An anchor is a K-mer of code points whose smallest S-mer stands at its start or end, about 2 in K - S + 1 of all.
K, S = 16, 12
#: The smallest hashes of anchors that make a fingerprint.
SIZE = 128
#: Code points whose S-mers are held at once.
PART = 8192
#: Bytes of text in a range of ids, and ranges at most (their bounds are on the driver; beyond, ranges grow).
RANGE_BYTES, RANGES = 32 << 20, 20_000
_INNER = ", ".join(f"h[i + {j}]" for j in range(1, K - S))
#: SQL: whether the K-mer whose S-mer hashes begin at ``h[i]`` is an anchor.
_CLOSED = f"least(h[i], h[i + {K - S}]) <= least({_INNER})"


def _per_part(text: str, begin: str, end: str, found: str) -> str:
    """SQL for ``found`` over the S-mer hashes ``h`` of part ``j`` of the K-mers of ``text`` that start in [begin, end)."""
    cut = f"substring({text}, int({begin} + j * {PART} + 1), int(least({PART}, {end} - {begin} - j * {PART}) + {K - 1}))"
    hashes = f"transform(regexp_extract_all(part, '(?s)(?=(.{{{S}}})).', 1), s -> xxhash64(s))"
    parts = f"transform(sequence(0, greatest({end} - {begin} - 1, 0) div {PART}), j -> struct(j, {cut} AS part))"
    parts = f"filter({parts}, x -> {end} > {begin} AND length(x.part) >= {K})"
    inner = f"transform(array({hashes.replace('part', 'x.part')}), h -> {found})[0]"
    return f"flatten(transform({parts}, x -> {inner}))"


def anchor_hashes(text: str, begin: str = "0", end: str | None = None) -> Column:
    """The hashes of the anchors that start in [begin, end) of the column ``text``, in order.

    Whether a K-mer is an anchor depends on its own code points alone, so equal passages have equal anchors in any
    context. An anchor's hash is that of its first S-mer.
    """
    found = f"filter(h, (v, i) -> i < size(h) - {K - S} AND least(v, h[i + {K - S}]) <= least({_INNER}))"
    return F.expr(_per_part(text, begin, end or f"(length({text}) - {K - 1})", found))


def anchors(text: str) -> Column:
    """All anchors of the column ``text``, in order: array of struct of start (code points from 0) and hash."""
    found = f"transform(filter(sequence(0, size(h) - {K - S + 1}), i -> {_CLOSED}), i -> named_struct('start', x.j * {PART} + i, 'hash', h[i]))"
    return F.expr(_per_part(text, "0", f"(length({text}) - {K - 1})", found))


def _sketch(anchors: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(anchors)), 1, SIZE)


def _or_whole(sketch: Column, text: Column) -> Column:
    """A text too short for an anchor, or without one, is its own anchor; an empty text has none."""
    return F.when((F.size(sketch) == 0) & (F.length(text) > 0), F.array(F.xxhash64(text))).otherwise(sketch)


def _hex(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the smallest anchors of both that both hold, an estimate of their Jaccard similarity."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` and the ``anchors`` of each text with their places, for positional matching.

    A fingerprint is the SIZE smallest distinct anchor hashes in hexadecimal. Null and empty texts have an empty one;
    a text without anchors has the hash of the whole text. Equal texts have equal fingerprints.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = base.withColumn("anchors", anchors("text"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), _hex(_or_whole(_sketch(F.col("anchors.hash")), F.col("text"))).alias("fingerprint"), "anchors")


def _count_up_to(column: str, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not above ``column``, by halving."""
    if not bounds:
        return F.lit(0).cast("long")
    steps = ", ".join(str(1 << i) for i in reversed(range(len(bounds).bit_length())))
    found = f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= size(list) AND get(list, p + s - 1) <= {column}, p + s, p))"
    return F.expr(f"transform(array(cast(split('{' '.join(map(str, bounds))}', ' ') AS array<bigint>)), list -> {found})[0]").cast("long")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are.

    The edit replaces the last ``n_chars // 2`` code points by as many of the next document's first (all, if it has
    fewer), by descending id; the first follows the last. A null id comes last. Rows of one id come in descending order
    of a hash of their text; equal rows have equal results. Null text counts as empty. Other columns are ignored.

    The anchors of a text are found once. Being free of context, those of an edit are the anchors that lie in the kept
    part, at the same places, those in the next document's part, and those of the K-mers across the seam: so only short
    sketches move between rows. ``anchors`` counts the text's anchors and ``anchors_in_place`` those that stand at
    their place in the kept part of the edit.

    Documents are dealt out by ranges of ids of about RANGE_BYTES; an id that fills several ranges, or the rows without
    one, are dealt out further by the hash of the text. The driver holds the bounds and first ids of the ranges; each
    range also gets a copy of the row that follows it. No window spans all rows.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.coalesce("doc_id", F.lit(lowest))).withColumn("h", F.xxhash64("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(max(parts, math.ceil(size / RANGE_BYTES)), max(parts, RANGES))
    bounds = Counter(int(x) for x in base.stat.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)) if ranges > 1 else Counter()
    above = F.lit(1 << 20)  # within its range, what is not an id of several ranges
    for b, n in bounds.items():
        if n > 1:
            above = F.when(F.col("key") == b, F.floor((F.col("h") / float(1 << 64) + 0.5) * n)).otherwise(above)
    base = base.withColumn("range", _count_up_to("key", sorted(bounds)) * (1 << 21) + above)
    firsts = sorted(((r["range"], r["first"]) for r in base.groupBy("range").agg(F.max(F.struct("key", "h")).alias("first")).collect()), reverse=True)
    # by range: the range whose last row is followed by this range's first row
    heads = spark.createDataFrame([(r, x.key, x.h, firsts[i - 1][0]) for i, (r, x) in enumerate(firsts)], "range long, key long, h long, before long")
    heads = base.join(F.broadcast(heads), ["range", "key", "h"]).groupBy("before").agg(F.max(F.struct("key", "h", "text", "doc_id")).alias("x"))
    heads = heads.select("x.doc_id", "x.text", "x.key", "x.h", F.col("before").alias("range"), F.lit(True).alias("copy"))
    rows = base.withColumn("copy", F.lit(False)).unionByName(heads).repartitionByRange(ranges, "range")
    order = Window.partitionBy("range").orderBy("copy", F.col("key").desc(), F.col("h").desc(), F.col("text").desc())
    rows = rows.withColumn("n", F.length("text")).withColumn("next_text", F.lead("text").over(order)).withColumn("above", F.lag("n").over(order))
    rows = rows.withColumn("cut", (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    new = F.substring(F.col("next_text"), F.lit(1), (F.col("n") - F.col("cut")))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(""))).drop("next_text")
    rows = rows.withColumn("kept", F.expr("substring(text, 1, cut)"))
    rows = rows.withColumn("seam", F.expr(f"concat(right(kept, {K - 1}), left(new, {K - 1}))"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.concat("kept", "new").cast("binary"), 256))
    rows = rows.withColumn("edited_n", F.length("kept") + F.length("new")).withColumn("edited_key", F.xxhash64(F.concat("kept", "new"))).drop("kept", "new")
    # K-mers inside the kept part start before ``kept_end``, those inside the part for the row above before ``lent_end``
    within = lambda end: F.greatest(F.lit(0), end - (K - 1)).cast("int")
    rows = rows.withColumn("kept_end", within(F.col("cut"))).withColumn("lent_end", within(F.least("n", F.floor(F.coalesce("above", F.lit(0)) / 2))))
    rows = rows.withColumn("low", F.least("kept_end", "lent_end")).withColumn("high", F.greatest("kept_end", "lent_end"))
    rows = rows.withColumn("p1", anchor_hashes("text", "0", "low")).withColumn("p2", anchor_hashes("text", "low", "high")).withColumn("p3", anchor_hashes("text", "high"))
    upto = lambda end: F.when(F.col(end) == F.col("low"), F.col("p1")).otherwise(F.concat("p1", "p2"))
    rows = rows.withColumn("seam_anchors", anchor_hashes("seam"))
    rows = rows.select(
        "range", "copy", "key", "h", "text", "doc_id", "n", "edited_sha256", "edited_n", "edited_key",
        _or_whole(_sketch(F.concat("p1", "p2", "p3")), F.col("text")).alias("whole"),
        _sketch(F.concat(upto("kept_end"), F.col("seam_anchors"))).alias("first_part"),
        _sketch(upto("lent_end")).alias("as_next"),
        (F.size("p1") + F.size("p2") + F.size("p3")).cast("long").alias("anchors"),
        F.size(upto("kept_end")).cast("long").alias("anchors_in_place"),
    )
    rows = rows.withColumn("next_part", F.lead("as_next").over(order)).withColumn("next_whole", F.lead("whole").over(order)).where("not copy")
    edited = _sketch(F.concat("first_part", F.coalesce("next_part", F.expr("cast(array() as array<bigint>)"))))
    edited = F.when((F.size(edited) == 0) & (F.col("edited_n") > 0), F.array("edited_key")).otherwise(edited)
    rows = rows.withColumn("edited", edited)
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        _hex(F.col("whole")).alias("fingerprint"),
        _hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("whole"), F.col("edited")).alias("near_edited"),
        likeness(F.col("whole"), F.col("next_whole")).alias("near_next"),
        "anchors",
        "anchors_in_place",
    )
