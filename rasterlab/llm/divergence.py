"""How the word use of the sources of a language differs: exact integer divergences between term distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rasterlab.llm import kernels as K
from rasterlab.llm.shared import materialise

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Bytes of text counted together in a task.
PIECE = 8 << 20
#: Tables of at most so many rows are broadcast; others are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Terms and counts of a block, and indicator columns multiplied at once.
BLOCK_TERMS, BLOCK_COUNTS, COLUMNS = 512, 1 << 18, 1024
#: Bytes of terms are A-Z, a-z and all of a character beyond ASCII; A-Z are lower-cased.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows, counted here, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term; added up in the tasks first."""

    def run(batches):
        for batch in K.parts(batches, "text", PIECE):
            buf, offs = K.text_buffer(batch["text"])
            inside = LETTER[buf]
            starts, ends, first = K.spans(buf, offs, inside)
            if not len(starts):
                continue
            bounds = np.concatenate([[0], np.cumsum(ends - starts)])
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(LOWER[buf[inside]])).dictionary_encode()
            size = len(terms.dictionary)
            in_doc, n = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(first)) * size + terms.indices.to_numpy(), return_counts=True)
            lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key, place = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
            columns = [
                lang.dictionary.take(pa.array(key // size // len(source.dictionary))),
                source.dictionary.take(pa.array(key // size % len(source.dictionary))),
                terms.dictionary.take(pa.array(key % size)).cast(pa.string()),
                pa.array(np.bincount(place, n, len(key)).astype(np.int64)),
                pa.array(np.bincount(place, minlength=len(key))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    found = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, total, at)``: terms in at least ``min_docs`` documents of the language, with their counts by
    source in ``at``, which has an element per source at most."""
    found = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("at"))
    return found.where(F.col("docs") >= min_docs).select("lang", "term", "total", "at")


def _price(n: str, total: str):
    """1 + floor(UNIT * (n + 2) / (total + 2 * vocabulary)), in whole numbers."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(20,0)) * {UNIT}bd) div cast({total} + 2 * vocabulary as decimal(20,0))")


def _block_values(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The divergences of one block of terms between each two sources of a language.

    A source's counts in the block take few levels. An indicator column for each source and level holds the terms at
    that level; the product of the columns' transpose with the columns, in blocks of columns, holds for each two
    sources how many terms have which two levels, exactly. Each such joint table is priced cell by cell.
    """
    rows = pa.Table.from_batches(list(batches))
    heads = rows.filter(pc.is_null(rows["at"]))
    at = rows.filter(pc.is_valid(rows["at"]))["at"].combine_chunks()
    sources = heads["source"].combine_chunks()
    counts = np.zeros((len(at), len(sources)), np.int64)
    flat = at.flatten()
    counts[np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy()), pc.index_in(flat.field("source"), value_set=sources).to_numpy()] = flat.field("n").to_numpy()

    chunks, width = [[]], 0  # of sources: (source, level of each term, price of each level)
    for s, (total, vocabulary) in enumerate(zip(heads["total"].to_pylist(), heads["vocabulary"].to_pylist(), strict=True)):
        level, of = np.unique(counts[:, s], return_inverse=True)
        price = np.array([1 + UNIT * (int(n) + 2) // (total + 2 * vocabulary) for n in level], np.int64)
        if width and width + len(level) > COLUMNS:
            chunks.append([])
            width = 0
        chunks[-1].append((s, of, price))
        width += len(level)

    def indicators(chunk):
        bounds = np.cumsum([0, *(len(price) for *_, price in chunk)])
        hot = np.zeros((len(at), bounds[-1]), np.float32)  # counts of terms in a block are exact in it
        for (_, of, _), b in zip(chunk, bounds, strict=False):
            hot[np.arange(len(at)), b + of] = 1
        return hot, np.concatenate([price for *_, price in chunk]), bounds[:-1]

    zeros = key[1].as_py() < 0  # the block without terms names every pair
    for i, left in enumerate(chunks):
        for j, right in enumerate(chunks[i:], i):
            if len(at):
                (x, p, a), (y, q, b) = indicators(left), indicators(right)
                joint = (x.T @ y).astype(np.int64)
                apart = p[:, None] - q[None]
                value = np.add.reduceat(np.add.reduceat(joint * (apart * apart // (p[:, None] + q[None])), a, 0), b, 1)
            else:
                value = np.zeros((len(left), len(right)), np.int64)
            one, two = (np.array([s for s, *_ in c], np.int64) for c in (left, right))
            u, v = (m.ravel() for m in np.meshgrid(one, two, indexing="ij"))
            on = (u != v) & (zeros | (value.ravel() > 0))
            u, v, value = u[on], v[on], value.ravel()[on]
            if i != j:
                u, v, value = np.concatenate([u, v]), np.concatenate([v, u]), np.tile(value, 2)
            columns = [pa.array([key[0].as_py()] * len(u), pa.string()), sources.take(pa.array(u)), sources.take(pa.array(v)), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each two sources of a language.

    Terms are dealt to blocks by language, by the power of two of their total (so that a block's counts take few
    levels) and by hash, as many blocks as terms and counts demand; no block grows with the corpus.
    """
    power = terms.withColumn("bucket", F.floor(F.log2("total")).cast("int"))
    few = F.greatest(F.lit(64), F.lit(BLOCK_TERMS) / F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.col("bucket") - 9)))
    blocks = materialise(
        power.groupBy("lang", "bucket").agg(F.count("*").alias("m"), F.sum(F.size("at")).alias("counts"))
        .select("lang", "bucket", F.greatest(F.ceil(F.col("m") / few), F.ceil(F.col("counts") / BLOCK_COUNTS), F.lit(1)).cast("int").alias("blocks"))
    )
    rows = power.join(_small(blocks), ["lang", "bucket"]).select(
        "lang", "bucket", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("vocabulary"), "at"
    )
    every = blocks.union(groups.select("lang", F.lit(-1), F.lit(1)).distinct())
    heads = groups.join(every, "lang").select(
        "lang", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "vocabulary", F.lit(None).cast(rows.schema["at"].dataType).alias("at")
    )
    found = rows.union(heads).groupBy("lang", "bucket", "block").applyInArrow(_block_values, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``(lang, source, item, value)``: each source's ``top`` terms that it uses more than its language does."""
    flat = terms.select("lang", "term", F.col("total").alias("everywhere"), F.explode("at").alias("x")).select("lang", "term", "everywhere", "x.source", "x.n")
    priced = flat.join(_small(groups), ["lang", "source"]).withColumn("p", _price("n", "total")).withColumn("q", _price("everywhere", "lang_total"))
    value = F.expr("(p - q) * (p - q) div (p + q)")
    found = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    return ranked(found).where(F.col("rank") <= top).select("lang", "source", "item", "value")


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the divergence of each source from each other source of its
    language (part ``pair``), and its most divergent terms against the language (part ``term``).

    Null text, language and source count as empty strings, so rows without them form groups of their own; a group
    without a kept term diverges by what its smoothed counts differ, and by 0 where the language keeps no term. Ranks
    follow value, then the item's bytes. Repeated rows count as often as they occur. Other columns are ignored; an
    empty table gives no rows. Texts of any length are counted whole. Only counts move; a language's sources must be
    few enough that a count for each, and a row for each two of them, can be held, as the result has these rows.
    """
    base = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    terms = materialise(kept_terms(base, min_docs))
    langs = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_total"))
    used = terms.select("lang", F.explode("at").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = base.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.na.fill(0))
    pairs = ranked(pair_values(terms, groups)).withColumn("part", F.lit("pair"))
    tops = ranked(term_values(terms, groups, top)).withColumn("part", F.lit("term"))
    return pairs.unionByName(tops).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
