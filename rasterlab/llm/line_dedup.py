"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rasterlab.llm import kernels as K
from rasterlab.llm.shared import materialise

#: A line of so many words stands alone; a chunk has no more than so many lines; a removed run has so many words.
HEAVY, LONGEST, MIN_WORDS = 8, 64, 50


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first-line numbers of texts, and word counts of the non-empty lines."""
    starts, ends, first = K.spans(buf, offs, buf != 10)
    word, _, _ = K.spans(buf, offs, ~K.SPACE[buf])
    return starts, ends, first, np.searchsorted(word, ends) - np.searchsorted(word, starts)


def _chunks(docs: DataFrame) -> DataFrame:
    """``(id, k, start, n, chunk, prev, next)``: the chunks of each text, with the line hashes of both neighbours.

    A chunk ends after a line when the rolling hash over that line's and the line before's hash isn't divisible by 4,
    before and after a line of ``HEAVY`` words, at the end of the text, or at ``LONGEST`` lines. Boundaries are that
    dense so that a passage of MIN_WORDS holds a whole chunk, wherever it stands: with longer chunks, one passage in
    nine of seven short lines had none.
    """

    def run(batches):
        for batch in K.parts(batches, "text"):
            buf, offs = K.text_buffer(batch["text"])
            starts, ends, first, count = line_spans(buf, offs)
            m = len(starts)
            if not m:
                continue
            h = K.hash_spans(buf, starts, ends, K.EXACT)
            doc = np.searchsorted(first, np.arange(m), "right") - 1
            before = np.concatenate([[K.U(0)], h[:-1]])
            before[first[:-1][first[:-1] < first[1:]]] = 0
            cut = (K.mix(before * K.U(3) + h) & K.U(3)) != 0
            heavy = count >= HEAVY
            cut |= heavy
            cut[:-1] |= heavy[1:] | (doc[1:] != doc[:-1])
            cut[-1] = True
            opens = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
            place = np.arange(m) - opens[np.cumsum(np.concatenate([[0], cut[:-1]]))]
            cut |= place % LONGEST == LONGEST - 1
            opens = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
            number = np.cumsum(np.concatenate([[0], cut[:-1]]))
            place = np.arange(m) - opens[number]
            n = np.diff(np.append(opens, m))
            key = K.mix(np.add.reduceat(h * K.powers(LONGEST + 1)[0][place], opens) + n.astype(K.U))
            owner = doc[opens]
            joined = np.concatenate([owner[1:] == owner[:-1], [False]])
            has_prev = np.concatenate([[False], joined[:-1]])
            lists = []
            for near, source in ((np.where(has_prev, np.concatenate([[0], n[:-1]]), 0), joined), (np.where(joined, np.append(n[1:], 0), 0), has_prev)):
                lists.append(K.long_lists(h[source[number]], np.concatenate([[0], np.cumsum(near)])))
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(at), batch["k"].take(at), pa.array(opens - first[owner]), pa.array(n), K.longs(key), *lists],
                names=["id", "k", "start", "n", "chunk", "prev", "next"],
            )

    return docs.select("id", "k", "text").mapInArrow(run, "id long, k long, start long, n long, chunk long, prev array<long>, next array<long>")


def _alike(x: Column, y: Column) -> Column:
    """How many first elements of two arrays are equal."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs == 0, F.size(x)).otherwise(differs - 1).cast("long")


def _lines(joined: DataFrame) -> DataFrame:
    """``(id, k, line, h, bytes)``: the lines inside the ranges of each text."""

    def run(batches):
        for batch in K.parts(batches, "text"):
            buf, offs = K.text_buffer(batch["text"])
            starts, ends, first, _ = line_spans(buf, offs)
            h = K.hash_spans(buf, starts, ends, K.EXACT)
            inside = np.zeros(len(starts) + 1, np.int64)
            ranges = batch["ranges"]
            values = ranges.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ranges.offsets.to_numpy()))
            np.add.at(inside, first[row] + values.field("a").to_numpy(), 1)
            np.add.at(inside, first[row] + values.field("b").to_numpy(), -1)
            on = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
            doc = np.searchsorted(first, on, "right") - 1
            data = buf.tobytes()
            text = pa.array([data[a:b] for a, b in zip(starts[on], ends[on], strict=True)], pa.binary())
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["k"].take(at), pa.array(on - first[doc]), K.longs(h[on]), text], names=["id", "k", "line", "h", "bytes"])

    return joined.select("id", "k", "text", "ranges").mapInArrow(run, "id long, k long, line long, h long, bytes binary")


def _cut(data: bytes, ranges: list[tuple[int, int]], min_words: int) -> tuple[bytes | None, int, int]:
    """The text without the runs of lines that ``ranges`` cover, if they have ``min_words`` words; lines and words cut."""
    lines = data.split(b"\n")
    full = [i for i, x in enumerate(lines) if x]
    gone = np.zeros(len(full) + 1, bool)
    for a, b in ranges:
        gone[a:b] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
    drop: set[int] = set()
    n_lines = n_words = 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        words = sum(len(lines[i].split()) for i in full[a:b])
        if words >= min_words:
            drop.update(range(full[a], full[b - 1] + 1))
            n_lines, n_words = n_lines + int(b - a), n_words + words
    return (b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else None), n_lines, n_words


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from the text, and ``removed_lines`` and ``removed_words`` (long).

    Texts are cut into content-defined chunks of lines. Of the places where an equal chunk stands, the first (by id,
    then place) keeps it. Every other place is marked, and grown line by line to both sides while it equals the kept
    place, as the first and last lines of a passage may share a chunk with their context. Marked lines that touch form
    a run; runs of ``min_words`` words or more are removed with the blank lines inside them, so short lines that
    coincide stay. Hash equality is never trusted: all marked and kept lines are grouped by hash and compared byte by
    byte, and a place with a line whose hash stands for different bytes is left alone.

    Each cut points to an earlier place, so one copy of every passage stays. A passage repeated inside one text is
    cut there too. Empty lines match nothing. Null text stays null, empty text empty; a text that is wholly a repeat
    becomes empty. Rows equal in id and text count as one document: they keep or lose the same lines. A null id
    sorts first and is a document of its own for each text. Columns named ``removed_lines`` or ``removed_words`` are
    replaced, all others pass through.
    """
    others = [c for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("k", F.xxhash64(F.col("text")))
    chunks = materialise(_chunks(base))
    # written, so that the joins have two plain sides each and Spark can split the places of a frequent chunk over tasks
    repeated = materialise(chunks.groupBy("chunk", "n").agg(F.count("*").alias("places")).where("places > 1").select("chunk", "n"))
    chunks = materialise(chunks.join(repeated.hint("merge"), ["chunk", "n"], "left_semi"))
    kept = materialise(chunks.groupBy("chunk", "n").agg(F.min(F.struct("id", "k", "start", "prev", "next")).alias("keep")))
    marked = chunks.join(kept, ["chunk", "n"]).where(~(F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("k") == F.col("keep.k")) & (F.col("start") == F.col("keep.start"))))
    left = _alike(F.reverse("prev"), F.reverse("keep.prev"))
    marked = marked.withColumn("left", left).withColumn("right", _alike(F.col("next"), F.col("keep.next")))
    span = lambda at: F.struct((at - F.col("left")).alias("a"), (at + F.col("n") + F.col("right")).alias("b"))
    marked = materialise(marked.select("id", "k", span(F.col("start")).alias("cut"), F.struct(F.col("keep.id").alias("id"), F.col("keep.k").alias("k")).alias("at"), span(F.col("keep.start")).alias("kept")))
    cuts = marked.groupBy("id", "k").agg(F.collect_set("cut").alias("ranges"))
    stays = marked.select("at.id", "at.k", "kept").distinct()
    checked = marked.select("id", "k", F.col("cut").alias("kept")).union(stays).groupBy("id", "k").agg(F.collect_set("kept").alias("ranges"))

    def on(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
        y = y.select(F.col("id").alias("id_"), F.col("k").alias("k_"), "ranges")
        return x.join(y, F.col("id").eqNullSafe(F.col("id_")) & (F.col("k") == F.col("k_")), how).drop("id_", "k_")

    lines = _lines(on(base.select("id", "k", "text").dropDuplicates(["id", "k"]), checked, "inner"))
    clash = lines.select("h", "bytes").distinct().groupBy("h").count().where("count > 1").select("h")
    clash = materialise(clash)
    if not clash.isEmpty():
        wrong = lines.join(clash, "h").select("id", "k", "line").distinct().groupBy("id", "k").agg(F.collect_set("line").alias("wrong"))
        cuts = cuts.join(wrong, (cuts.id.eqNullSafe(wrong.id)) & (cuts.k == wrong.k), "left").select(cuts.id, cuts.k, "ranges", "wrong")
        cuts = cuts.select("id", "k", F.filter("ranges", lambda r: ~F.exists(F.coalesce("wrong", F.array()), lambda w: (w >= r["a"]) & (w < r["b"]))).alias("ranges"))

    schema = T.StructType([T.StructField("row", base.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("removed_lines", T.LongType()), T.StructField("removed_words", T.LongType())])

    def run(batches):
        for batch in K.parts(batches, "text"):
            ranges = batch["ranges"]
            hit = [i for i, x in enumerate(ranges.is_valid().to_pylist()) if x]
            lines_cut, words_cut = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            text = batch["text"]
            if hit:
                texts: dict[int, bytes] = {}
                for i in hit:
                    new, lines_cut[i], words_cut[i] = _cut(text[i].as_buffer().to_pybytes(), [(r["a"], r["b"]) for r in ranges[i].as_py()], min_words)
                    if new is not None:
                        texts[i] = new
                if texts:
                    keep = np.arange(batch.num_rows)
                    keep[list(texts)] = batch.num_rows + np.arange(len(texts))
                    pool = pa.concat_arrays([text.cast(pa.large_string()), pa.array(list(texts.values()), pa.large_binary()).cast(pa.large_string())])
                    text = pool.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([batch["row"], text.cast(pa.string()), pa.array(lines_cut), pa.array(words_cut)], names=["row", "text", "removed_lines", "removed_words"])

    done = on(base, cuts, "left").select("row", "text", "ranges").mapInArrow(run, schema)
    new = {text_col: F.col("text"), "removed_lines": F.col("removed_lines"), "removed_words": F.col("removed_words")}
    kept_cols = [new[c].alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("removed_lines", "removed_words") or c == text_col]
    return done.select(*kept_cols, "removed_lines", "removed_words")
