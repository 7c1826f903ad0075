"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from rasterlab.llm import kernels as K
from rasterlab.llm.shared import materialise

#: Weights are hashed into 2**BITS places, which bounds what is broadcast (12 bytes a weight that is not zero).
BITS = 20
#: Fitting takes about TRAIN_ROWS labelled documents and TRAIN_BYTES of their texts at most, in shards of about SHARD_ROWS
#: and SHARD_BYTES at most.
TRAIN_ROWS, TRAIN_BYTES, SHARD_ROWS, SHARD_BYTES = 40_000, 256 << 20, 10_000, 32 << 20
#: Bytes of text that become features at once, which take about a hundred times as much.
STEP_BYTES = 1 << 20
#: Bytes of the beginnings of words that are features too, as languages that join words put an insult's stem there.
STEMS = (3, 5, 7)
#: A feature is learnt once MIN_DOCS examples of a shard have it. The L1 strength is L1_SCALE times the square root of
#: the shard's examples, as summed gradients of a feature without meaning grow that way.
#: The rare label weighs RARE times the square root of the labels' ratio.
EPOCHS, ALPHA, BETA, L1_SCALE, L2, MIN_DOCS, RARE = 8, 1.0, 1.0, 0.5, 0.1, 3, 5
THRESHOLD = 0.7
#: Bytes of words: ASCII letters and digits, and all of UTF-8's longer sequences.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def features(text: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(place, row)`` of every word, its stems, pairs of words and pairs with one word between, as often as they occur."""
    buf, offs = K.text_buffer(pc.utf8_lower(text))
    starts, ends, first = K.spans(buf, offs, _WORD[buf])
    h = K.hash_spans(buf, starts, ends, K.EXACT)
    row = np.searchsorted(first, np.arange(len(h)), "right") - 1
    out, rows = [h], [row]
    for gap in (1, 2):
        if len(h) > gap:
            on = row[gap:] == row[:-gap]
            out.append(K.mix(h[:-gap] * K.U(2 * gap + 1) + h[gap:])[on])
            rows.append(row[gap:][on])
    for n in STEMS:
        on = ends - starts > n
        out.append(K.mix(K.hash_spans(buf, starts[on], starts[on] + n, K.EXACT) ^ K.U(n)))
        rows.append(row[on])
    return (np.concatenate(out) >> K.U(64 - bits)).astype(np.int64), np.concatenate(rows)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The 32-bit words of each row of a binary column, without a copy."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4) // 4
    words = np.frombuffer(data, "<i4") if data is not None and data.size else np.zeros(0, "<i4")
    return [words[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


class Ftrl:
    """Per-coordinate learning rates; a weight is zero until its summed gradient leaves the L1 band."""

    def __init__(self, size: int, l1: float):
        self.z, self.n, self.l1 = np.zeros(size), np.zeros(size), l1

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(examples: DataFrame, rows: int = TRAIN_ROWS, shard_rows: int = SHARD_ROWS, bits: int = BITS, train_bytes: int = TRAIN_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, text, label)`` -> ``(place, weight)`` of the weights that are not zero; place 2**bits is the bias.

    About ``rows`` examples at most are taken, chosen by the hash of their id, and of these about ``train_bytes`` of
    text. Texts become distinct features before they are dealt to shards, whose rows and bytes are bounded; each shard
    is a model of its own over several epochs in a fixed order, and the shards' weights are averaged. Null labels and
    rows with a null id are left out; null text counts as empty. Without examples there are no weights and every score
    is 0.5.
    """
    use = examples.where("doc_id is not null and label is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("label").cast("int"), F.xxhash64("doc_id").alias("h"))
    n = use.count()
    if n > rows:
        use = use.where(F.pmod("h", F.lit(n)) < rows)
    use = materialise(use.select("h", "text", "label"))
    n, total = use.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    if total > train_bytes:
        use = use.where(F.pmod(F.xxhash64("h"), F.lit(total)) < train_bytes)
        n, total = math.ceil(n * train_bytes / total), train_bytes
    shards = max(1, math.ceil(n / shard_rows), math.ceil(total / shard_bytes))
    size = 1 << bits

    def encode(batches):
        for batch in K.parts(batches, "text", STEP_BYTES):
            place, row = features(batch["text"], bits)
            pairs = np.unique((row << bits) | place)
            bounds = np.searchsorted(pairs >> bits, np.arange(batch.num_rows + 1))
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer((pairs & (size - 1)).astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch["h"], batch["label"], blobs], names=["h", "label", "places"])

    def fit(group: pa.Table) -> pa.Table:
        # the lists stay where they arrived: one shard's are read in place, list by list, and are never put together
        order = pc.sort_indices(group, sort_keys=[("h", "ascending"), ("places", "ascending")]).to_numpy()
        label = group["label"].to_numpy()[order]
        lists = [x for chunk in group["places"].chunks for x in _lists(chunk)]
        lists = [lists[i] for i in order]
        count = np.zeros(size, np.int32)
        for x in lists:
            count[x] += 1  # a text's places are distinct
        common = count >= min(MIN_DOCS, len(label))
        rare = max(1, int((label == 1).sum()))
        weight = RARE * math.sqrt(max(0.25, (len(label) - rare) / rare))
        model = Ftrl(size + 1, L1_SCALE * math.sqrt(len(label)))
        draw = np.random.Generator(np.random.PCG64(5))
        for _ in range(EPOCHS):
            for i in draw.permutation(len(label)):
                place = lists[i][common[lists[i]]].astype(np.int64)
                model.learn(np.append(place, size), int(label[i] == 1), weight if label[i] == 1 else 1.0)
        w = model.weights()
        on = np.flatnonzero(w)
        return pa.table({"place": on, "weight": w[on]})

    encoded = use.mapInArrow(encode, "h long, label int, places binary")
    parts = encoded.withColumn("shard", F.pmod(F.hash("h"), F.lit(shards))).groupBy("shard").applyInArrow(fit, "place long, weight double")
    return parts.groupBy("place").agg((F.sum("weight") / shards).alias("weight"))


def score(docs: DataFrame, weights: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int, 1 from ``threshold`` on).

    A feature counts once in a text, wherever and however often it stands; the whole text is read. Null, empty and
    wordless texts get the bias alone. Columns of these two names are replaced, all others pass through.
    """
    table = materialise(weights).collect()  # at most 2**bits + 1 rows
    bias = sum(r.weight for r in table if r.place == 1 << bits)
    table = [r for r in table if r.place < 1 << bits]
    model = docs.sparkSession.sparkContext.broadcast((np.array([r.place for r in table], np.int64), np.array([r.weight for r in table], np.float64)))
    base = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    inside = next((i for i, f in enumerate(docs.schema) if f.name == text_col and isinstance(f.dataType, T.StringType)), None)
    if inside is not None:  # the text is sent once, with its row
        base = base.select("row")
    schema = T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        dense = np.zeros(1 << bits)
        dense[model.value[0]] = model.value[1]
        if inside is not None:
            batches = (pa.RecordBatch.from_arrays([b["row"], b["row"].field(inside)], names=["row", "text"]) for b in batches)
        for batch in K.parts(batches, "text", STEP_BYTES):
            place, row = features(batch["text"], bits)
            on = dense[place] != 0
            pairs = np.unique((row[on] << bits) | place[on])
            logit = bias + np.bincount(pairs >> bits, dense[pairs & ((1 << bits) - 1)], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], names=["row", "score"])
            pa.default_memory_pool().release_unused()

    done = base.mapInArrow(run, schema)
    done = done.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("score", "predicted")), "score")
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of labelled documents outside the held-out fold; toxic wins where labels differ.

    About ``rows`` labels at most, by the hash of their id, are drawn before any text is read: the draw is bounded and
    broadcast, and the texts of the other documents don't move.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
