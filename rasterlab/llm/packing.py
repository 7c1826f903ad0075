"""Lexical retrieval packing: BM25 neighbours fill each seed document's window."""

from __future__ import annotations

import importlib
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rasterlab.llm import kernels as K
from rasterlab.llm.shared import forget, materialise, shared_dir

#: Tokens of a window; the id that ends a document; bytes and rows of a shard of the index, which bound a task's memory.
WINDOW, END_ID, SHARD_BYTES, SHARD_ROWS = 2048, 1, 8 << 20, 1 << 14
#: Terms are hashed into 2**TERM_BITS places, so the document frequencies have a fixed size (1 MB).
TERM_BITS, K1, B = 18, 1.2, 0.75
#: Seeds of a search task, documents of its step, terms that it multiplies as a matrix; neighbours a lookup asks for, and at most.
SEEDS, DOCS, FREQUENT, BEST, MOST = 1024, 512, 512, 64, 4096
#: Neighbours that a search holds (twice as many while it sorts them), and products that it adds up at once.
HELD, PRODUCTS = 1 << 20, 1 << 19
#: Bytes of text that are encoded or split into terms at once; pieces whose ids are remembered in a worker.
STEP_BYTES, REMEMBERED = 1 << 20, 1 << 18
#: Bytes and rows of a block of documents that fixed queries stream past, queries of its step and of a file; tokens that a task cuts.
BLOCK_BYTES, BLOCK_ROWS, QUERIES, FILE_ROWS, TASK_TOKENS = 48 << 20, 1 << 14, 8192, 1 << 15, 4 << 20
#: Documents of a block that are scored together, and terms of theirs or of a step's queries that may be multiplied as a matrix.
TOGETHER, WIDE = 512, 1024
#: Terms of a step's queries at most; queries in a row of the lists by term, of which the last is filled up with places that no query has.
STEP_TERMS, LISTED = 1 << 21, 8
#: Groups of like queries, and queries that they are found from; they order the work and change no score.
GROUPS, GROUP_SAMPLE = 8, 1024
#: Seconds of a matrix product for one pair and term over those of a single product: denser terms are multiplied as a matrix.
DENSE = 1 / 150

_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = 1, 2, 3, 4, 9
_TABLE = 0x530


def default_tokenizer() -> str:
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Classes of the first code points, whose categories no version of Unicode has changed; others are unsure."""
    out = np.full(_TABLE + 1, _UNSURE, np.uint8)
    for i in range(_TABLE):
        kind = unicodedata.category(chr(i))
        if i in (9, 10, 11, 12, 13, 32, 160):
            out[i] = _SPACE
        elif kind[0] == "L":
            out[i] = _LETTER
        elif kind[0] == "N":
            out[i] = _NUMBER
        elif kind[0] in "PS":
            out[i] = _OTHER
    return out


_CLASS = _classes()
_RANDOM = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, _TABLE + 1, dtype=K.U) * K.U(2) + K.U(1)


def _byte_signs() -> np.ndarray:
    """The code points that stand for the bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    out = np.arange(256, dtype="<u4")
    other = np.r_[:33, 127:161, 173]
    out[other] = 256 + np.arange(len(other))
    return out


_SIGN = _byte_signs()


def piece_starts(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece of the byte-level pre-tokenizer starts at each code point.

    Its rule: a contraction; or letters, digits or other signs, with one space before; or white space, of which the
    last character is left to what follows. ``first`` marks the first code point of each text.
    """
    n = len(cp)
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | first[1:]
    start = change.copy()
    last = np.ones(n, bool)  # the last code point of its run
    last[:-1] = change[1:]
    followed = np.zeros(n, bool)  # something of the same text follows
    followed[:-1] = ~first[1:]
    tail = (kind == _SPACE) & last & followed
    start |= tail
    joined = np.zeros(n, bool)  # begins a run that takes the space before
    joined[1:] = tail[:-1] & (cp[:-1] == 32)
    start &= ~joined
    quote = np.flatnonzero((cp == 39) & change & last & followed & ~joined)
    if len(quote):
        at = np.minimum(quote[:, None] + [1, 2], n - 1)
        one, two = cp[at[:, 0]], cp[at[:, 1]]
        pair = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        pair &= (quote + 2 < n) & ~first[at[:, 1]] & ~change[at[:, 1]]
        short = np.isin(one, [115, 116, 109, 100]) & ~pair
        for on, size in ((short, 1), (pair, 2)):
            q = quote[on]
            start[q + 1] = False
            rest = q + 1 + size
            rest = rest[rest < n]
            start[rest] |= (kind[rest] == _LETTER) & ~first[rest]
    return start


class Encoder:
    """Token ids of many texts. Distinct pieces are encoded once by the tokenizer and remembered.

    Where more than ``REMEMBERED`` would be, the half that the fewest steps needed goes. Texts with a code point whose
    class is unsure go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        said = json.loads(self.model.to_str())
        before = said["pre_tokenizer"] or {}
        #: Whether a piece's ids are those of the BPE model alone, without the steps around it.
        self.plain = said["normalizer"] is None and said["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and all(x["special"] for x in said["added_tokens"])
        #: Sorted hashes of the remembered pieces; where their ids begin, how many they are, how often steps needed them.
        self.slot = np.zeros(0, K.U)
        self.begin, self.size, self.uses = np.zeros((3, 0), np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has."""
        bpe = getattr(self.model, "model", None) if self.plain else None
        if bpe is not None:
            signs = _SIGN[np.frombuffer("".join(texts).encode(), np.uint8)].tobytes().decode("utf-32-le")
            end = np.cumsum([len(x.encode()) for x in texts]).tolist()
            ids = [[x.id for x in bpe.tokenize(signs[a:b])] for a, b in zip([0, *end[:-1]], end, strict=True)]
            size = np.array([len(x) for x in ids], np.int64)
            return np.fromiter(chain.from_iterable(ids), np.int32, size.sum()), size
        found = [self.model.encode(texts[a : a + 4096], is_pretokenized=True, add_special_tokens=False) for a in range(0, len(texts), 4096)]
        size = [np.bincount(np.array(x.word_ids, np.int64), minlength=min(4096, len(texts) - 4096 * i)) for i, x in enumerate(found)]
        return np.concatenate([np.array(x.ids, np.int32) for x in found]), np.concatenate(size)

    def _forget(self) -> None:
        if len(self.slot) <= REMEMBERED:
            return
        on = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        begin, size = self.begin[on], self.size[on]
        self.slot, self.size, self.uses = self.slot[on], size, self.uses[on] // 2
        self.begin = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(begin - self.begin, size) + np.arange(size.sum())]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by END_ID, and the texts' offsets in them."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
        small = np.minimum(cp, _TABLE)
        kind = _CLASS[small]
        first = np.zeros(len(cp), bool)
        first[offs[:-1][offs[:-1] < len(cp)]] = True
        starts = np.flatnonzero(piece_starts(cp, kind, first)) if len(cp) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(cp))
        h = K.hash_spans(small, starts, ends, _RANDOM)
        unsure = np.concatenate([[0], np.cumsum(kind == _UNSURE)])
        whole = np.flatnonzero(np.diff(unsure[offs]))
        row = np.searchsorted(offs, starts, "right") - 1
        if len(whole):
            sure = ~np.isin(row, whole)
            starts, ends, h, row = starts[sure], ends[sure], h[sure], row[sure]
        distinct, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.slot, distinct)
        known = np.append(self.slot, K.U(0))[at] == distinct
        known &= at < len(self.slot)
        new = np.flatnonzero(~known)
        if len(new):
            ids, size = self._learn([joined[a:b] for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)])
            values = (distinct[new], len(self.ids) + np.cumsum(size) - size, size, np.zeros(len(new), np.int64))
            self.slot, self.begin, self.size, self.uses = (np.insert(x, at[new], y) for x, y in zip((self.slot, self.begin, self.size, self.uses), values, strict=True))
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.slot, distinct)
        self.uses[at] += 1
        slots = at[inverse]
        begin, size = self.begin[slots], self.size[slots]
        count = np.bincount(row, size, len(texts)).astype(np.int64)
        extra = {int(i): x.ids for i, x in zip(whole, self.model.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True)} if len(whole) else {}
        for i, x in extra.items():
            count[i] = len(x)
        bounds = np.concatenate([[0], np.cumsum(count + 1)])
        out = np.full(bounds[-1], END_ID, np.int32)
        inner = np.cumsum(size) - size  # ids before each piece, over the sure texts
        flat = self.ids[np.repeat(begin - inner, size) + np.arange(size.sum())]
        sure_rows = np.setdiff1d(np.arange(len(texts)), whole)
        n = count[sure_rows]
        out[np.repeat(bounds[sure_rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = flat
        for i, x in extra.items():
            out[bounds[i] : bounds[i] + len(x)] = x
        self._forget()
        return out, bounds


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first-word numbers of the texts, and the words' places among the hashed terms."""
    word, first = K.words(*K.text_buffer(column))
    return word, first, (word >> K.U(64 - TERM_BITS)).astype(np.int64)


def _grouped(place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs with their counts."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, count = np.unique((row << TERM_BITS) | place, return_counts=True)
    return pairs >> TERM_BITS, pairs & ((1 << TERM_BITS) - 1), count


def term_statistics(docs: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequencies of the hashed terms, number of documents and mean length, over all of ``docs``.

    Each task sends one row for each place at most, so what is gathered has a fixed size.
    """

    def run(batches):
        total = np.zeros((1 << TERM_BITS) + 2, np.int64)
        for batch in K.parts(batches, "text", STEP_BYTES):
            _, first, place = _terms(batch["text"])
            total[:-2] += np.bincount(_grouped(place, first)[1], minlength=1 << TERM_BITS)
            total[-2:] += [batch.num_rows, len(place)]
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["place", "n"])

    out = np.zeros((1 << TERM_BITS) + 2, np.int64)
    for r in docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.place] = r.n
    return out[:-2].astype(np.float32), int(out[-2]), float(out[-1]) / max(1, int(out[-2]))


class Shard:
    """An inverted index over the documents of one shard, with BM25 weights from the statistics of all."""

    def __init__(self, first: np.ndarray, place: np.ndarray, idf: np.ndarray, mean: float):
        self._build(np.diff(first), *_grouped(place, first), idf, mean)

    @classmethod
    def of_counts(cls, words: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float) -> Shard:
        """The index of documents whose terms are counted already."""
        out = cls.__new__(cls)
        out._build(words, row, term, tf, idf, mean)
        return out

    def _build(self, words: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.n = len(words)
        length = words[row]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = row[order], weight[order]
        self.terms, begin, size = np.unique(term[order], return_index=True, return_counts=True)
        self.begin, self.size = begin, size
        self.of = np.searchsorted(self.terms, term)  # the terms of each document, by document
        self.bounds = np.searchsorted(row, np.arange(self.n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with ``seed``, best first; equal scores in the shard's order."""
        terms = self.of[self.bounds[seed] : self.bounds[seed + 1]]
        if not len(terms):  # no term, no neighbour: such documents follow in order
            return terms
        size = self.size[terms]
        at = np.repeat(self.begin[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def _windows(shard: Shard, bounds: np.ndarray, room: int) -> Iterator[tuple[int, int, int, bool]]:
    """``(document, from, to, full)``: pieces in order; ``full`` where a piece fills its window. ``room`` is left in the first."""
    unused = np.ones(shard.n, bool)
    length = np.diff(bounds)
    following = 0
    queue: list[int] = []
    while True:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while following < shard.n and not unused[following]:
                following += 1
            if following == shard.n:
                return
            doc = following
        unused[doc] = False
        at, cut = 0, False
        while at < length[doc]:
            to = min(int(length[doc]), at + room)
            room -= to - at
            yield doc, at, to, room == 0
            at = to
            if room == 0:
                room, cut = WINDOW, True
        if cut or not queue:  # the window holds the end of this document first: it is the seed
            queue = shard.neighbours(doc, unused)[::-1].tolist() if room < WINDOW else []


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES, every: int | None = None) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: the pieces of all documents in windows.

    ``ids`` are the piece's token ids as little-endian 32-bit words. Documents are ordered by MinHashes of their words,
    encoded once, and written with their terms. Windows are then filled in rounds (``_rounds``): each seed is scored by
    BM25 against every unused document of the corpus, with document frequencies of all. A document goes to the seed
    that scores it best, a seed takes its documents best first until its window is full, and the last is cut there;
    what is left of it is preferred as a seed of the next round. A document longer than a window fills windows of its
    own first, and its rest is a seed.

    When the rest is a shard of ``shard_bytes`` at most, one task packs it by the same scores, one seed after another.
    Where no seed's window can be filled any more, the rest is packed in shards in the order of the MinHashes. Texts
    without a word have no neighbours and follow each other in that order, without a search. Only the last window of such a task is not full. It is cut at powers of two from the
    largest down, which need no padding: every sequence holds 2048 tokens or a smaller power of two. Each id is in
    exactly one piece, and a document's pieces come in order. Null and empty texts are the end id alone. Repeated rows
    are packed as often as they occur; a null id stays null. Other columns are ignored.

    With ``every``, the documents whose id is divisible by it are the queries (``_pack_by_queries``): all rows are scored
    against all of them, in one search instead of rounds.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df, n, mean = term_statistics(docs)
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))
    frequent = np.sort(np.argsort(-df, kind="stable")[:FREQUENT])
    if every:
        return _pack_by_queries(docs, every, n, idf, frequent, mean, path)

    def keys(batches):
        for batch in K.parts(batches, "text", STEP_BYTES):
            word, first, _ = _terms(batch["text"])
            out = []
            for salt in (3, 5):
                h = np.append(K.mix(word ^ K.U(salt)) >> K.U(1), K.U((1 << 63) - 1))
                low = np.minimum.reduceat(h, np.minimum(first[:-1], len(word)))
                out.append(np.where(np.diff(first) > 0, low, K.U(0)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], *map(pa.array, out)], names=["doc_id", "text", "m1", "m2"])

    def encode(batches):
        encoder, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in K.parts(batches, "text", STEP_BYTES):
            tokens, bounds = encoder.encode(batch["text"].to_pylist())
            _, first, place = _terms(batch["text"])
            row, term, tf = _grouped(place, first)
            terms = np.searchsorted(row, np.arange(batch.num_rows + 1))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int64)), pa.array(np.arange(at, at + m)), batch["doc_id"], pa.array(np.diff(bounds)), pa.array(np.diff(first).astype(np.int64)), _blobs(term, terms), _blobs(tf, terms), _blobs(tokens, bounds)],
                names=["part", "at", "doc_id", "size", "words", "terms", "tf", "ids"],
            )
            at += m
            del tokens, place, row, term, tf
            pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batches took

    rows = docs.mapInArrow(keys, "doc_id long, text string, m1 long, m2 long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "m1", "m2", "doc_id").sortWithinPartitions("m1", "m2", "doc_id")
    folder = shared_dir(spark)
    rows.select("doc_id", "text").mapInArrow(encode, "part long, at long, doc_id long, size long, words long, terms binary, tf binary, ids binary").write.parquet(folder)
    table = spark.read.parquet(folder)
    counts = {r.part: r.n for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}
    base = np.zeros(max(counts, default=-1) + 2, np.int64)
    for p, c in counts.items():
        base[p + 1] = c
    base = np.cumsum(base)
    uid = F.element_at(F.lit(base.tolist()), (F.col("part") + 1).cast("int")) + F.col("at")
    table = table.withColumn("uid", uid)
    placed, left, alone = _rounds(table, folder, base, idf, frequent, mean, shard_bytes)

    def rest(kind):
        def run(batches):
            origin = (kind << 54) | (TaskContext.get().partitionId() << 32)
            sequence, room = 0, WINDOW
            held: list[list] = []  # pieces of the window that is being filled

            def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                nonlocal sequence, room, held
                x = pa.Table.from_batches(parts).combine_chunks()
                uids, start = x["uid"].to_numpy(), x["start"].to_numpy()
                words, terms = x["words"].to_numpy(), x["terms"].combine_chunks()
                size = np.concatenate([[0], np.cumsum(x["size"].to_numpy())])
                shard, out = Shard.of_counts(words, *_unblob(terms, x["tf"].combine_chunks()), idf.value, mean), []
                for doc, a, b, full in _windows(shard, size, room):
                    held.append([int(uids[doc]), int(start[doc]) + a, b - a, origin + sequence, WINDOW - room])
                    room -= b - a
                    if full:
                        out += held
                        held, room, sequence = [], WINDOW, sequence + 1
                if out:
                    yield _placements(out)

            waiting, held_bytes, rows = [], 0, 0
            for batch in K.parts(batches, "terms", shard_bytes // 4):
                waiting.append(batch)
                held_bytes, rows = held_bytes + batch["terms"].nbytes, rows + batch.num_rows
                if held_bytes >= shard_bytes or rows >= SHARD_ROWS:
                    yield from flush(waiting)
                    waiting, held_bytes, rows = [], 0, 0
            if waiting:
                yield from flush(waiting)
            if held:
                yield _placements(_cut_last(held, origin + sequence))

        return run

    narrow = table.select("uid", "words", "terms", "tf")
    some = left.where("words > 0").select("uid", "start", "size").join(narrow, "uid")
    some = some.coalesce(1).sortWithinPartitions("uid") if alone else some.repartitionByRange(parts, "uid").sortWithinPartitions("uid")
    none = left.where("words = 0").select("uid", "start", "size").join(narrow, "uid").repartitionByRange(parts, "uid").sortWithinPartitions("uid")
    for kind, x in ((510, some), (511, none)):
        placed = placed.union(x.select("uid", "start", "size", "words", "terms", "tf").mapInArrow(rest(kind), _PLACED))
    pieces = materialise(placed).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))

    def cut(batches):
        for batch in K.parts(batches, "ids"):
            out = []
            for i in range(batch.num_rows):
                ids, doc, size = batch["ids"][i].as_buffer(), batch["doc_id"][i].as_py(), batch["size"][i].as_py()
                for p in batch["pieces"][i].as_py():
                    out.append([doc, p["start"], p["length"], ids.slice(4 * p["start"], 4 * p["length"]).to_pybytes(), size, p["sequence_id"], p["offset"]])
                    if len(out) >= 2000:
                        yield _pieces(out)
                        out = []
            if out:
                yield _pieces(out)

    whole = table.select("uid", "doc_id", "size", "ids").join(pieces, "uid").select("doc_id", "size", "ids", "pieces")
    return whole.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _pack_by_queries(docs: DataFrame, every: int, n: int, idf, frequent: np.ndarray, mean: float, path: str) -> DataFrame:
    """Pieces of documents in the order of their queries.

    The documents with words whose id is divisible by ``every`` are the queries. Each of the others is scored by BM25
    against all of them and follows the one it is most alike to (``nearest``), best first. Range partitions of that
    order are cut into windows, so that no task gets a group whole; the last window of a task is cut at powers of two.
    Documents that share no term with a query come by id, in front.
    """
    spark = docs.sparkSession
    column = np.full(1 << TERM_BITS, -1, np.int32)
    column[frequent] = np.arange(len(frequent))
    columns = spark.sparkContext.broadcast(column)

    def drawn(batches):
        for batch in K.parts(batches, "text", STEP_BYTES):
            _, first, place = _terms(batch["text"])
            row, term, _ = _grouped(place, first)
            c = columns.value[term]
            row, c = row[c >= 0], c[c >= 0]
            yield pa.RecordBatch.from_arrays([_blobs(c, np.searchsorted(row, np.arange(batch.num_rows + 1)))], names=["columns"])

    def terms(batches):
        for batch in K.parts(batches, "text", STEP_BYTES):
            _, first, place = _terms(batch["text"])
            row, term, _ = _grouped(place, first)
            kind = _kinds(row, columns.value[term], batch.num_rows, centres)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(kind), _blobs(term, np.searchsorted(row, np.arange(batch.num_rows + 1)))], names=["doc_id", "kind", "terms"])

    queries = docs.where(F.col("doc_id") % every == 0)
    some = queries.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 + n // (every * GROUP_SAMPLE))) == 0).mapInArrow(drawn, "columns binary").limit(2 * GROUP_SAMPLE)
    centres = _centres([np.frombuffer(r.columns, "<i4") for r in some.collect()], len(frequent))
    queries = materialise(queries.mapInArrow(terms, "doc_id long, kind long, terms binary").where("length(terms) > 0"))
    folder = shared_dir(spark)  # queries with the same terms have the same scores: the smallest id stands for them
    distinct = queries.groupBy("kind", "terms").agg(F.min("doc_id").alias("doc_id")).repartition(max(1, n // (every * FILE_ROWS)))
    distinct.sortWithinPartitions("kind", F.length("terms"), "doc_id").write.parquet(folder)

    def follow(batches):
        encoder = _encoder(path)
        for block in _blocks(batches):
            query, score = _followed(block, every, folder, idf.value, columns.value, centres, mean)
            done = 0
            for x in K.parts(iter([block]), "text", STEP_BYTES):
                tokens, bounds = encoder.encode(x["text"].to_pylist())
                m, kind = x.num_rows, "<u2" if tokens.max() < 1 << 16 else "<u4"
                yield pa.RecordBatch.from_arrays(
                    [x["doc_id"], pa.array(np.diff(bounds)), _blobs(tokens, bounds, kind), query.slice(done, m), score.slice(done, m)], names=["doc_id", "size", "ids", "query", "score"]
                )
                done += m
            del block, x
            pa.default_memory_pool().release_unused()

    rows = materialise(docs.mapInArrow(follow, "doc_id long, size long, ids binary, query long, score float"))
    tokens = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    order = ["query", F.desc("score"), "doc_id"]
    rows = rows.repartitionByRange(max(1, -(-tokens // TASK_TOKENS)), *order).sortWithinPartitions(*order)

    def cut(batches):
        origin, room, out = TaskContext.get().partitionId() << 32, WINDOW, []
        held: list[list] = []  # pieces of the window that is being filled
        for batch in K.parts(batches, "ids"):
            for doc, size, blob in zip(batch["doc_id"].to_pylist(), batch["size"].to_pylist(), batch["ids"], strict=True):
                ids = np.frombuffer(blob.as_buffer(), "<u2" if len(blob.as_buffer()) == 2 * size else "<u4")
                at = 0
                while at < size:
                    take = min(size - at, room)
                    held.append([doc, at, take, ids[at : at + take].astype("<u4").tobytes(), size, origin, WINDOW - room])
                    at, room = at + take, room - take
                    if not room:
                        out += held
                        held, room, origin = [], WINDOW, origin + 1
                    if len(out) >= 2000:
                        yield _pieces(out)
                        out = []
        for i, at, take, sequence, offset in _cut_last([[i, 0, x[2]] for i, x in enumerate(held)], origin) if held else []:
            doc, start, _, ids, size, *_ = held[i]
            out.append([doc, start + at, take, ids[4 * at : 4 * (at + take)], size, sequence, offset])
        if out:
            yield _pieces(out)

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks of ``BLOCK_BYTES`` and ``BLOCK_ROWS`` at most, full ones but for the last: all queries stream past each."""
    joined = lambda x: pa.Table.from_batches(x).combine_chunks().to_batches()[0]
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for part in K.parts(batches, "text", BLOCK_BYTES // 16):
        for at in range(0, part.num_rows, max(1, BLOCK_ROWS // 16)):
            x = part.slice(at, max(1, BLOCK_ROWS // 16))
            if held and (size + x["text"].nbytes > BLOCK_BYTES or rows + x.num_rows > BLOCK_ROWS):
                held, block = [], joined(held)
                yield block
                del block
                size = rows = 0
            held.append(x)
            size, rows = size + x["text"].nbytes, rows + x.num_rows
    if held:
        yield joined(held)


def _followed(block: pa.RecordBatch, every: int, folder: str, idf: np.ndarray, column: np.ndarray, centres: np.ndarray, mean: float) -> tuple[pa.Array, pa.Array]:
    """The query that each document follows, and the likeness; a query follows itself, a document like no query none."""
    found, done = [], 0
    for x in K.parts(iter([block]), "text", STEP_BYTES):
        _, first, place = _terms(x["text"])
        row, term, tf = _grouped(place, first)
        found.append([np.diff(first), *(y.astype(np.int32) for y in (row + done, term, tf))])
        done += x.num_rows
    words, row, term, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    doc_id = block["doc_id"].fill_null(0).to_numpy()
    own = (words > 0) & (doc_id % every == 0) & block["doc_id"].is_valid().to_numpy(zero_copy_only=False)
    other = np.flatnonzero((words > 0) & ~own)
    on = ~own[row]
    score = np.where(own, np.float32(np.inf), np.float32(0))
    follows = np.where(own, doc_id, 0)
    at = np.cumsum((words > 0) & ~own, dtype=np.int32) - 1
    follows[other], score[other] = nearest(words[other], at[row[on]], term[on], tf[on], folder, idf, column, centres, mean)
    return pa.array(follows, mask=score <= 0), pa.array(score)


def _centres(found: list[np.ndarray], wide: int) -> np.ndarray:
    """Directions that documents, given by their frequent terms, gather around (k-means of unit vectors, such as languages)."""
    x = np.zeros((len(found), wide), np.float32)
    for i, c in enumerate(found):
        x[i, c] = max(1, len(c)) ** -0.5
    x = x[x.any(axis=1)]
    draw = np.random.Generator(np.random.PCG64(9))
    centres = x[:1]
    for _ in range(GROUPS - 1):
        far = np.maximum(0, 1 - (x @ centres.T).max(axis=1, initial=0)).astype(np.float64)
        if far.sum() < 1e-3:
            break
        centres = np.concatenate([centres, x[[draw.choice(len(x), p=far / far.sum())]]])
    for _ in range(10):
        near = (x @ centres.T).argmax(axis=1) if len(centres) else np.zeros(0, np.int64)
        for g in np.unique(near):
            centre = x[near == g].sum(axis=0)
            centres[g] = centre / np.linalg.norm(centre)
    return centres


def _kinds(row: np.ndarray, c: np.ndarray, n: int, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each document, by the columns of its frequent terms."""
    if not len(centres):
        return np.zeros(n, np.int64)
    x = np.zeros((n, centres.shape[1]), np.float32)
    x[row[c >= 0], c[c >= 0]] = 1
    return (x @ centres.T).argmax(axis=1)


class _Together:
    """Documents or queries as lists by term, and the terms that most of them have as the rows of a matrix."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray | None = None):
        self.n, self.count = n, np.bincount(term, minlength=1 << TERM_BITS)
        often = np.flatnonzero(self.count * 64 >= n)
        often = often[self.count[often] > 0]
        self.often = np.sort(often[np.argsort(-self.count[often], kind="stable")[:WIDE]])
        self.column = np.full(1 << TERM_BITS, -1, np.int32)
        self.column[self.often] = np.arange(len(self.often))
        self.matrix = np.zeros((len(self.often), n), np.float32)
        c = self.column[term]
        on = c >= 0
        self.matrix[c[on], row[on]] = 1 if weight is None else weight[on]


def nearest(
    words: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, folder: str, idf: np.ndarray, column: np.ndarray, centres: np.ndarray, mean: float
) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a block the query in ``folder`` with the best score, and the score; 0 where no term is shared.

    The score is BM25 over the root of the query's number of terms, else long queries would get most documents; among
    the documents of one query this leaves BM25's order. All queries stream past, so the memory is bounded and the
    work is queries times documents. Both lie by group and number of terms, so that those scored together share many
    terms or few: terms that are dense among them are multiplied as a matrix, the others through lists; all of them
    count. Only queries so long that a document's whole weight over their root is no better are passed over. Of equal
    scores the first stored query's counts.
    """
    m = len(words)
    best, who = np.zeros(m, np.float32), np.zeros(m, np.int64)
    if not m:
        return who, best
    weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[row] / max(mean, 1e-9)))).astype(np.float32)  # of a type that came with a broadcast, np.add.at is slow
    whole = np.bincount(row, weight, m) * (1 + 1e-4)  # no score is more than this over the query's root
    size = np.bincount(row, minlength=m)
    order = np.lexsort((size, _kinds(row, column[term], m, centres)))
    begin, size = (np.cumsum(size) - size)[order], size[order]
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(begin - bounds[:-1], size) + np.arange(len(row))
    term, weight = term[at], weight[at]
    tiles = []
    for a in range(0, m, TOGETHER):
        docs, on = order[a : a + TOGETHER], slice(bounds[a], bounds[min(a + TOGETHER, m)])
        row = np.repeat(np.arange(len(docs), dtype=np.int32), size[a : a + TOGETHER])
        x = _Together(len(docs), row, term[on], weight[on])
        tiles.append((docs, x.often, x.count[x.often], x.matrix, row, term[on], weight[on]))
    del at, row, term, tf, weight, x
    for ids, q, t in _stored_queries(folder):
        root = np.sqrt(np.bincount(q, minlength=len(ids))).astype(np.float32)
        query = _Together(len(ids), q, t)
        lists, first, lines = _lists(len(ids), q, t, query.count)
        wide = len(ids) + LISTED  # the last places are those that fill lists up
        for docs, often, count, matrix, row, term, weight in tiles:
            if (whole[docs] <= best[docs] * root.min()).all():
                continue
            c = query.column[often]
            on = (c >= 0) & (query.count[often] * count > DENSE * query.n * len(docs))
            score = np.zeros((len(docs), wide), np.float32)
            np.matmul(matrix[on].T, query.matrix[c[on]], out=score[:, :-LISTED])
            n = lines.copy()
            n[often[on]] = 0
            n = n.take(term)
            on = np.flatnonzero(n)
            n, at, to, w = n.take(on), first.take(term.take(on)), row.take(on) * np.int32(wide), weight.take(on)
            flat, total, done = score.reshape(-1), np.cumsum(n), 0
            at -= total - n
            for a in _steps(total, PRODUCTS // LISTED):
                now, stop = n[a], int(total[a][-1])
                line = np.repeat(at[a], now)
                line += np.arange(done, stop)
                cell = lists.take(line, axis=0).reshape(-1)
                cell += np.repeat(np.repeat(to[a], now), LISTED)
                np.add.at(flat, cell, np.repeat(np.repeat(w[a], now), LISTED))
                done = stop
            score = score[:, :-LISTED]
            score /= root
            value = score.max(axis=1)
            better = np.flatnonzero(value > best[docs])
            best[docs[better]], who[docs[better]] = value[better], ids[score[better].argmax(axis=1)]
    return who, best


def _stored_queries(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The queries some at a time: their ids, and the number of the query and the place of each of their terms."""
    for batch in _stored(folder, QUERIES, ["doc_id", "terms"]):
        total = np.cumsum(pc.binary_length(batch["terms"]).to_numpy(), dtype=np.int64) // 4
        for on in _steps(total, STEP_TERMS):
            part = batch.slice(on.start, on.stop - on.start)
            yield part["doc_id"].to_numpy(), *_unblob(part["terms"])


def _lists(n: int, q: np.ndarray, t: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The queries of each term in rows of ``LISTED``, each term's first row, and how many rows it has."""
    bits = max(1, n.bit_length())
    key = np.sort((t << bits) | q)
    t, q = key >> bits, key & ((1 << bits) - 1)
    lines = -(-count // LISTED)
    first = np.cumsum(lines) - lines
    lists = np.tile(np.arange(n, n + LISTED, dtype=np.int32), (int(lines.sum()), 1))
    lists.reshape(-1)[np.arange(len(t)) + (first * LISTED - (np.cumsum(count) - count)).take(t)] = q
    return lists, first, lines.astype(np.int32)


def _steps(total: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices whose part of the running ``total`` is at most ``limit``; a larger entry comes alone."""
    a = 0
    while a < len(total):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield slice(a, z)
        a = z


_PLACED = "uid long, start long, length long, sequence_id long, offset long"


def _placements(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=["uid", "start", "length", "sequence_id", "offset"])


def _blobs(values: np.ndarray, bounds: np.ndarray, kind: str = "<i4") -> pa.Array:
    """Each row's values as little-endian words, of 32 bits if not said otherwise."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((np.dtype(kind).itemsize * bounds).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _unblob(*columns: pa.Array) -> tuple[np.ndarray, ...]:
    """Row numbers of the values, and the values of each column."""
    size = np.array([len(x) // 4 for x in columns[0].to_pylist()], np.int64)
    values = [np.frombuffer(b"".join(x.to_pylist()), "<i4").astype(np.int64) for x in columns]
    return np.repeat(np.arange(len(size)), size), *values


def _bits(left: DataFrame, n: int) -> np.ndarray:
    """What each document is in this round: 0 used, 1 unused, 2 a seed; 64 documents arrive as a row of two words."""
    bit = F.expr("shiftleft(1L, cast(pmod(uid, 64) as int))")
    words = left.where("words > 0").groupBy(F.expr("uid div 64").alias("w")).agg(F.bit_or(bit).alias("a"), F.bit_or(F.when(F.col("seed"), bit).otherwise(F.lit(0).cast("long"))).alias("s"))
    out = np.zeros((2, n // 64 + 1), np.int64)
    for r in words.toLocalIterator():
        out[:, r.w] = r.a, r.s
    a, s = np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")
    return a + s


def search(table: DataFrame, folder: str, state: np.ndarray, base: np.ndarray, idf, frequent: np.ndarray, mean: float, best: int) -> DataFrame:
    """``(seed, doc, score)``: for each seed the ``best`` unused documents of the whole corpus by BM25.

    A task holds a block of seeds and streams the terms of all documents past it, so its memory is bounded and the
    rows it makes are ``best`` times its seeds; the work is seeds times documents. The most frequent terms are
    multiplied as a matrix, the others through an index of the block's seeds; all of them count. Equal scores are
    parted by noise of a hundred-thousandth, so that seeds of one group of copies don't all ask for the same ones.
    """
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(state)
    column = np.full(1 << TERM_BITS, -1, np.int64)
    column[frequent] = np.arange(len(frequent))
    columns = spark.sparkContext.broadcast(column)

    def seeds_of(batches):
        for batch in batches:
            u = base[batch["part"].to_numpy()] + batch["at"].to_numpy()
            on = pa.array(np.flatnonzero(shared.value[u] == 2))
            yield pa.RecordBatch.from_arrays([pa.array(u).take(on), batch["terms"].take(on)], names=["uid", "terms"])

    step = max(1, min(SEEDS, HELD // best))

    def run(batches):
        for block in batches:
            for at in range(0, block.num_rows, step):
                x = block.slice(at, step)
                yield from _best(x["uid"].to_numpy(), x["terms"], folder, shared.value, base, idf.value, columns.value, mean, best)

    blocks = max(1, -(-int((state == 2).sum()) // SEEDS))
    seeds = table.select("part", "at", "terms").mapInArrow(seeds_of, "uid long, terms binary").repartition(blocks)
    gathered = lambda batches: run([x.to_batches()[0]] if (x := pa.Table.from_batches(list(batches), pa.schema([("uid", pa.int64()), ("terms", pa.binary())])).combine_chunks()).num_rows else [])
    return materialise(seeds.mapInArrow(gathered, "seed long, doc long, score float"))


def _best(uids: np.ndarray, terms: pa.Array, folder: str, state: np.ndarray, base: np.ndarray, idf: np.ndarray, column: np.ndarray, mean: float, best: int) -> Iterator[pa.RecordBatch]:
    b = len(uids)
    row, term = _unblob(terms)
    dense = column[term] >= 0
    wide = int(column.max()) + 1
    query = np.zeros((b, wide), np.float32)
    query[row[dense], column[term[dense]]] = 1
    row, term = row[~dense], term[~dense]
    order = np.argsort(term, kind="stable")
    row, count = row[order], np.bincount(term, minlength=1 << TERM_BITS)
    begin = np.cumsum(count) - count
    noise = 1 + np.random.Generator(np.random.PCG64(int(uids[0]))).random((b, DOCS), np.float32) * np.float32(1e-5)
    limit = np.zeros(b, np.float32)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def trim():
        nonlocal kept, waiting
        s, d, v = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((d, -v, s))
        s, d, v = s[order], d[order], v[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        on = rank < best
        limit[s[rank == best - 1]] = v[rank == best - 1]
        kept = [(s[on], d[on], v[on])]
        waiting = 0

    for batch in _stored(folder, DOCS, ["part", "at", "words", "terms", "tf"]):
        u = base[batch["part"].to_numpy()] + batch["at"].to_numpy()
        on = pa.array(np.flatnonzero(state[u] == 1))
        if not len(on):
            continue
        u, m = u[on.to_numpy()], len(on)
        doc, t, tf = _unblob(batch["terms"].take(on), batch["tf"].take(on))
        length = batch["words"].take(on).to_numpy()[doc]
        w = (idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))).astype(np.float32)
        c = column[t]
        d = c >= 0
        matrix = np.zeros((wide, m), np.float32)
        matrix[c[d], doc[d]] = w[d]
        score = query @ matrix
        on = ~d & (count[t] > 0)
        doc, t, w = doc[on], t[on], w[on]
        total = np.cumsum(count[t])
        a = 0
        while a < len(t):  # in steps of bounded size
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PRODUCTS, "right")))
            n = count[t[a:z]]
            at = np.arange(n.sum()) + np.repeat(begin[t[a:z]] - (np.cumsum(n) - n), n)
            flat = row[at] * m + np.repeat(doc[a:z], n)
            score += np.bincount(flat, np.repeat(w[a:z], n), b * m).reshape(b, m).astype(np.float32)
            a = z
        score *= noise[:, :m]
        if best < m and (score > limit[:, None]).sum() > 2 * b * best:
            top = np.argpartition(-score, best, axis=1)[:, :best]
            s = np.repeat(np.arange(b), best)
            hit = top.ravel()
            on = score[s, hit] > limit[s]
            s, hit = s[on], hit[on]
        else:
            s, hit = np.nonzero(score > limit[:, None])
        kept.append((s, u[hit], score[s, hit]))
        waiting += len(s)
        if waiting > b * best:
            trim()
    if kept:
        trim()
        s, d, v = kept[0]
        for a in range(0, len(s), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(uids[s[a : a + (1 << 16)]]), pa.array(d[a : a + (1 << 16)]), pa.array(v[a : a + (1 << 16)])], names=["seed", "doc", "score"])


def _stored(folder: str, rows: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a shared folder, read inside a task some at a time."""
    import pyarrow.parquet as pq

    fs, root = pafs.FileSystem.from_uri(folder)
    for path in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root))):
        if path.endswith(".parquet"):
            with fs.open_input_file(path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)


def _rounds(table: DataFrame, folder: str, base: np.ndarray, idf, frequent: np.ndarray, mean: float, shard_bytes: int) -> tuple[DataFrame, DataFrame, bool]:
    """Full windows' pieces, what is left ``(uid, start, size, words)``, and whether that fits one shard.

    Seeds are about half as many as windows are left, so each finds several documents. Only full windows count; the
    documents of a seed whose window isn't full are free again for the others and for the next round. Where few
    windows fill up, the next lookup asks for more neighbours.
    """
    sizes = table.select("uid", "size", "words")
    own = F.expr(f"size div {WINDOW}")
    k = sizes.where(own > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), own - 1)))
    placed = materialise(k.select("uid", (F.col("k") * WINDOW).alias("start"), F.lit(WINDOW).cast("long").alias("length"), (F.shiftleft("uid", 20) + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    left = sizes.select("uid", (own * WINDOW).alias("start"), (F.col("size") - own * WINDOW).alias("size"), "words").where("size > 0")
    best = BEST
    over: list[DataFrame] = []
    for number in range(1, 500):
        # the state of a round is written, so that its lineage doesn't grow; the tables of the round before then go
        left = materialise(left)
        forget(*over)
        over = [left]
        tokens, docs, tails = left.where("words > 0").agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.count_if(F.col("start") > 0)).first()
        if 4 * tokens <= shard_bytes:
            return placed, left, True
        wanted = max(1.0, tokens / WINDOW / 2)
        from_tails = min(1.0, wanted / max(1, tails))
        others = max(0.0, wanted - tails) / max(1, docs - tails)
        draw = F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(1 << 30)) / float(1 << 30)
        now = left.withColumn("seed", (F.col("words") > 0) & (draw < F.when(F.col("start") > 0, from_tails).otherwise(others)))
        state = _bits(now, int(base[-1]))
        found = search(table, folder, state, base, idf, frequent, mean, best)
        over.append(found)
        room = now.where("seed").select(F.col("uid").alias("seed"), (WINDOW - F.col("size")).alias("room"))
        size = now.where("not seed").select(F.col("uid").alias("doc"), "start", "size")
        free = found.join(size, "doc").join(room, "seed")
        taken = []
        for _ in range(3):
            mine = free.withColumn("best", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "seed"))).where("best = 1")
            before = F.coalesce(F.sum("size").over(Window.partitionBy("seed").orderBy(F.desc("score"), "doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            mine = mine.withColumn("before", before).where("before < room")
            full = mine.withColumn("all", F.sum("size").over(Window.partitionBy("seed"))).where("all >= room")
            full = materialise(full.select("seed", "doc", "start", "size", "room", "before"))
            taken.append(full)
            over.append(full)
            free = free.join(full.select("doc"), "doc", "left_anti").join(full.select("seed").distinct(), "seed", "left_anti")
        full = taken[0].union(taken[1]).union(taken[2])
        sequence = F.lit(number << 54) + F.col("seed")
        length = F.least("size", F.col("room") - F.col("before"))
        pieces = full.select(F.col("doc").alias("uid"), "start", length.alias("length"), sequence.alias("sequence_id"), (WINDOW - F.col("room") + F.col("before")).alias("offset"))
        opened = full.select(F.col("seed").alias("uid"), "room").distinct()
        heads = opened.join(now, "uid").select("uid", "start", F.col("size").alias("length"), F.lit(0).cast("long").alias("offset"))
        heads = heads.select("uid", "start", "length", (F.lit(number << 54) + F.col("uid")).alias("sequence_id"), "offset")
        done = materialise(pieces.union(heads))
        used = done.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if not used and best >= docs:
            return placed, left, False
        best = min(MOST, 4 * best) if not used else min(MOST, 2 * best) if 8 * used < tokens else best
        if not used and best == MOST and best < docs:
            return placed, left, False
        placed = placed.union(done)
        took = done.select("uid", F.col("length").alias("taken"))
        left = left.join(took, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        left = left.select("uid", (F.col("start") + F.col("taken")).alias("start"), (F.col("size") - F.col("taken")).alias("size"), "words").where("size > 0")
    return placed, left, False


def _encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if getattr(_encoder, "path", None) != path:
        _encoder.path, _encoder.now = path, Encoder(path)
    return _encoder.now


def _cut_last(held: list[list], sequence: int) -> list[list]:
    """The pieces of a window that isn't full, in sequences of falling powers of two."""
    left = sum(x[2] for x in held)
    out, room, offset = [], 1 << (left.bit_length() - 1), 0
    for doc, start, length, *_ in held:
        at = 0
        while at < length:
            take = min(length - at, room)
            out.append([doc, start + at, take, sequence, offset])
            at, room, offset, left = at + take, room - take, offset + take, left - take
            if room == 0 and left:
                room, offset, sequence = 1 << (left.bit_length() - 1), 0, sequence + 1
    return out


_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


def _pieces(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
