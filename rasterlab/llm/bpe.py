"""Byte-level BPE as Spark jobs: words split in Spark, each distinct word encoded once, ids joined back by position."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from rasterlab.llm.shared import bucketed

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of text whose words are numbered together; a longer text comes alone.
CHUNK = 32 << 20
#: Bytes of decoded texts in a batch that goes back to Spark.
OUT_BYTES = 4 << 20
#: Last code point of Unicode, and those that texts can't hold.
LAST, SURROGATES = 0x110000, range(0xD800, 0xE000)


def _spans(one: str, split, within: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of characters in ``within`` that the tokenizer joins with the character ``one``.

    Asked for blocks of characters, and for their halves where only some are joined.
    """
    out: list[tuple[int, int]] = []

    def ask(a: int, b: int) -> None:
        words = split(one + "".join(map(chr, range(a, b))))
        if len(words) == 1:
            if out and out[-1][1] == a:
                a = out.pop()[0]
            out.append((a, b))
        elif b - a > 1 and not (b - a > 8 and len(words[0][0]) == 1 and _none(one, a, b, split)):
            ask(a, (a + b) // 2)
            ask((a + b) // 2, b)

    for begin, end in within:
        for a in range(begin, end, 256):
            ask(a, min(a + 256, end))
    return out


def _without(runs: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of ascending ``runs`` is left without ``taken``, ascending runs inside them."""
    out, rest = [], list(taken)
    for a, b in runs:
        while rest and rest[0][0] < b:
            c, d = rest.pop(0)
            if a < c:
                out.append((a, c))
            a = d
        if a < b:
            out.append((a, b))
    return out


def _none(one: str, a: int, b: int, split) -> bool:
    """Whether the tokenizer joins none of the characters with ``one``, each of which stands between two of it."""
    return len(split(one + one.join(map(chr, range(a, b))) + one)) >= 2 * (b - a) + 1


@lru_cache
def word_pattern(path: str = VOCABULARY) -> str:
    """The pattern of the tokenizer's words for Spark's regular expressions.

    Which characters are letters, numbers or neither is asked of the tokenizer, as Java knows another version of
    Unicode; what is none of the three is white space.
    """
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def group(ascii_part: str, runs: list[tuple[int, int]]) -> str:
        """Runs in nested groups, each behind a test of its range, so that a character meets few of them."""
        parts = []
        for at in range(0, len(runs), 24):
            some = runs[at : at + 24]
            inner = "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for a, b in some)
            parts.append(f"[\\x{{{some[0][0]:x}}}-\\x{{{some[-1][1] - 1:x}}}&&[{inner}]]")
        return f"[{ascii_part}[\\x{{80}}-\\x{{10FFFF}}&&[{''.join(parts)}]]]"

    left = [(128, SURROGATES.start), (SURROGATES.stop, LAST)]
    found = []
    for one in "!a1":
        found.append(_spans(one, split, left))
        left = _without(left, found[-1])
    others, letters, numbers = found
    letter, number, other = group("a-zA-Z", letters), group("0-9", numbers), group(r"\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f", others)
    space = group(r"\x09-\x0d\x20", left)
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{space}+(?={space}|\\z)|{space}+"


@lru_cache
def special_tokens(path: str = VOCABULARY) -> tuple[str, ...]:
    """The added tokens; their strings are cut out of a text before it is split into words."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that also take their surroundings aren't supported")
    return tuple(sorted((t["content"] for t in added), key=len, reverse=True))


def split_words(text: Column, path: str = VOCABULARY) -> Column:
    """The tokenizer's words of a text, in order and without loss; added tokens are words of their own."""
    pattern = F.lit(word_pattern(path))
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.regexp_extract_all(text, pattern, F.lit(0))
    special = "|".join(re.escape(t) for t in special_tokens(path))
    if not special:
        return plain
    found = F.regexp_extract_all(text, F.lit(special), F.lit(0))
    between = F.transform(
        F.split(text, special, -1),
        lambda s, i: F.concat(F.regexp_extract_all(s, pattern, F.lit(0)), F.when(i < F.size(found), F.array(F.get(found, i))).otherwise(F.array().cast("array<string>"))),
    )
    return F.when(F.size(found) > 0, F.flatten(between)).otherwise(plain)


@lru_cache
def _tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(words: list[str], path: str = VOCABULARY) -> list[list[int]]:
    """The ids of words. A word split off a text has the same ids alone as within it."""
    return [e.ids for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)]


def pieces(path: str = VOCABULARY) -> dict[int, bytes]:
    """The bytes of each id of the vocabulary.

    In a byte-level vocabulary each character of a token stands for a byte: printable Latin-1 characters for their
    own code, the other bytes in ascending order for the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    added = set(special_tokens(path))
    return {i: token.encode() if token in added else bytes(byte[c] for c in token) for token, i in _tokenizer(path).get_vocab().items()}


@lru_cache
def _piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces one after the other, with the start and size of each by id."""
    table = pieces(path)
    all_ids = [table.get(i, b"") for i in range(max(table) + 1)]
    size = np.array([len(x) for x in all_ids])
    return np.frombuffer(b"".join(all_ids), np.uint8), np.cumsum(size) - size, size


def decode(rows: DataFrame, key: str, path: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` -> ``(key, bytes)``: every id is joined with its piece, pieces follow each other by position.

    ``key`` is unique, ``ids`` an array. An id outside the vocabulary has no piece and is skipped; null and empty lists
    give no bytes. The pieces are broadcast: they are as many as the vocabulary has.
    """
    table = rows.sparkSession.createDataFrame([(i, x.hex()) for i, x in pieces(path).items()], "id int, piece string")
    each = rows.select(key, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    placed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return placed.select(key, F.unhex(F.array_join(F.col("pieces.piece"), "")).alias("bytes"))


def _packed(numbers: np.ndarray) -> bytes:
    """Word numbers byte by byte of their size, compressed: frequent words have small numbers."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T), 6)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks number the distinct words of a chunk of texts, frequent ones first: a row for the chunk with its texts'
    rows, their word counts and all word numbers in order, then a row for each distinct word."""
    names = ["chunk", "rows", "counts", "numbers", "number", "word"]
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        words, row = batch["words"], batch["row"]
        offs = words.offsets.to_numpy().astype(np.int64)
        flat = words.values
        width = np.dtype(np.int64 if pa.types.is_large_string(flat.type) else np.int32)
        size = np.frombuffer(flat.buffers()[1], width, len(flat) + 1, flat.offset * width.itemsize)[offs].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + CHUNK, "right")) - 1)
            own = flat.slice(offs[at], offs[to] - offs[at]).dictionary_encode()
            place = own.indices.to_numpy()
            order = np.argsort(-np.bincount(place, minlength=len(own.dictionary)), kind="stable")
            number = np.empty(len(order), "<u4")
            number[order] = np.arange(len(order))
            bounds = pa.array([0, to - at], pa.int32())
            rows, counts = pa.ListArray.from_arrays(bounds, row.slice(at, to - at)), pa.ListArray.from_arrays(bounds, pa.array(np.diff(offs[at : to + 1]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), rows, counts, pa.array([_packed(number[place])], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())], names=names)
            for a in range(0, len(order), 1 << 16):
                some = own.dictionary.take(pa.array(order[a : a + (1 << 16)])).cast(pa.string())
                n = len(some)
                empty = [pa.nulls(n, rows.type), pa.nulls(n, counts.type), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *empty, pa.array(np.arange(a, a + n, dtype=np.int32)), some], names=names)
            chunk += 1
            at = to


def _encode(path: str):
    """A function that encodes words, each once, and sorts their ids by the chunks that hold them: a row for each chunk
    of a batch, with the numbers of its words, their id counts and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[list[int]] = []
            for at in range(0, batch.num_rows, 1024):
                ids += encode_words(batch["word"].slice(at, 1024).to_pylist(), path)
            count = np.array([len(x) for x in ids])
            flat = np.fromiter((i for x in ids for i in x), np.int64, count.sum())
            places = batch["places"]
            chunk, number = (places.flatten().field(n).to_numpy() for n in ("chunk", "number"))
            word = np.repeat(np.arange(len(ids)), places.value_lengths().to_numpy())
            order = np.lexsort([number, chunk])
            own, begin = np.unique(chunk[order], return_index=True)
            rows = []
            for part in np.split(order, begin[1:]):
                found, _ = _gather(flat, np.cumsum(count) - count, count, word[part])
                rows.append([_packed(x) for x in (np.diff(number[part], prepend=0), count[word[part]], found)])
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["of", "steps", "sizes", "ids"])

    return run


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``data`` named by ``pick``, one after the other, and the offset of each."""
    size = sizes[pick]
    offs = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts[pick] - offs[:-1], size) + np.arange(offs[-1])], offs


def _joined(data: bytearray, ends: list[int], kind: pa.DataType) -> pa.Array:
    """The values that lie one after the other in ``data``, which isn't copied."""
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(np.array([0, *ends], np.int32)), pa.py_buffer(data)])


def _placed(path: str):
    """A function for the texts and words of a chunk. Ids of a chunk's texts by their words' positions, and their bytes by their ids' pieces; a text at a time."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        number, size, data = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for r in words.to_pylist():
            number.append(np.cumsum(_unpacked(r["steps"])))
            size.append(_unpacked(r["sizes"]))
            data.append(_unpacked(r["ids"]))
        number, size, data = (np.concatenate(x).astype(np.int64) for x in (number, size, data))
        sizes, starts = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        sizes[number], starts[number] = size, np.cumsum(size) - size
        numbers = _unpacked(texts["numbers"][0].as_buffer())
        row, out, at = texts["rows"][0].values, [], 0
        n_tokens, id_bytes, id_ends, decoded, ends = [], bytearray(), [], bytearray(), []
        counts = texts["counts"][0].values.to_numpy()
        for i, n in enumerate(counts, 1):
            found, _ = _gather(data, starts, sizes, numbers[at : at + n])
            at += n
            n_tokens.append(len(found))
            id_bytes += found.astype("<u4").tobytes()
            id_ends.append(len(id_bytes))
            decoded += _gather(*_piece_bytes(path), found)[0].tobytes().decode("utf-8", "replace").encode()
            ends.append(len(decoded))
            if len(decoded) >= OUT_BYTES or i == len(counts):
                part = [row.slice(i - len(ends), len(ends)), pa.array(n_tokens, pa.int64()), _joined(id_bytes, id_ends, pa.binary()), _joined(decoded, ends, pa.string())]
                out.append(pa.RecordBatch.from_arrays(part, names=["row", "n_tokens", "ids", "decoded"]))
                n_tokens, id_bytes, id_ends, decoded, ends = [], bytearray(), [], bytearray(), []
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)

    return run


def encode_decode(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``.

    The ids are the tokenizer's for the whole text without special tokens added; a special token's string in a text
    is that token. Chunks of texts number their distinct words; a table bucketed by chunk holds their word numbers
    and distinct words. Every distinct word is encoded once, in the row that gathers the chunks which hold it, at most
    one element for each chunk; its ids go back to these chunks, packed, and there to its positions. Only distinct words of
    chunks are shuffled, as the table's buckets are the partitions of the last step. Documents are decoded from their
    ids, each joined with its piece; the pieces are as many as the vocabulary has. Null and empty texts have no ids and
    decode to an empty text. Other columns pass through, null ids and repeated rows too; columns named as the new ones
    are replaced.
    """
    added = ("n_tokens", "ids", "decoded")
    keep = [c for c in docs.columns if c != text_col and c not in added]
    row = F.struct(F.lit(0).alias("_0"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep, 1)))
    base = docs.select(row.alias("row"), split_words(F.col(text_col), path).alias("words"))
    kind = base.schema["row"].dataType.simpleString()
    chunks = bucketed(base.mapInArrow(_number, f"chunk long, rows array<{kind}>, counts array<int>, numbers binary, number int, word string"), "chunk")
    places = chunks.where("word is not null").groupBy("word").agg(F.collect_list(F.struct("chunk", "number")).alias("places"))
    words = places.mapInArrow(_encode(path), "of long, steps binary, sizes binary, ids binary")
    texts = chunks.where("numbers is not null").select("chunk", "rows", "counts", "numbers")
    done = texts.groupBy("chunk").cogroup(words.groupBy("of")).applyInArrow(_placed(path), f"row {kind}, n_tokens long, ids binary, decoded string")
    return done.select(*(F.col("row")[f"_{i}"].alias(c) for i, c in enumerate(keep, 1)), *added)
