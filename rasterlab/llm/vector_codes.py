"""Vector compression by product quantisation: codebooks learnt from all vectors, nearest entries found by Orchard's search."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.shared import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components lie below this in size, so that a vector's squared distance fits 64 bits.
LIMIT = 1 << 26
#: Rows searched together: the work arrays stay in cache.
BLOCK = 1 << 12


class Part(NamedTuple):
    """The entries of one codebook with, for each, all entries by their distance from it."""

    entries: np.ndarray  # entry, component
    order: np.ndarray  # entry, place in its list -> entry
    gap: np.ndarray  # entry, place in its list -> squared distance; the end has an endless one


def neighbours(entries: np.ndarray) -> Part:
    gap = ((entries[:, None] - entries[None]) ** 2).sum(-1)
    order = np.argsort(gap, axis=1, kind="stable")
    end = np.full((len(entries), 1), np.iinfo(np.int64).max - 3)
    return Part(entries, np.hstack([order, np.zeros_like(order[:, :1])]), np.hstack([np.take_along_axis(gap, order, 1), end]))


def nearest(part: Part, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``q``, the lower index where two are as near, and its squared distance.

    Orchard's search, all rows in step: a row walks the list of its best entry so far, measures what it hasn't yet
    marked, and jumps to the list of a better entry. It ends beyond twice its distance: whatever is as near as the
    best entry lies, by the triangle inequality, no further from that entry than this.
    """
    n, k = len(q), len(part.entries)
    best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    d = ((q - part.entries[0]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    live = np.arange(n)
    while len(live):
        b, place = best[live], at[live]
        near = (part.gap[b, place] + 3) // 4 <= d[live]
        live = live[near]
        c = part.order[b[near], place[near]]
        at[live] += 1
        fresh = ~seen[live, c]
        row, c = live[fresh], c[fresh]
        seen[row, c] = True
        off = q[row] - part.entries[c]
        got = np.einsum("ij,ij->i", off, off)
        better = (got < d[row]) | ((got == d[row]) & (c < best[row]))
        row = row[better]
        best[row], d[row], at[row] = c[better], got[better], 0
    return best, d


def kept_vectors(table: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds neither null nor non-finite components."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(vec.isNotNull() & finite)


def _scaled(column: pa.Array, width: int) -> np.ndarray:
    """Integer components, a row per vector; components that a shorter vector lacks are 0."""
    offs = column.offsets.to_numpy().astype(np.int64)
    values = np.floor(column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.float64) * SCALE)
    if len(values) and np.abs(values).max() >= LIMIT:
        raise ValueError(f"a component lies beyond {LIMIT // SCALE}: its squares don't fit 64 bits")
    size = np.diff(offs)
    if (size == width).all():
        return values.astype(np.int64).reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(offs[:-1] - offs[0], size)] = values
    return out


def _width(vectors: DataFrame, vec_col: str, parts: int) -> int:
    longest = vectors.agg(F.max(F.size(vec_col))).first()[0] or 0
    return -(-longest // parts) * parts


def _sums(vectors: DataFrame, books: np.ndarray, vec_col: str) -> DataFrame:
    """``(part, entry, n, s0, s1, ...)``: count and component sums of each entry's parts, added up in the tasks first."""
    parts, k, d = books.shape
    names = ["part", "entry", "n", *(f"s{j}" for j in range(d))]

    def run(batches):
        lists = [neighbours(b) for b in books]
        total = np.zeros((parts * k, 1 + d), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                v = _scaled(batch[vec_col].slice(at, BLOCK), parts * d)
                for p in range(parts):
                    q = v[:, p * d : (p + 1) * d]
                    best, _ = nearest(lists[p], q)
                    here = total[p * k : (p + 1) * k]
                    here[:, 0] += np.bincount(best, minlength=k)
                    for j in range(d):  # below 2^53 in a block, so exact
                        here[:, 1 + j] += np.bincount(best, q[:, j], k).astype(np.int64)
        on = np.flatnonzero(total[:, 0])
        columns = [pa.array((on // k).astype(np.int32)), pa.array((on % k).astype(np.int32)), *(pa.array(total[on, j]) for j in range(1 + d))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    found = vectors.select(vec_col).mapInArrow(run, ", ".join(f"{n} {'int' if i < 2 else 'long'}" for i, n in enumerate(names)))
    return found.groupBy("part", "entry").agg(*(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names[2:]))


def train(table: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks, (part, entry, component) integers, after ``rounds`` rounds over all kept vectors.

    They start as the parts of the first vectors by id, null ids last, equal ids by their components; fewer vectors
    than ``entries`` give as many entries, none an empty codebook. Vectors of unequal length count as filled up with
    zeros to the longest, which is rounded up to whole parts. In each round tasks add up what falls to each entry; the
    driver gets one row per entry.
    """
    vectors = kept_vectors(table, vec_col)
    width = _width(vectors, vec_col, parts)
    first = vectors.select(id_col, vec_col).orderBy(F.col(id_col).asc_nulls_last(), vec_col).limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, width // parts), np.int64)
    start = _scaled(pa.array([r[1] for r in first], pa.list_(pa.float64())), width)
    books = np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds if width else 0):
        for row in _sums(vectors, books, vec_col).collect():
            books[row["part"], row["entry"]] = [int(x) // int(row["n"]) for x in row[3:]]
    return books


def encode(table: DataFrame, books: np.ndarray, vec_col: str = "embedding") -> DataFrame:
    """The kept rows of ``table``, without their vectors, with ``code`` (two hex digits of the nearest entry for each
    part) and ``error`` (their squared distances, added up).

    Rows whose vector is null or holds null or non-finite components go. Other columns pass through, null ids and
    repeated rows too; columns named ``code`` and ``error`` are replaced. A component beyond 16,384 in size raises an
    error.
    """
    parts, k, d = books.shape
    keep = [c for c in table.columns if c not in (vec_col, "code", "error")]
    base = kept_vectors(table, vec_col).select(F.struct(*keep).alias("row") if keep else F.lit(None).cast("int").alias("row"), F.col(vec_col).alias("vector"))
    schema = f"row {base.schema['row'].dataType.simpleString()}, code string, error long"

    def run(batches):
        lists = [neighbours(b) for b in books]
        digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                v = _scaled(rows["vector"], parts * d)
                found = [nearest(lists[p], v[:, p * d : (p + 1) * d]) for p in range(parts)]
                code = digits[np.stack([x for x, _ in found], 1)].tobytes()
                text = pa.StringArray.from_buffers(len(v), pa.py_buffer(np.arange(len(v) + 1, dtype=np.int32) * 2 * parts), pa.py_buffer(code))
                yield pa.RecordBatch.from_arrays([rows["row"], text, pa.array(sum(x for _, x in found))], names=["row", "code", "error"])

    if not k:
        done = base.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        done = base.mapInArrow(run, schema)
    return done.select(*(F.col("row")[c].alias(c) for c in keep), "code", "error")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


#: A value with more than one row in so many is frequent; there are at most as many such values.
FREQUENT = 1000


def with_total(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows with an equal ``by``, nulls together.

    ``rows`` is written once. The totals of frequent values, ``FREQUENT`` at most, go to all tasks, so their rows
    aren't shuffled; the others are joined by value, each with few rows.
    """
    rows = materialise(rows)
    n = rows.count()
    totals = materialise(rows.groupBy(F.col(by).alias("total_of")).agg(F.sum(value).alias(name), F.count("*").alias("total_rows")))
    same = F.col(by).eqNullSafe(F.col("total_of"))
    much = F.col("total_rows") * FREQUENT > n
    frequent = rows.join(F.broadcast(totals.where(much)), same, "left")
    columns = [*rows.columns, name]
    rest = frequent.where("total_rows is null").select(*rows.columns).join(totals.where(~much), same)
    return frequent.where("total_rows is not null").select(*columns).union(rest.select(*columns))
