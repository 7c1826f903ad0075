"""NumPy kernels over the byte buffer of an Arrow text column: spans, hashes, shingles, sketches.

A column of texts is one uint8 buffer and int64 offsets. A span is a run of bytes inside one text. Every function
here works on whole buffers, without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed at once, so that the work arrays stay in cache.
SEGMENT = 1 << 17
_M = U(0x9E3779B97F4A7C15)
_M_INVERSE = U(pow(int(_M), -1, 1 << 64))
_SHINGLE = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)
_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
#: The ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random words for the bytes as they are, and with A-Z as a-z.
EXACT = _RANDOM
FOLDED = _RANDOM.copy()
FOLDED[65:91] = _RANDOM[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = [_powers(_M, 2 * SEGMENT), _powers(_M_INVERSE, 2 * SEGMENT)]


def powers(n: int) -> list[np.ndarray]:
    if n > len(_POWER[0]):
        return [_powers(_M, n), _powers(_M_INVERSE, n)]
    return _POWER


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column].cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes where ``inside`` holds, and the number of the first run of each text."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    first = np.zeros(n, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    cut = ~inside
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= cut[:-1] | first[1:]
    end[:-1] &= cut[1:] | first[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are ascending and disjoint. Equal bytes (under ``table``) give equal hashes."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(starts, base + SEGMENT, "left"))
        stop = int(max(ends[j - 1], base))
        up, down = powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, U)
        value = table[buf[base:stop]]
        value *= up[: stop - base]
        np.cumsum(value, out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * U(0xD1B54A32D192ED03))
        i = j
    return out


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z folded) and the number of each text's first word."""
    starts, ends, first = spans(buf, offs, ~SPACE[buf])
    return hash_spans(buf, starts, ends, FOLDED), first


def shingles(word: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, and each text's offset in them.

    A text with fewer words has one shingle, its whole sequence; a text without words has none.
    """
    n = np.diff(first)
    total = len(word)
    value = np.zeros(total, U)
    keep = np.zeros(total, bool)
    if total >= k:
        for j in range(k):
            value[: total - k + 1] += word[j : total - k + 1 + j] * _SHINGLE[j % 5] * U(2 * (j // 5) + 1)
        keep[: total - k + 1] = True
    for j in range(1, k):  # the last k-1 words of a text start no shingle
        at = first[1:] - j
        at = at[(at >= first[:-1])]
        keep[at] = False
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        at = first[:-1][short]
        h = n[short].astype(U) * U(0x9FB21C651E98DF25)
        for j in range(k - 1):
            on = n[short] > j
            h[on] += word[at[on] + j] * _SHINGLE[j % 5] * U(2 * (j // 5) + 3)
        value[at] = h
        keep[at] = True
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(count)])
    out = mix(value[keep])
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[offs[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[offs]


def fast_sketch(value: np.ndarray, offs: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketching: t coordinates for each set, all filled for sets that are not empty.

    In round r < t each element falls into one hashed bin; in round t + b every element falls into bin b, so 2t rounds
    fill all. A coordinate keeps the smallest (round, hash) it saw, so two sets agree in one with the probability of
    their Jaccard similarity, with the concentration of independent draws. Sets leave once all their bins are full.
    """
    n = len(offs) - 1
    out = np.full(n * t, np.iinfo(U).max, U)
    size = np.diff(offs)
    active = np.flatnonzero(size > 0)
    owner = np.repeat(np.arange(n), size)
    for r in range(2 * t):
        if not len(active):
            break
        if len(active) == n:
            own, v = owner, value
        else:
            pick = np.zeros(n, bool)
            pick[active] = True
            on = pick[owner]
            owner, value = owner[on], value[on]
            own, v = owner, value
        h = mix(v + U((r * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        bins = (h >> U(32)) % U(t) if r < t else np.full(len(h), r - t, U)
        np.minimum.at(out, own * t + bins.astype(np.int64), (U(r) << U(48)) | (h & U(0xFFFFFFFFFFFF)) if r < 65536 else h)
        full = (out.reshape(n, t)[active] != np.iinfo(U).max).all(axis=1)
        if full.any():
            active = active[~full]
    return out.reshape(n, t)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def long_lists(x: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column from values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), longs(x))
