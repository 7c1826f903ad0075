"""Confusion counts of a stream that are read and reset on demand, by events of the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterlab.config import NUM_CLASSES

#: Kinds of events.
COUNT, READ, RESET = "count", "read", "reset"
#: Parts that a source's rows are dealt to, as one source may send most of a stream.
SALTS = 8
_READ_CODE, _RESET_CODE = 1 << 30, (1 << 30) + 1  # above the codes of cells, so that an order by time and code puts them last


def _step(num_classes: int, once: bool):
    """What happens to one part of one source: its state is the counts since the last reset, and the times and codes of
    what the watermark hasn't passed yet."""
    cells = num_classes**2

    def events_of(times: np.ndarray, codes: np.ndarray, generation: int, counts: np.ndarray) -> tuple[list[tuple], int]:
        """Let settled events take effect, in order, on ``counts``; what is given out (time, reset, generation, cells and
        their counts), and the generation after them."""
        order = np.lexsort((codes, times))
        times, codes = times[order], codes[order]
        if once:  # equal reads and resets of a time are neighbours now
            again = (codes[1:] >= _READ_CODE) & (codes[1:] == codes[:-1]) & (times[1:] == times[:-1])
            first = np.append(True, ~again)[: len(codes)]
            times, codes = times[first], codes[first]
        out, begin = [], 0
        for at in np.flatnonzero(codes >= _READ_CODE):
            counts += np.bincount(codes[begin:at], minlength=cells)
            found, reset = np.flatnonzero(counts), codes[at] == _RESET_CODE
            out.append((times[at], reset, generation, found, counts[found]))
            if reset:
                counts[:], generation = 0, generation + 1
            begin = at + 1
        counts += np.bincount(codes[begin:], minlength=cells)
        return out, generation

    def step(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, counts, times, codes = state.get if state.exists else (0, bytes(8 * cells), b"", b"")
        counts = np.frombuffer(counts, np.int64).copy()
        arrived = [] if state.hasTimedOut else [(b["time"].to_numpy(np.int64), b["code"].to_numpy(np.int64)) for b in rows]
        times = np.concatenate([np.frombuffer(times, np.int64), *(t for t, _ in arrived)])
        codes = np.concatenate([np.frombuffer(codes, np.int64), *(c for _, c in arrived)])
        watermark = state.getCurrentWatermarkMs()
        settled = times <= watermark * 1000
        out, generation = events_of(times[settled], codes[settled], generation, counts)
        times, codes = times[~settled], codes[~settled]
        state.update((generation, counts.tobytes(), times.tobytes(), codes.tobytes()))
        if len(times):  # Spark calls again when the watermark is beyond this
            state.setTimeoutTimestamp(max(watermark + 1, int(times.min() // 1000) - 1))
        if out:
            at, reset, generations, found, n = zip(*out, strict=True)
            sizes, found = [len(x) for x in found], np.concatenate(found)
            repeated = lambda x: np.repeat(np.array(x), sizes)
            yield pd.DataFrame({"source": str(key[0]), "time": repeated(at), "kind": np.where(repeated(reset), RESET, READ), "generation": repeated(generations), "true_class": found // num_classes, "pred_class": found % num_classes, "n": np.concatenate(n)})

    return step


def stream_accumulator(events: DataFrame, watermark: str = "1 hour", source: str = "source", time: str = "ts", salts: int = SALTS, num_classes: int = NUM_CLASSES, once: bool = False) -> DataFrame:
    """``(source, ts, kind, generation, true_class, pred_class, n)``: parts of a source's counts at each ``read`` and ``reset``.

    ``events`` has ``source``, ``ts``, ``kind`` (``count``, ``read`` or ``reset``) and, for counts, ``true_class`` and
    ``pred_class``. Events take effect in the order of their times, however they arrive, once the watermark has passed
    them; of equal times counts come first, then reads, then resets. A reset gives the counts since the reset before it
    and starts the next ``generation`` from zero. Counts lie in ``salts`` parts of each source, and every part gets the
    reads and resets: add the parts up with ``accumulated``. The state of a part is its matrix and what arrived within the
    watermark's delay; it is in the checkpoint and survives a restart. Rows with a null time, source, kind or class, or a
    class outside the table, count nowhere.

    Each row is an event: two reads of one time both give the counts, two resets start two generations. With ``once``
    reads of a source at one time are one read and resets one reset, however many rows say so.
    """
    cell = F.col("true_class").cast("int") * num_classes + F.col("pred_class").cast("int")
    valid = F.col("true_class").between(0, num_classes - 1) & F.col("pred_class").between(0, num_classes - 1)
    code = F.when(F.col("kind") == READ, _READ_CODE).when(F.col("kind") == RESET, _RESET_CODE).when((F.col("kind") == COUNT) & valid, cell).cast("long")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    rows = events.select(F.col(source).cast("string").alias("source"), F.col(time).cast("timestamp").alias("ts"), code.alias("code")).where("source is not null and ts is not null and code is not null")
    rows = rows.withWatermark("ts", watermark)
    part = F.pmod(F.xxhash64("source", "ts", "code"), F.lit(salts)).cast("int")
    rows = rows.select("source", "ts", "code", F.unix_micros("ts").alias("time"), F.explode(F.when(F.col("code") >= _READ_CODE, every).otherwise(F.array(part))).alias("part"))
    out = rows.groupBy("source", "part").applyInPandasWithState(
        _step(num_classes, once),
        "source string, time long, kind string, generation long, true_class int, pred_class int, n long",
        "generation long, counts binary, times binary, codes binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return out.select("source", F.timestamp_micros("time").alias("ts"), "kind", "generation", "true_class", "pred_class", "n")


def accumulated(parts: DataFrame) -> DataFrame:
    """The parts of ``stream_accumulator``, as a table, added up: a row per source, event and cell that occurs."""
    return parts.groupBy("source", "ts", "kind", "generation", "true_class", "pred_class").agg(F.sum("n").alias("n"))
