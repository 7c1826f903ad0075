"""Reproducible random draws: a hash of seed, epoch, purpose and row key, equal under any partitioning or retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F


def uniform(purpose: str, key: Column | str, seed: int = 42, epoch: Column | int = 0) -> Column:
    """A double in [0, 1) for each row: 52 bits of md5 over ``seed|epoch|purpose|key``."""
    key = F.col(key) if isinstance(key, str) else key
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.lit(purpose), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def uniform_sql(purpose: str, key: str, seed: int = 42, epoch: int = 0) -> str:
    """The same draw in ANSI SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{epoch}', '{purpose}', CAST({key} AS VARCHAR))), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE))"


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high - low))


def below(u: Column, n: Column | int) -> Column:
    """An integer in [0, n)."""
    return F.floor(u * n).cast("int")


#: Rounds of the permutation, and steps that lead a place beyond ``n`` back below it.
ROUNDS, WALKS = 4, 40


def _sides(n: int) -> tuple[int, int]:
    """The least rectangle of nearly equal sides with ``n`` cells or more; it has fewer than ``a`` cells too many."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permuted(place: Column, n: int, purpose: str = "permute", seed: int = 42, epoch: int = 0, inverse: bool = False) -> Column:
    """A keyed bijection of the integers 0 ... n-1, or its inverse, computed for each row alone: no sort, no shuffle.

    A Feistel network over the cells of a rectangle: rounds add to one side what a keyed hash makes of the other, so each
    can be taken back. A place that falls beyond ``n`` is sent through the network again until it doesn't, which keeps
    it a bijection; as fewer cells than a side are too many, the bound of WALKS is never met (below n = 1,600 it can't
    be, beyond, the odds are below 1 in 10^60). A null stays null; a place outside the range is an error of the caller.
    """
    a, b = _sides(n)

    def hashed(r: Column, x: Column, m: int) -> Column:
        text = F.concat_ws("|", F.lit(f"{seed}|{epoch}|{purpose}"), r.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") % m

    def turn(s: Column, r: Column) -> Column:
        """One round; even rounds change the row, odd ones the column."""
        y, x = s["y"], s["x"]
        sign = -1 if inverse else 1
        even = F.struct(F.pmod(y + sign * hashed(r, x, a), F.lit(a)).alias("y"), x.alias("x"))
        odd = F.struct(y.alias("y"), F.pmod(x + sign * hashed(r, y, b), F.lit(b)).alias("x"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    order = F.array(*(F.lit(r).cast("long") for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))))

    def network(p: Column) -> Column:
        start = F.struct(F.floor(p / b).cast("long").alias("y"), F.pmod(p, F.lit(b)).cast("long").alias("x"))
        return F.aggregate(order, start, turn, lambda s: s["y"] * b + s["x"])

    walk = F.array(*(F.lit(i) for i in range(WALKS)))
    return F.aggregate(walk, network(place.cast("long")), lambda p, _: F.when(p < n, p).otherwise(network(p)))


def permuted_sql(place: str, source: str, n: str, walks: int, purpose: str = "permute", seed: int = 42, epoch: int = 0) -> str:
    """The same as a query: ``source`` with ``new``, the permuted ``place``, after at most ``walks`` steps back."""
    hashed = lambda r, x, m: f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{epoch}', '{purpose}', '{r}', CAST({x} AS VARCHAR))), 1, 13) AS BIGINT) % {m})"
    now = f"(SELECT *, CAST(ceil(sqrt({n})) AS BIGINT) AS a, CAST(ceil({n} / ceil(sqrt({n}))) AS BIGINT) AS b, CAST({place} AS BIGINT) AS new, false AS done FROM {source})"
    for _ in range(walks + 1):
        now = f"(SELECT * EXCLUDE (y, x), new // b AS y, new % b AS x FROM (SELECT *, 0 AS y, 0 AS x FROM {now}))"
        for r in range(ROUNDS):
            now = f"(SELECT * REPLACE ((y + {hashed(r, 'x', 'a')}) % a AS y) FROM {now})" if r % 2 == 0 else f"(SELECT * REPLACE ((x + {hashed(r, 'y', 'b')}) % b AS x) FROM {now})"
        now = f"(SELECT * EXCLUDE (y, x) REPLACE (CASE WHEN done THEN new ELSE y * b + x END AS new, done OR y * b + x < {n} AS done) FROM {now})"
    return now


def generator(purpose: str, key: object, seed: int, epoch: int) -> np.random.Generator:
    """The counterpart in tasks, for draws per pixel."""
    digest = hashlib.md5(f"{seed}|{epoch}|{purpose}|{key}".encode()).digest()
    return np.random.Generator(np.random.Philox(int.from_bytes(digest[:8], "big")))
