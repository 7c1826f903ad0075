"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.shared import materialise


def _mark(links: DataFrame) -> tuple:
    """Row count and an order-free checksum: two rounds with equal marks hold the same links."""
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1_000_003)).first()
    return tuple(row)


#: Links from which the tables of smallest neighbours are written too. Only then are both sides of a join plain tables,
#: whose frequent keys Spark splits over tasks; below, a hub's links fit one task anyway.
WRITTEN_LINKS = 1 << 20


def components(links: DataFrame, written_links: int = WRITTEN_LINKS) -> DataFrame:
    """``(a, b)`` long links -> ``(node, component)``: the smallest node that each linked node can reach.

    Alternates large-star and small-star rounds (Kiveris et al., 2014), so paths shrink geometrically and no group is
    ever gathered in one task: a hub's rows only take part in a grouped minimum, which is pre-aggregated, and in a
    join that Spark splits where they are many (``written_links``). Each round is written to the shared folder. Nodes
    without a link are not returned.
    """
    now = materialise(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _mark(now)
    while seen[0]:
        table = materialise if seen[0] >= written_links else lambda x: x
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")))
        large = table(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = materialise(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if (mark := _mark(now)) == seen:
            break
        seen = mark
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
