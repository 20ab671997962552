"""Connected components of a table of links, by alternating large and small stars.

Every round is a few aggregations and joins over the links and is stored, so
neither a component nor its links ever meet in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for every long u of the (u, v) links but the roots themselves; root is the least of its component."""

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        return r[0], r[1]

    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, the minima are one side of a plain join, whose other side's hubs adaptive execution can split.
        least_of_all = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least_of_all, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every link of ``large`` leads from a node to a smaller one.
        down = large.filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(edges)
        dropped(least_of_all)
        edges, after = new, mark(new)
        if after == before:
            return edges.select("u", F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
