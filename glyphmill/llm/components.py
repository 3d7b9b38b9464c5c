"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the columns a and b (of any type that has an order).

    Large and small stars take turns: each round hangs every vertex's neighbours on the
    smallest one, first the larger, then the smaller ones, until nothing changes; the number
    of rounds grows with the logarithm of the component size. Each round is a written table.
    """
    # rounds read their edges four times over; as a table they cost the plan one scan each
    all_ = now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a > b").distinct()
        # a fixed point has the same edges again; their number and sums, taken while they are written, tell
        seen = Observation()
        last, now = now, stored(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "stars")
        if before is not None:
            drop(last)
        mark = seen.get
        if mark == before:
            break
        before = mark
    ids = all_.select(F.col("a").alias("id")).union(all_.select("b")).distinct()
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
