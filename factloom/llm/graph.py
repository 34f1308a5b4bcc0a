"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger (large) or smaller-or-equal (small) neighbours to the least of its neighbourhood.

    Minima are aggregated before anything is joined, so a hub costs one row for each of its links; the
    join's partitions can be split by AQE where a hub fills one.
    """
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links  # u > v holds: all neighbours of u here are smaller
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that `links` (u, v) touches; component is the least node reachable.

    Links have no direction; repeated links, loops and nulls are allowed (a null end is no link). Every
    round's links are written to the checkpoint folder, so a lost executor costs a round at most. Rounds
    grow with the logarithm of the longest chain.
    """
    # `links` can be dear to compute: once, for loops too
    pairs = cut(links.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = pairs.where("u = v").select("u")
    now = pairs.where("u != v")
    size = now.count()
    seen = None
    while size:
        now = cut(_star(_star(now, True), False))
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    # all stars: every node but the centres has one link, to its centre
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    return found.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found, "node", "left_anti"))
