"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.session import checkpointed


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """The smallest reachable node of every node that has a link: node, root.

    ``links`` has columns a, b of one orderable type. A large star ties a node's
    larger neighbours to its smallest one, a small star its smaller ones; the
    number of rounds grows with the logarithm of the nodes. Minima are aggregated
    before the shuffle and joined back, so no neighbourhood is collected; each
    round is a table in the shared folder and cuts the lineage.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = checkpointed(links.where("a <> b").select(low.alias("b"), high.alias("a")).distinct())
    seen = None
    while True:
        near = _both_ways(stars)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b")))
        stars = checkpointed(small.where("a <> b").distinct())
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
