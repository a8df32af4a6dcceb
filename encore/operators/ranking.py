"""Top-k, sampling and set operators (H, I)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import columns as C


def top_k(df: DataFrame, key: str, k: int, extra: Sequence[Column] = ()) -> DataFrame:
    """The k keys with most rows; ties by key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("plays"), *extra)
    return counts.orderBy(F.desc("plays"), key).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group; Spark keeps at most k per group and task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def arg_max(df: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Key with most rows per group; the smallest key wins ties. Counts first, so no group is collected."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count(F.lit(1)).alias("__n"))
    best = F.max(F.col("__n"))
    picked = counts.groupBy(*group, "__n").agg(F.min(key).alias(key))
    return picked.groupBy(*group).agg(F.max_by(key, "__n").alias(key), best.alias("n"))


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order: repeatable whatever the partitioning."""
    return df.orderBy(C.text_hash(*key, seed=seed), *key).limit(n)


def balanced_negatives(df: DataFrame, label: str, key: Sequence[str], ratio: int = 3, seed: int = 42) -> DataFrame:
    """Every positive and up to ``ratio`` times as many negatives, picked by hash.

    The hash threshold is cut at the exact rank, found from per-slice counts.
    """
    from encore.operators.scan import HotCells, numbered

    tagged = df.withColumn("__h", C.text_hash(*key, seed=seed))
    negatives = tagged.filter(~F.col(label))
    cap = df.filter(F.col(label)).select((F.count(F.lit(1)) * ratio).alias("cap")).scalar()
    ranked = numbered(negatives, [], ["__h", *key], HotCells())
    kept = ranked.filter(F.col("row_no") <= cap).drop("row_no", "row_count", "__h")
    return df.filter(F.col(label)).unionByName(kept)


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order; a mergeable min instead of a sort."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return picked.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def overlap_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of intersection and differences of two key sets, overlap in percent of the union."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1))
    b = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    n = F.count(F.lit(1))
    shared = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.agg(
        shared.alias("shared"),
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        F.try_divide(shared * 100.0, n).alias("overlap_pct"),
    )


def union_of_candidates(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()
