"""Time-aware splits and ranking metrics (N)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.operators.joins import mean_pairwise_distance
from encore.operators.scan import HotCells, hot_cells, numbered


def expanding_splits(
    df: DataFrame, ts: str, step_days: int = 90, test_days: int = 180, first_days: int = 360, min_train: int = 1000, min_test: int = 100
) -> DataFrame:
    """Cut dates with train and test sizes: train before the cut, test in [cut, cut + test_days).

    Sizes come from a running total over the calendar, not from repeating the rows per cut.
    """
    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    span = daily.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    calendar = span.select(F.explode(F.sequence("d0", F.date_add("d1", 1))).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar date
    before = calendar.join(daily, "day", "left").select("day", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(w), F.lit(0)).alias("n_before"))
    first, last = F.date_add("d0", first_days), F.date_sub("d1", test_days + 1)
    cuts = span.filter(first <= last).select(F.explode(F.sequence(first, last, F.expr(f"interval {step_days} days"))).alias("cut"))
    out = (
        cuts.join(before.withColumnRenamed("day", "cut").withColumnRenamed("n_before", "n_train"), "cut")
        .withColumn("test_end", F.date_add("cut", test_days))
        .join(before.withColumnRenamed("day", "test_end").withColumnRenamed("n_before", "__e"), "test_end")
        .withColumn("n_test", F.col("__e") - F.col("n_train"))
        .filter((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
    )
    return out.withColumn("split_id", F.row_number().over(Window.orderBy("cut"))).select("split_id", "cut", "test_end", "n_train", "n_test")


def ratio_split(df: DataFrame, ts: str, row_id: str, ratio: float = 0.8, cell: Column | HotCells | None = None) -> DataFrame:
    """First floor(n * ratio) rows by time are train."""
    out = numbered(df, [], [ts, row_id], hot_cells() if cell is None else cell)
    train = F.col("row_no") <= F.floor(F.col("row_count") * ratio)
    return out.withColumn("split", F.when(train, "train").otherwise("test")).drop("row_no", "row_count")


def three_way_time_split(df: DataFrame, ts: str, row_id: str, test: float = 0.2, validation: float = 0.1) -> DataFrame:
    """Train, validation and test by time; validation and test sizes are truncated."""
    out = numbered(df, [], [ts, row_id], hot_cells())
    n = F.col("row_count")
    n_test, n_val = F.floor(n * test), F.floor(n * validation)
    split = F.when(F.col("row_no") <= n - n_test - n_val, "train").when(F.col("row_no") <= n - n_test, "validation").otherwise("test")
    return out.withColumn("split", split).drop("row_no", "row_count")


def _hash_rank(df: DataFrame, key: Sequence[str], strata: Sequence[str], seed: int) -> DataFrame:
    tagged = df.withColumn("__h", C.text_hash(*key, seed=seed))
    return numbered(tagged, strata, ["__h", *key], HotCells()).drop("__h")


def seeded_split(df: DataFrame, key: Sequence[str], test: float = 0.2, validation: float = 0.1, strata: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Repeatable split by hash rank, inside each stratum where given."""
    out = _hash_rank(df, key, strata, seed)
    n = F.col("row_count")
    n_test, n_val = F.floor(n * test), F.floor(n * validation)
    split = F.when(F.col("row_no") <= n_test, "test").when(F.col("row_no") <= n_test + n_val, "validation").otherwise("train")
    return out.withColumn("split", split).drop("row_no", "row_count")


def kfold(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    out = _hash_rank(df, key, [], seed)
    return out.withColumn("fold", F.pmod(F.col("row_no") - 1, F.lit(k))).drop("row_no", "row_count")


def split_integrity(df: DataFrame, key: Sequence[str], split: str, ts: str) -> DataFrame:
    """Keys in several splits, missing labels, and whether the last train time is before the first test time."""
    per_key = df.groupBy(*key).agg(F.countDistinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("n_overlap"))
    row = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(split).isNull()).alias("n_unassigned"),
        F.max(F.when(F.col(split) == "train", F.col(ts))).alias("__t"),
        F.min(F.when(F.col(split) == "test", F.col(ts))).alias("__f"),
    )
    out = row.withColumn("n_overlap", per_key.select("n_overlap").scalar())
    ordered = F.col("__t") < F.col("__f")
    return out.withColumn("train_before_test", ordered).withColumn(
        "valid", (F.col("n_overlap") == 0) & (F.col("n_unassigned") == 0) & ordered
    ).drop("__t", "__f")


def data_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash, row count and schema text."""
    cols = sorted(df.columns)
    h = C.text_hash(*cols, seed=0).cast("decimal(38,0)")
    text = ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in cols)
    return df.agg(F.count("*").alias("n_rows"), F.sum(h).cast("string").alias("content")).withColumn(
        "fingerprint", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "content", F.lit(text)), 256)
    )


def _hits(recs: DataFrame, test: DataFrame, keys: Sequence[str], item: str, k: int) -> DataFrame:
    """Top-k rows with ``hit``; a repeated item counts once, at its first place."""
    top = recs.filter(F.col("rank") <= k).groupBy(*keys, item).agg(F.min("rank").alias("rank"))
    actual = test.select(*keys, item).distinct().withColumn("__t", F.lit(1))
    return top.join(actual, [*keys, item], "left").withColumn("hit", F.coalesce("__t", F.lit(0))).drop("__t")


def precision_recall(recs: DataFrame, test: DataFrame, keys: Sequence[str], item: str, k: int = 10) -> DataFrame:
    """Hits among the distinct top-k over k, and over the number of test items."""
    hits = _hits(recs, test, keys, item, k).groupBy(*keys).agg(F.sum("hit").alias("hits"))
    actual = test.select(*keys, item).distinct().groupBy(*keys).agg(F.count("*").alias("n_test"))
    out = hits.join(actual, list(keys), "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))
    return out.withColumns(
        {"precision": F.col("hits") / k, "recall": F.when(F.col("n_test") > 0, F.col("hits") / F.col("n_test")).otherwise(F.lit(0.0))}
    )


def ndcg(recs: DataFrame, test: DataFrame, keys: Sequence[str], item: str, k: int = 10) -> DataFrame:
    """Binary gain, discount log2(position + 1); the ideal order puts the same hits first."""
    hits = _hits(recs, test, keys, item, k)
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    by = hits.groupBy(*keys).agg(F.sum(gain).alias("dcg"), F.sum("hit").alias("hits"))
    places = F.when(F.col("hits") > 0, F.sequence(F.lit(1), F.col("hits"))).otherwise(F.array().cast("array<bigint>"))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return by.withColumn("ndcg", F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0))).select(*keys, "hits", "ndcg")


def coverage(recs: DataFrame, catalog: DataFrame, item: str, keys: Sequence[str] = ()) -> DataFrame:
    total = catalog.select(F.countDistinct(item)).scalar()
    return recs.groupBy(*keys).agg(F.countDistinct(item).alias("n_recommended")).withColumn("coverage", F.try_divide(F.col("n_recommended"), total))


def intra_list_diversity(recs: DataFrame, features: DataFrame, keys: Sequence[str], item: str, cols: Sequence[str], k: int) -> DataFrame:
    """Mean pairwise distance of each top-k list (at most k vectors per list)."""
    rows = recs.filter(F.col("rank") <= k).join(features.select(item, *cols), item)
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", F.array(*cols).alias("v")))).alias("r"))
    return lists.select(*keys, mean_pairwise_distance(F.transform("r", lambda x: x["v"])).alias("diversity"))


def novelty(recs: DataFrame, plays: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Mean of 1 - plays of the item / all plays."""
    counts = plays.groupBy(item).agg(F.count("*").alias("__n"))
    total = plays.select(F.count("*")).scalar()
    share = F.coalesce("__n", F.lit(0)) / F.col("__total")
    out = recs.join(counts, item, "left").withColumn("__total", total)
    return out.groupBy(*keys).agg(F.avg(1 - share).alias("novelty"))


def normalised_entropy(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """-sum p log2(p + 1e-10) over log2 of the number of classes; 0 for at most one class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__t"), F.count("*").alias("__c"))
    p = F.col("__n") / F.col("__t")
    rows = counts.join(totals, list(keys)) if keys else counts.withColumn("__s", totals.select(F.struct("__t", "__c")).scalar()).select("*", "__s.*")
    out = rows.groupBy(*keys, "__c").agg((-F.sum(p * F.log2(p + 1e-10))).alias("__h"))
    return out.select(*keys, F.when(F.col("__c") > 1, F.try_divide(F.col("__h"), F.log2("__c"))).otherwise(F.lit(0.0)).alias("cultural_diversity"))


def serendipity(recs: DataFrame, history: DataFrame, test: DataFrame, keys: Sequence[str], item: str, artist: str) -> DataFrame:
    """1 for an unseen artist whose item is in the test, .5 for an unseen artist, else 0; mean per list."""
    seen = history.select(*keys, artist).distinct().withColumn("__seen", F.lit(1))
    actual = test.select(*keys, item).distinct().withColumn("__hit", F.lit(1))
    out = recs.join(seen, [*keys, artist], "left").join(actual, [*keys, item], "left")
    score = F.when(F.col("__seen").isNotNull(), 0.0).when(F.col("__hit").isNotNull(), 1.0).otherwise(0.5)
    return out.groupBy(*keys).agg(F.avg(score).alias("serendipity"))


def temporal_consistency(recs: DataFrame, test: DataFrame, features: DataFrame, keys: Sequence[str], item: str, cols: Sequence[str]) -> DataFrame:
    """Mean over the features of 1 - |test mean - recommended mean|."""
    dims = features.select(item, *cols)
    a = recs.join(dims, item).groupBy(*keys).agg(*[F.avg(c).alias(f"__r_{c}") for c in cols])
    b = test.join(dims, item).groupBy(*keys).agg(*[F.avg(c).alias(f"__t_{c}") for c in cols])
    parts = sum((1 - F.abs(F.col(f"__t_{c}") - F.col(f"__r_{c}")) for c in cols), F.lit(0.0))
    return a.join(b, list(keys)).select(*keys, (parts / len(cols)).alias("temporal_consistency"))


def assign_splits(df: DataFrame, splits: DataFrame, ts: str) -> DataFrame:
    """Each row once per split it takes part in, with its role; the split table is a handful of rows.

    The splits are read as one scalar array, so no join or broadcast is needed.
    """
    rows = F.sort_array(F.collect_list(F.struct("split_id", "cut", "test_end")))
    out = df.withColumn("__all", splits.select(rows).scalar()).withColumn("__d", F.to_date(ts))
    out = out.withColumn("__s", F.explode("__all")).filter(F.col("__d") < F.col("__s.test_end"))
    role = F.when(F.col("__d") < F.col("__s.cut"), "train").otherwise("test")
    return out.withColumns({"split_id": F.col("__s.split_id"), "split": role}).drop("__all", "__s", "__d")


def summarise(metrics: DataFrame, split: str, names: Sequence[str]) -> DataFrame:
    """Mean, population std, min and max over splits of each metric's split mean, with a label."""
    per_split = metrics.groupBy(split).agg(*[F.avg(n).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = per_split.selectExpr(split, f"stack({len(names)}, {pairs}) AS (metric, x)")
    out = long.groupBy("metric").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n_splits")
    )
    return out.withColumn("level", F.when(F.col("mean") > 0.7, "high").when(F.col("mean") > 0.4, "medium").otherwise("low"))


def compare_runs(original: DataFrame, reproduced: DataFrame, name: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Per metric: both values, their difference and whether it is within tolerance."""
    a = original.select(name, F.col(value).alias("original"))
    b = reproduced.select(name, F.col(value).alias("reproduced"))
    diff = F.abs(F.col("original") - F.col("reproduced"))
    out = a.join(b, name, "full_outer").withColumn("difference", diff)
    return out.withColumn("matches", F.coalesce(F.col("difference") <= tolerance, F.lit(False)))
