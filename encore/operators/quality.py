"""Filters, data-quality profiles and imputation (D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.operators.joins import membership
from encore.operators.scan import exact_quantiles


def quality_conditions(
    ms: str, music: Column | None, required: Sequence[str], min_ms: int = 30000, max_ms: int = 1800000
) -> list[tuple[str, Column]]:
    steps = [("long_enough", F.col(ms) >= min_ms), ("short_enough", F.col(ms) <= max_ms)]
    if music is not None:
        steps.append(("music", music))
    return steps + [(f"has_{c}", F.col(c).isNotNull()) for c in required]


def quality_filter(df: DataFrame, conditions: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, cond in conditions:
        df = df.filter(cond)
    return df


def quality_filter_counts(df: DataFrame, conditions: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each successive filter, in one pass."""
    aggs, so_far = [F.count(F.lit(1)).alias("input")], F.lit(True)
    for name, cond in conditions:
        so_far = so_far & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(so_far).alias(name))
    return df.agg(*aggs)


def min_support(df: DataFrame, user: str, item: str, min_user: int, min_item: int) -> DataFrame:
    """Users with enough rows, then items with enough rows among them; one pass each."""
    n = F.count(F.lit(1)).alias("n")
    users = df.groupBy(user).agg(n).filter(F.col("n") >= min_user)
    kept = membership(df, users, [user])
    items = kept.groupBy(item).agg(n).filter(F.col("n") >= min_item)
    return membership(kept, items, [item])


def time_slice(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Half-open [start, end); the bounds are literals, so they reach the scan."""
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def dimension_filter(df: DataFrame, allowed: dict[str, Sequence]) -> DataFrame:
    for col, values in allowed.items():
        df = df.filter(F.col(col).isin(*values))
    return df


def unpivot(df: DataFrame, cols: Sequence[str], name: str = "feature", value: str = "x", kind: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {kind})" for c in cols)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(cols)}, {pairs}) AS ({name}, {value})")


def _per_column(df: DataFrame, cols: Sequence[str], agg, value: str) -> DataFrame:
    """One aggregate per column in a single scan, one output row per column."""
    row = df.agg(*[agg(c).alias(c) for c in cols])
    return unpivot(row, cols, "feature", value, "double" if value in ("mean", "std") else "bigint")


def range_check(df: DataFrame, cols: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return _per_column(df, cols, lambda c: F.count_if((F.col(c) < low) | (F.col(c) > high)), "n_outside")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, cols or df.columns, lambda c: F.count_if(F.col(c).isNull()), "n_null")


def feature_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    triples = ", ".join(f"'{c}', `mean_{c}`, `std_{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {triples}) AS (feature, mean, std)")


def domain_check(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the allowed set with their counts."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(~F.col(col).isin(*allowed))


def skew_check(df: DataFrame, col: str, limit: float = 0.9) -> DataFrame:
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    shares = counts.withColumn("share", F.col("n") / total)
    return shares.withColumn("skewed", F.col("share") > limit)


def timestamp_check(df: DataFrame, col: str, min_days: int = 30) -> DataFrame:
    ts = F.try_to_timestamp(F.col(col).cast("string"))
    return df.select(F.col(col).alias("raw"), ts.alias("ts")).agg(
        F.count_if(F.col("ts").isNull()).alias("n_invalid"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.datediff(F.max("ts"), F.min("ts")).alias("span_days"),
        (F.datediff(F.max("ts"), F.min("ts")) < min_days).alias("short_span"),
    )


def duplicate_events(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"), F.count_if(F.col("n") > 1).alias("n_keys")
    )


def coherence_check(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """Per class: mean own score, whether it is under .5, rows where another class scores higher."""
    own = F.lit(None).cast("double")
    others = F.lit(None).cast("double")
    for cls, col in scores.items():
        rest = [F.col(c) for k, c in scores.items() if k != cls]
        best = F.greatest(*rest) if len(rest) > 1 else rest[0]
        own = F.when(F.col(label) == cls, F.col(col)).otherwise(own)
        others = F.when(F.col(label) == cls, best).otherwise(others)
    tagged = df.filter(F.col(label).isin(*scores)).select(label, own.alias("own"), others.alias("other"))
    return tagged.groupBy(label).agg(
        F.avg("own").alias("mean_own"),
        (F.avg("own") < 0.5).alias("weak"),
        F.count_if(F.col("own") < F.col("other")).alias("n_contradict"),
    )


def data_profile(df: DataFrame, ts: str) -> DataFrame:
    """One row: rows, columns and types, total nulls, date range."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(f"{c}:{k}" for c, k in df.dtypes)).alias("columns"),
        nulls.alias("n_nulls"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def readiness_gate(
    df: DataFrame,
    required: Sequence[str],
    user: str,
    label: str,
    flag: Column,
    min_users: int,
    min_flagged: int,
    min_class: int,
) -> DataFrame:
    """Pass/fail row: required columns, users, flagged items, smallest class."""
    missing = [c for c in required if c not in df.columns]
    classes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = classes.select(F.min("n")).scalar()
    out = df.agg(F.countDistinct(user).alias("n_users"), F.count_if(flag).alias("n_flagged"))
    out = out.withColumn("smallest_class", smallest).withColumn("n_missing_columns", F.lit(len(missing)))
    return out.withColumn(
        "ready",
        (F.col("n_missing_columns") == 0)
        & (F.col("n_users") >= min_users)
        & (F.col("n_flagged") >= min_flagged)
        & (F.col("smallest_class") >= min_class),
    )


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls to the exact column median, found from per-value counts."""
    long = unpivot(df.select(*cols), cols)
    medians = exact_quantiles(long, "x", [0.5], ["feature"]).groupBy().pivot("feature", list(cols)).agg(F.first("q_0"))
    row = medians.select(F.struct(*[F.col(c) for c in cols])).scalar()
    out = df.withColumn("__m", row)
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("__m")[c]) for c in cols}).drop("__m")


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls to the column mean."""
    means = df.select(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    out = df.withColumn("__m", means)
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("__m")[c]) for c in cols}).drop("__m")


def fill_forward_backward(df: DataFrame, cols: Sequence[str], date: str, keys: Sequence[str]) -> DataFrame:
    """Last known value, else the next known one, in date order per key.

    For daily-grain series: a key holds one row per date, so its window is short.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)))
    return df
