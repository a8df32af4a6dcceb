"""Join operators (E).

No join carries a broadcast hint: Spark broadcasts a side only when its
measured size is under the session threshold, and adaptive execution splits
skewed partitions of the sort-merge joins that remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_features(facts: DataFrame, dim: DataFrame, key: str, suffix: str = "_dim") -> DataFrame:
    """Left join of a dimension; clashing dimension columns get a suffix."""
    for c in dim.columns:
        if c != key and c in facts.columns:
            dim = dim.withColumnRenamed(c, c + suffix)
    return facts.join(dim, key, "left")


def attach_new_columns_only(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of the dimension columns the facts do not have yet."""
    fresh = [c for c in dim.columns if c == key or c not in facts.columns]
    return facts.join(dim.select(*fresh), key, "left")


def attach_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate by key joined back to each row.

    An aggregate combines on the map side, so a key that owns a third of the
    rows costs one summary row; a window would sort all of them in one task.
    """
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys), "left")


def categorize(facts: DataFrame, scored: DataFrame, key: str, threshold: float = 0.6) -> DataFrame:
    """Join the scored dimension to the facts and flag the confident labels."""
    out = facts.join(scored, key, "left")
    for label in ("vietnamese", "western", "bridge"):
        out = out.withColumn(
            f"is_{label}", (F.col("dominant_culture") == label) & (F.col("confidence") >= threshold)
        )
    return out


def membership(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def unseen(candidates: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    return candidates.join(seen.select(*on).distinct(), list(on), "left_anti").dropDuplicates(list(on))


def within_days(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs at most ``days`` apart, as an equi-join.

    The left side, the short one (change points, shifts), is repeated for each
    day it can match, so Spark hashes on the date instead of comparing every
    pair. ``day_diff`` is right minus left.
    """
    offsets = F.sequence(F.date_sub(left_date, days), F.date_add(left_date, days))
    spread = left.withColumn("__day", F.explode(offsets))
    cond = spread["__day"] == right[right_date]
    for k in keys:
        cond = cond & (spread[k] == right[k])
    out = spread.join(right, cond)
    for k in keys:
        out = out.drop(right[k])
    return out.drop("__day").withColumn("day_diff", F.datediff(right_date, left_date))


def context_before_after(
    daily: DataFrame, shifts: DataFrame, date: str, shift_date: str, signals: Sequence[str], days: int = 14
) -> DataFrame:
    """Signal means in [d - days, d) and (d, d + days] and their percent change.

    A zero mean before gives change 0; a shift with an empty side is dropped.
    """
    pairs = within_days(shifts, daily, shift_date, date, days)
    before, after = F.col("day_diff") < 0, F.col("day_diff") > 0
    aggs = [F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after")]
    for s in signals:
        aggs += [F.avg(F.when(before, F.col(s))).alias(f"{s}_before"), F.avg(F.when(after, F.col(s))).alias(f"{s}_after")]
    out = pairs.groupBy(*shifts.columns).agg(*aggs).filter((F.col("n_before") > 0) & (F.col("n_after") > 0))
    for s in signals:
        b, a = F.col(f"{s}_before"), F.col(f"{s}_after")
        out = out.withColumn(f"{s}_pct", F.when(b != 0, (a - b) / b * 100).otherwise(F.lit(0.0)))
    return out


def nearby_count(plays: DataFrame, points: DataFrame, play_date: str, point_date: str, days: int = 30) -> DataFrame:
    """Rows with ``nearby``: points strictly closer than ``days``; counted per date before the join."""
    span = F.sequence(F.date_sub(point_date, days - 1), F.date_add(point_date, days - 1))
    per_day = points.select(F.explode(span).alias("__d")).groupBy("__d").agg(F.count(F.lit(1)).alias("nearby"))
    out = plays.join(per_day, plays[play_date] == per_day["__d"], "left").drop("__d")
    return out.withColumn("nearby", F.coalesce("nearby", F.lit(0)))


def align_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "full_outer").na.fill(0)


def consecutive_pairs(df: DataFrame, item: str, period_no: str, value: str) -> DataFrame:
    """(period, item, x, y): the item's value in a period and in the next one."""
    cur = df.select(F.col(period_no).alias("period"), item, F.col(value).alias("x"))
    nxt = df.select((F.col(period_no) - 1).alias("period"), item, F.col(value).alias("y"))
    return cur.join(nxt, ["period", item])


def score_each(candidates: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """Every candidate beside each of a few literal profiles, without a join.

    The profiles are parameters of the plan, so the rows are generated in place
    and no cross product is shuffled or broadcast.
    """

    def lit(v):
        if isinstance(v, (list, tuple)):
            return F.array(*[lit(x) for x in v]) if v else F.array().cast("array<string>")
        if isinstance(v, dict):
            return F.struct(*[lit(x).alias(k) for k, x in v.items()])
        return F.lit(v)

    profiles = F.array(*[F.struct(*[lit(v).alias(k) for k, v in r.items()]) for r in rows])
    return candidates.withColumn("profile", F.explode(profiles))


def first_contained(text: str | Column, names: Column) -> Column:
    """First listed struct whose ``name`` contains the text or is contained in it."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    hits = F.filter(names, lambda a: t.contains(F.lower(a["name"])) | F.lower(a["name"]).contains(t))
    return F.get(hits, F.lit(0))


def mean_pairwise_distance(vectors: Column) -> Column:
    """Mean Euclidean distance over the pairs of a short array of feature vectors.

    For top-k lists: the array is bounded by k, and the pairs are folded inside
    the row instead of being emitted. Fewer than two vectors give 0.
    """
    n = F.size(vectors)

    def dist(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))

    total = F.aggregate(
        vectors, F.lit(0.0), lambda s, a: s + F.aggregate(vectors, F.lit(0.0), lambda r, b: r + dist(a, b))
    )
    return F.when(n > 1, total / (n * (n - 1))).otherwise(F.lit(0.0))
