"""Daily time series: change points, trends, seasonality, stability (J, G18-G23).

Input is one row per (series, date). A series holds at most one row per
calendar date, so its windows and folded arrays stay short however many plays
were aggregated into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.tails import chi2_upper_col, f_upper_col, t_two_sided_col
from encore.operators.joins import context_before_after, within_days


def _by(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def two_sided_shift(
    series: DataFrame, keys: Sequence[str], date: str, x: str, size: int = 7, var_weight: float = 1.0, mean_weight: float = 0.0
) -> DataFrame:
    """Score of the split before each row: variance change plus weighted mean change.

    Only rows with ``size`` rows before and more than ``size`` rows from them on
    have a score. Adds ``before_mean``, ``after_mean``, ``score`` and ``idx``.
    """
    w = _by(keys, date)
    left, right = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = series.withColumns(
        {
            "idx": F.row_number().over(w) - 1,
            "__n": n,
            "before_mean": F.avg(x).over(left),
            "after_mean": F.avg(x).over(right),
            "__lv": F.var_pop(x).over(left),
            "__rv": F.var_pop(x).over(right),
        }
    )
    score = var_weight * F.abs(F.col("__lv") - F.col("__rv")) + mean_weight * F.abs(F.col("before_mean") - F.col("after_mean"))
    full = (F.col("idx") >= size) & (F.col("idx") < F.col("__n") - size)
    return out.withColumn("score", F.when(full, score)).drop("__n", "__lv", "__rv")


def rolling_volatility(daily: DataFrame, keys: Sequence[str], date: str, signals: Sequence[str], size: int = 7) -> DataFrame:
    """Mean of the signals' sample stds over the ``size`` previous rows, 0 for the first ``size`` rows."""
    w = _by(keys, date)
    frame = w.rowsBetween(-size, -1)
    mean = sum((F.stddev_samp(s).over(frame) for s in signals), F.lit(0.0)) / len(signals)
    return daily.withColumn("volatility", F.when(F.row_number().over(w) > size, mean).otherwise(F.lit(0.0)))


# Cubic least-squares smoothing weights over 13 rows (divided by 143).
SMOOTH_WEIGHTS = [-11, 0, 9, 16, 21, 24, 25, 24, 21, 16, 9, 0, -11]


def centred_smoothing(series: DataFrame, keys: Sequence[str], date: str, x: str, weights: Sequence[int] = SMOOTH_WEIGHTS) -> DataFrame:
    """Weighted centred smoothing (raw value at the edges) and the plain centred mean."""
    w, half, total = _by(keys, date), len(weights) // 2, sum(weights)
    terms = []
    for i, weight in enumerate(weights):
        shift = i - half
        v = F.lag(x, -shift).over(w) if shift < 0 else F.lead(x, shift).over(w) if shift > 0 else F.col(x)
        terms.append(v * F.lit(weight / total))
    smooth = terms[0]
    for term in terms[1:]:
        smooth = smooth + term
    return series.withColumns(
        {"smoothed": F.coalesce(smooth, F.col(x)), "moving_average": F.avg(x).over(w.rowsBetween(-half, half))}
    )


def local_extrema(series: DataFrame, keys: Sequence[str], date: str, x: str, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Peaks at or above the high quantile, valleys at or below the low one; a plateau counts once."""
    w = _by(keys, date)
    q = series.groupBy(*keys).agg(F.percentile(x, high).alias("__hi"), F.percentile(x, low).alias("__lo"))
    flat = series.withColumns({"idx": F.row_number().over(w) - 1, "__p": F.lag(x).over(w)})
    flat = flat.filter(F.col("__p").isNull() | (F.col("__p") != F.col(x)))
    flat = flat.withColumns({"__before": F.lag(x).over(w), "__after": F.lead(x).over(w)})
    peak = (F.col(x) > F.col("__before")) & (F.col(x) > F.col("__after")) & (F.col(x) >= F.col("__hi"))
    valley = (F.col(x) < F.col("__before")) & (F.col(x) < F.col("__after")) & (F.col(x) <= F.col("__lo"))
    kind = F.when(peak, "peak").when(valley, "valley")
    return flat.join(q, list(keys)).withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*keys, date, "idx", x, "kind")


def day_to_day_change(series: DataFrame, keys: Sequence[str], date: str, x: str) -> DataFrame:
    step = F.abs(F.col(x) - F.lag(x).over(_by(keys, date)))
    return series.withColumn("__d", step).groupBy(*keys).agg(
        (F.avg("__d") / F.greatest(F.stddev_samp(x), F.lit(0.001))).alias("volatility")
    )


CLASS_WORDS = ("vietnamese", "western")


def change_type(signal: Column, class_words: Sequence[str] = CLASS_WORDS) -> Column:
    """Type of change from the signal's name."""
    of_class = F.lit(False)
    for word in class_words:
        of_class = of_class | signal.contains(word)
    return (
        F.when(of_class, "cultural_shift")
        .when(signal.contains("energy") | signal.contains("valence"), "energy_change")
        .when(signal.contains("exploration"), "exploration_burst")
        .otherwise("preference_change")
    )


def change_points(
    series: DataFrame,
    keys: Sequence[str],
    date: str,
    x: str,
    size: int = 7,
    var_weight: float = 1.0,
    mean_weight: float = 0.0,
    relative: bool = True,
    min_rows: int = 14,
) -> DataFrame:
    """Rows whose shift score exceeds mean + 2 population stds of the scores (strictly)."""
    whole = Window.partitionBy(*keys)
    scored = two_sided_shift(series, keys, date, x, size, var_weight, mean_weight).withColumns(
        {
            "__bound": F.avg("score").over(whole) + 2 * F.stddev_pop("score").over(whole),
            "__sd": F.stddev_pop(x).over(whole),
            "__n": F.count(F.lit(1)).over(whole),
        }
    )
    shift = F.abs(F.col("after_mean") - F.col("before_mean"))
    magnitude = shift / F.greatest(F.col("__sd"), F.lit(0.001)) if relative else shift
    return (
        scored.filter((F.col("score") > F.col("__bound")) & (F.col("__n") >= min_rows))
        .withColumn("magnitude", magnitude)
        .withColumn("confidence", F.least(F.lit(1.0), F.col("magnitude") / 2))
        .drop("__bound", "__sd", "__n")
    )


def spaced_change_points(series: DataFrame, keys: Sequence[str], date: str, x: str, size: int = 7) -> DataFrame:
    """Score above 1.5 stds of the signal; greedily kept at least ``size`` rows apart.

    The greedy choice depends on the last kept point, so it is a fold over the
    series' sorted candidate positions (at most one per date).
    """
    whole = Window.partitionBy(*keys)
    scored = two_sided_shift(series, keys, date, x, size, 1.0, 1.0).withColumn("__sd", F.stddev_pop(x).over(whole))
    cand = scored.filter(F.col("score") > 1.5 * F.col("__sd"))
    positions = cand.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", date))).alias("c"))
    empty = F.array().cast(positions.schema["c"].dataType)
    kept = F.aggregate(
        "c",
        empty,
        lambda acc, p: F.when(
            (F.size(acc) == 0) | (p["idx"] - F.element_at(acc, -1)["idx"] >= size), F.concat(acc, F.array(p))
        ).otherwise(acc),
    )
    return positions.select(*keys, F.explode(kept).alias("p")).select(*keys, "p.idx", F.col(f"p.{date}").alias(date))


def strongest(points: DataFrame, keys: Sequence[str], date: str, k: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("magnitude"), date)
    return points.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_chain(
    points: DataFrame, keys: Sequence[str], date: str, signal: str, gap_days: int = 3, class_words: Sequence[str] = CLASS_WORDS
) -> DataFrame:
    """Group points while each is at most ``gap_days`` after the previous one.

    Keeps the date of the most confident point, mean magnitude and confidence, the modal type.
    """
    w = Window.partitionBy(*keys).orderBy(date, signal)
    opens = F.coalesce((F.datediff(date, F.lag(date).over(w)) > gap_days).cast("int"), F.lit(1))
    tagged = points.withColumn("__new", opens).withColumn(
        "group_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return tagged.withColumn("__type", change_type(F.col(signal), class_words)).groupBy(*keys, "group_no").agg(
        F.min_by(date, F.struct(-F.col("confidence"), F.col(date), F.col(signal))).alias(date),
        F.avg("magnitude").alias("magnitude"),
        F.avg("confidence").alias("confidence"),
        F.mode("__type", True).alias("change_type"),
        F.count(F.lit(1)).alias("n_points"),
    )


def merge_anchor(points: DataFrame, keys: Sequence[str], date: str, signal: str, gap_days: int = 3) -> DataFrame:
    """Group points while at most ``gap_days`` after the *first* point of the group.

    Heads are found by a fold over the sorted distinct dates.
    """
    dates = points.groupBy(*keys).agg(F.sort_array(F.collect_set(date)).alias("__ds"))
    heads = F.aggregate(
        "__ds",
        F.array().cast("array<date>"),
        lambda acc, d: F.when(
            (F.size(acc) == 0) | (F.datediff(d, F.element_at(acc, -1)) > gap_days), F.concat(acc, F.array(d))
        ).otherwise(acc),
    )
    spans = dates.select(*keys, F.explode(heads).alias("head")).withColumn(
        "__day", F.explode(F.sequence("head", F.date_add("head", gap_days)))
    )
    # a date within the reach of two heads belongs to the later one only if it is that head's own group
    owner = spans.groupBy(*keys, "__day").agg(F.max("head").alias("head")).withColumnRenamed("__day", date)
    tagged = points.join(owner, [*keys, date])
    return tagged.groupBy(*keys, "head").agg(
        F.concat_ws(",", F.sort_array(F.collect_set(signal))).alias("signals"),
        F.avg("magnitude").alias("magnitude"),
        F.count(F.lit(1)).alias("n_points"),
        F.when(F.count(F.lit(1)) > 1, "multi_signal_shift").otherwise("single_signal_shift").alias("change_type"),
    )


def _slope_p(slope_cols: DataFrame) -> DataFrame:
    n, r2 = F.col("n"), F.col("r_squared")
    t = F.sqrt(F.try_divide(r2 * (n - 2), F.greatest(1 - r2, F.lit(1e-15))))
    return slope_cols.withColumn("p_value", t_two_sided_col(t, n - 2))


def linear_trends(series: DataFrame, keys: Sequence[str], date: str, x: str, min_rows: int = 10, alpha: float = 0.05) -> DataFrame:
    """OLS on days from the start: slope, intercept, r2, p, direction."""
    day = F.datediff(date, F.min(date).over(Window.partitionBy(*keys)))
    fit = (
        series.filter(F.col(x).isNotNull())
        .withColumn("__t", day)
        .groupBy(*keys)
        .agg(
            F.regr_slope(x, "__t").alias("slope"),
            F.regr_intercept(x, "__t").alias("intercept"),
            F.regr_r2(x, "__t").alias("r_squared"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") >= min_rows)
    )
    direction = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return _slope_p(fit).withColumns({"significant": F.col("p_value") < alpha, "direction": direction})


def balance_trend(daily: DataFrame, date: str, a: str, b: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Regression of a - b on the row index with a reading of the slope."""
    w = _by(keys, date)
    diff = F.coalesce(F.col(a), F.lit(0.0)) - F.coalesce(F.col(b), F.lit(0.0))
    fit = daily.withColumns({"__i": F.row_number().over(w) - 1, "__y": diff}).groupBy(*keys).agg(
        F.regr_slope("__y", "__i").alias("slope"), F.regr_r2("__y", "__i").alias("r_squared"), F.count(F.lit(1)).alias("n")
    )
    reading = (
        F.when(F.col("p_value") >= alpha, "none")
        .when(F.col("slope") > 0.01, "toward_first")
        .when(F.col("slope") < -0.01, "toward_second")
        .otherwise("stable")
    )
    return _slope_p(fit).withColumn("reading", reading)


def high_value_periods(series: DataFrame, keys: Sequence[str], date: str, x: str, q: float = 0.75) -> DataFrame:
    """Rows above the quantile: count, mean run length, frequency."""
    w = _by(keys, date)
    bound = series.groupBy(*keys).agg(F.percentile(x, q).alias("__q"), F.count(F.lit(1)).alias("__n"))
    tagged = series.join(bound, list(keys)).withColumns({"__hi": F.col(x) > F.col("__q"), "__rn": F.row_number().over(w)})
    high = tagged.filter("__hi").withColumn("__island", F.col("__rn") - F.row_number().over(w))
    runs = high.groupBy(*keys, "__island", "__n").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(*keys, "__n").agg(F.sum("len").alias("n_high"), F.avg("len").alias("mean_run")).select(
        *keys, "n_high", "mean_run", (F.col("n_high") / F.col("__n")).alias("frequency")
    )


def calendar_profile(series: DataFrame, keys: Sequence[str], date: str, x: str) -> DataFrame:
    """Mean and sample std by weekday and by month, in one grouping-sets pass."""
    tagged = series.select(*keys, F.weekday(date).alias("dow"), F.month(date).alias("month"), x)
    out = tagged.groupingSets([[*keys, "dow"], [*keys, "month"]], *keys, "dow", "month").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(F.lit(1)).alias("n")
    )
    return out.select(
        *keys,
        F.when(F.col("dow").isNotNull(), "weekday").otherwise("month").alias("part"),
        F.coalesce("dow", "month").alias("level"),
        "mean",
        "std",
        "n",
    )


def anova(df: DataFrame, keys: Sequence[str], group: str, x: str, min_rows: int = 0) -> DataFrame:
    """One-way F from group sizes, means and variances."""
    g = df.filter(F.col(x).isNotNull()).groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("v")
    )
    s = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n_total"),
        F.sum(F.col("n") * F.col("m")).alias("sm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("n_total")
    within = F.try_divide(F.col("within"), F.col("n_total") - F.col("k"))
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), within)
    out = s.filter((F.col("n_total") >= min_rows) & (F.col("k") > 1)).select(*keys, "k", "n_total", f.alias("f_statistic"))
    return out.withColumn("p_value", f_upper_col(F.col("f_statistic"), F.col("k") - 1, F.col("n_total") - F.col("k")))


def seasonal_decompose(series: DataFrame, keys: Sequence[str], date: str, x: str, period: int = 7) -> DataFrame:
    """Additive decomposition; the period of a key is ``period``, or a quarter of its rows if that is less.

    Trend is the centred moving average (for an even period its outer rows count
    half), its ends extrapolated by a line through the nearest trend values of one
    period; seasonal is the centred phase mean.
    """
    w, whole = _by(keys, date), Window.partitionBy(*keys)
    base = series.withColumns({"idx": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(whole)})
    base = base.withColumn("__p", F.greatest(F.lit(1), F.least(F.lit(period), F.floor(F.col("__n") / 4))).cast("int"))
    base = base.withColumn("__half", F.floor(F.col("__p") / 2).cast("int"))
    n, p, half = F.col("__n"), F.col("__p"), F.col("__half")

    def centred(size: int) -> Column:
        reach = size // 2
        if size % 2:
            return F.avg(x).over(w.rowsBetween(-reach, reach))
        outer = (F.lag(x, reach).over(w) + F.lead(x, reach).over(w)) / 2
        return (F.sum(x).over(w.rowsBetween(-reach, reach)) - outer) / size

    mean = F.col(x)
    for size in range(2, period + 1):
        mean = F.when(p == size, centred(size)).otherwise(mean)
    base = base.withColumn("__ma", F.when((F.col("idx") >= half) & (F.col("idx") < n - half), mean))
    head = F.when(F.col("idx") < half + p, F.col("__ma"))
    tail = F.when(F.col("idx") >= n - half - p, F.col("__ma"))
    i = F.col("idx").cast("double")
    ends = base.groupBy(*keys).agg(
        F.regr_slope(head, i).alias("__hs"), F.regr_intercept(head, i).alias("__hi"),
        F.regr_slope(tail, i).alias("__ts"), F.regr_intercept(tail, i).alias("__ti"),
    )
    line = F.when(F.col("idx") < half, F.col("__hs") * i + F.col("__hi")).otherwise(F.col("__ts") * i + F.col("__ti"))
    out = base.join(ends, list(keys)) if keys else base.withColumn("__e", ends.select(F.struct("*")).scalar()).select("*", "__e.*")
    out = out.withColumn("trend", F.coalesce("__ma", line)).withColumn("__phase", F.col("idx") % p)
    phases = out.groupBy(*keys, "__phase").agg(F.avg(F.col(x) - F.col("trend")).alias("__s"))
    phases = phases.withColumn("seasonal", F.col("__s") - F.avg("__s").over(whole)).drop("__s")
    out = out.join(phases, [*keys, "__phase"]).withColumn("residual", F.col(x) - F.col("trend") - F.col("seasonal"))
    return out.select(*keys, date, x, "trend", "seasonal", "residual")


def component_strength(parts: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.try_divide(F.var_pop("trend"), F.var_pop(x)).alias("trend_strength"),
        F.try_divide(F.var_pop("seasonal"), F.var_pop(x)).alias("seasonal_strength"),
    )


def habit_strength(series: DataFrame, keys: Sequence[str], signal: str, x: str, counts: Sequence[str] = ("n_plays",)) -> DataFrame:
    """1 - std / max(mean, floor), at least 0; the floor is 1 for counts and .001 for shares. Adds the overall mean."""
    floor = F.when(F.col(signal).isin(*counts), 1.0).otherwise(0.001)
    out = series.groupBy(*keys, signal).agg(F.stddev_samp(x).alias("sd"), F.avg(x).alias("m"))
    out = out.withColumn("consistency", F.greatest(F.lit(0.0), 1 - F.col("sd") / F.greatest(F.col("m"), floor)))
    return out.withColumn("overall", F.avg("consistency").over(Window.partitionBy(*keys))).select(*keys, signal, "consistency", "overall")


def exploration_cycles(series: DataFrame, keys: Sequence[str], date: str, x: str) -> DataFrame:
    """Peaks, valleys, mean peak spacing, spacing regularity (three or more peaks)."""
    ext = local_extrema(series, keys, date, x)
    w = Window.partitionBy(*keys, "kind").orderBy("idx")
    gaps = ext.withColumn("__g", F.when(F.col("kind") == "peak", F.col("idx") - F.lag("idx").over(w)))
    peaks = F.count_if(F.col("kind") == "peak")
    regular = F.greatest(F.lit(0.0), 1 - F.stddev_pop("__g") / F.greatest(F.avg("__g"), F.lit(1.0)))
    return gaps.groupBy(*keys).agg(
        peaks.alias("n_peaks"),
        F.count_if(F.col("kind") == "valley").alias("n_valleys"),
        F.avg("__g").alias("avg_cycle_length"),
        F.when(peaks >= 3, regular).alias("rhythm_regularity"),
    )


def year_over_year_shift(yearly: DataFrame, year: str, share: str, keys: Sequence[str] = (), bound: float = 0.15) -> DataFrame:
    delta = F.col(share) - F.lag(share).over(_by(keys, year))
    out = yearly.withColumn("change", delta)
    direction = F.when(F.col("change") > 0, "increase").otherwise("decrease")
    return out.filter(F.abs("change") > bound).withColumn("direction", direction)


def stability_periods(
    daily: DataFrame, points: DataFrame, date: str, scores: Sequence[str], plays: str, min_days: int = 14, max_cv: float = 0.1, max_slope: float = 0.05, alpha: float = 0.05
) -> DataFrame:
    """Intervals before, between and after the change points that last at least ``min_days``.

    Only the ones in between must also vary little (CV) and have no significant
    slope; without change points the whole range is one period. The interval
    table is small: its days are expanded and joined to the daily rows by date.
    """
    ends = daily.agg(F.min(date).alias("d0"), F.max(date).alias("d1"))
    w = Window.orderBy("p")  # change points: at most one per date
    cps = points.select(F.col(date).alias("p")).distinct()
    between = cps.select(F.lit("between").alias("kind"), F.col("p").alias("s"), F.lead("p").over(w).alias("e"))
    first = cps.agg(F.min("p").alias("p"))
    last = cps.agg(F.max("p").alias("p"))
    d0, d1 = ends.select("d0").scalar(), ends.select("d1").scalar()
    before = first.select(F.lit("before").alias("kind"), d0.alias("s"), F.col("p").alias("e"))
    after = last.select(F.lit("after").alias("kind"), F.col("p").alias("s"), d1.alias("e"))
    whole = first.filter(F.col("p").isNull()).select(F.lit("whole").alias("kind"), d0.alias("s"), d1.alias("e"))
    spans = between.union(before).union(after).filter(F.datediff("e", "s") >= min_days).union(whole)
    # before/between are [s, e), after is (s, e], whole is [s, e]
    lo = F.when(F.col("kind") == "after", F.date_add("s", 1)).otherwise(F.col("s"))
    hi = F.when(F.col("kind").isin("before", "between"), F.date_sub("e", 1)).otherwise(F.col("e"))
    days = spans.withColumn(date, F.explode(F.sequence(lo, hi)))
    rows = days.join(daily, date)
    i = F.row_number().over(Window.partitionBy("kind", "s", "e").orderBy(date)) - 1
    rows = rows.withColumn("__i", i)
    aggs = []
    for c in scores:
        aggs += [
            F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"),
            F.regr_slope(c, "__i").alias(f"slope_{c}"), F.regr_r2(c, "__i").alias(f"r2_{c}"),
        ]
    stats = rows.groupBy("kind", F.col("s").alias("start_date"), F.col("e").alias("end_date")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(plays).alias("mean_plays"), *aggs
    )
    for c in scores:
        n, r2 = F.col("n"), F.col(f"r2_{c}")
        stats = stats.withColumn(f"p_{c}", t_two_sided_col(F.sqrt(r2 * (n - 2) / F.greatest(1 - r2, F.lit(1e-15))), n - 2))
        steady = F.col(f"std_{c}") / F.greatest(F.col(f"mean_{c}"), F.lit(0.001)) <= max_cv
        drift = (n >= 7) & (F.col(f"p_{c}") < alpha) & (F.abs(f"slope_{c}") > max_slope)
        stats = stats.filter((F.col("kind") != "between") | (F.coalesce(steady, F.lit(True)) & ~F.coalesce(drift, F.lit(False))))
    return stats.drop(*[f"{k}_{c}" for c in scores for k in ("slope", "r2", "p")])


def period_statistics(daily: DataFrame, period: Sequence[str], date: str, scores: Sequence[str], plays: str) -> DataFrame:
    """Duration, rows, mean plays and mean and std of the scores per interval."""
    aggs = []
    for s in scores:
        aggs += [F.avg(s).alias(f"mean_{s}"), F.stddev_samp(s).alias(f"std_{s}")]
    return daily.groupBy(*period).agg(
        F.datediff(F.max(date), F.min(date)).alias("duration_days"),
        F.count(F.lit(1)).alias("n"),
        F.avg(plays).alias("mean_plays"),
        *aggs,
    )


def month_clustering(points: DataFrame, date: str) -> DataFrame:
    """Change points per month over all 12 months (zero-filled), rank and chi-square against a uniform year."""
    counts = points.groupBy(F.month(date).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = points.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    out = months.join(counts, "month", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    year = Window.partitionBy()  # 12 rows
    expected = F.sum("n").over(year) / 12
    out = out.withColumn("__e", expected)
    out = out.withColumn("chi_square", F.sum(F.try_divide((F.col("n") - F.col("__e")) ** 2, F.col("__e"))).over(year)).drop("__e")
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "month")))
    return out.withColumn("p_value", chi2_upper_col(F.col("chi_square"), F.lit(11)))


def major_shifts(daily: DataFrame, points: DataFrame, date: str, signals: Sequence[str], k: int = 5, days: int = 14) -> DataFrame:
    """The k merged points above the median magnitude with their context, a sentence and a type."""
    median = points.select(F.median("magnitude")).scalar()  # merged change points: at most one per date
    top = points.filter(F.col("magnitude") > median).orderBy(F.desc("magnitude"), date).limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("magnitude"), date)))
    top = top.select(F.col(date).alias("shift_date"), "magnitude", "rank")
    out = context_before_after(daily, top, date, "shift_date", signals, days)
    parts = []
    for s in signals:
        pct = F.col(f"{s}_pct")
        name = s.replace("_", " ").replace("avg ", "average ").title()
        verb = F.when(pct > 0, "increased").otherwise("decreased")
        parts.append(F.when(F.abs(pct) > 10, F.concat(F.lit(name + " "), verb, F.lit(" by "), F.format_string("%.1f%%", F.abs(pct)))))
    day = F.date_format("shift_date", "yyyy-MM-dd")
    text = F.concat_ws("; ", *parts)
    sentence = F.when(text == "", F.concat(F.lit("Subtle preference shift on "), day)).otherwise(F.concat(F.lit("On "), day, F.lit(": "), text))
    first, second, third = (F.col(f"{s}_pct") for s in signals[:3])
    kind = (
        F.when((F.abs(first) > F.abs(second)) & (F.abs(first) > 15), F.when(first > 0, "cultural_shift").otherwise("cultural_shift_away"))
        .when(F.abs(second) > 15, F.when(second > 0, "western_cultural_shift").otherwise("western_shift_away"))
        .when(F.abs(third) > 15, F.when(third > 0, "energy_shift").otherwise("mellowing_shift"))
        .otherwise("general_preference_shift")
    )
    return out.withColumns({"description": sentence, "shift_type": kind})


def decay_fit(curve: DataFrame, keys: Sequence[str], horizon: str, accuracy: str) -> DataFrame:
    """Exponential, power and linear fits per series: a, b, r2 (on the fitted scale), rmse (original scale), best."""
    x, y = F.col(horizon).cast("double"), F.col(accuracy)
    lx, ly = F.ln(F.greatest(x, F.lit(0.1))), F.ln(F.greatest(y, F.lit(0.001)))
    fits = curve.groupBy(*keys).agg(
        *[
            f(a, b).alias(f"{model}_{name}")
            for model, a, b in (("exponential", ly, x), ("power_law", ly, lx), ("linear", y, x))
            for name, f in (("i", F.regr_intercept), ("s", F.regr_slope), ("r2", F.regr_r2))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                (F.col(f"{m}_i") if m == "linear" else F.exp(f"{m}_i")).alias("a"),
                (F.col(f"{m}_s") if m == "linear" else -F.col(f"{m}_s")).alias("b"),
                F.col(f"{m}_r2").alias("r_squared"),
            )
            for m in ("exponential", "power_law", "linear")
        ]
    )
    long = fits.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.*")
    joined = curve.join(long, list(keys)) if keys else curve.withColumn("__m", F.explode(fits.select(rows).scalar())).select(*curve.columns, "__m.*")
    err = y - decay_value("model", "a", "b", x)
    scored = joined.groupBy(*keys, "model", "a", "b", "r_squared").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("rmse", "model")) == 1  # three rows per series
    return scored.withColumn("is_best", best)


def decay_value(model: str, a: str, b: str, x: Column) -> Column:
    return (
        F.when(F.col(model) == "exponential", F.col(a) * F.exp(-F.col(b) * x))
        .when(F.col(model) == "power_law", F.col(a) * F.pow(F.greatest(x, F.lit(0.1)), -F.col(b)))
        .otherwise(F.col(a) + F.col(b) * x)
    )


def decay_predictions(fits: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """The best model at each horizon, clipped to [.1, 1]."""
    out = fits.filter("is_best").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    value = decay_value("model", "a", "b", F.col("horizon").cast("double"))
    return out.withColumn("predicted", F.least(F.lit(1.0), F.greatest(F.lit(0.1), value)))


def decay_from_volatility(
    daily: DataFrame, date: str, signals: Sequence[str], keys: Sequence[str] = (), horizons: Sequence[int] = (1, 7, 14, 30, 60, 90)
) -> DataFrame:
    v = rolling_volatility(daily, keys, date, signals).groupBy(*keys).agg(F.avg("volatility").alias("avg_volatility"))
    out = v.withColumn("days_ahead", F.explode(F.array(*[F.lit(h) for h in horizons])))
    rate = 0.02 + 0.1 * F.col("avg_volatility")
    return out.withColumn("predicted_accuracy", 0.95 * F.exp(-rate * F.col("days_ahead")))


def period_stability(values: DataFrame, period: str, item: str, x: str, min_rows: int = 50, min_common: int = 10) -> DataFrame:
    """Pearson r of the item vectors of consecutive periods with enough rows and common items."""
    from encore.operators.joins import consecutive_pairs

    big = values.groupBy(period).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows)
    big = big.withColumn("__i", F.row_number().over(Window.orderBy(period))).drop("__n")  # one row per period
    pairs = consecutive_pairs(values.join(big, period), item, "__i", x)
    return pairs.groupBy("period").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n_common")).filter(
        F.col("n_common") >= min_common
    )


def recent_context_label(points: DataFrame, date: str, signal: str, as_of: Column, first: str, second: str, energy: str, days: int = 60) -> DataFrame:
    """Label of the change points younger than ``days``: stable, a class shift, an energy shift or exploration."""
    recent = points.filter((F.datediff(as_of, date) < days) & (F.datediff(as_of, date) >= 0))
    s = F.col(signal)
    flags = recent.agg(
        F.count(F.lit(1)).alias("n_recent"),
        F.coalesce(F.bool_or(s == first), F.lit(False)).alias("a"),
        F.coalesce(F.bool_or(s == second), F.lit(False)).alias("b"),
        F.coalesce(F.bool_or(s.contains(energy)), F.lit(False)).alias("c"),
    )
    label = (
        F.when(F.col("n_recent") == 0, "stable").when(F.col("a"), f"{first}_shift").when(F.col("b"), f"{second}_shift")
        .when(F.col("c"), "energy_shift").otherwise("preference_exploration")
    )
    return flags.select("n_recent", label.alias("context"))


def events_near(points: DataFrame, events: DataFrame, point_date: str, event_date: str, days: int = 7) -> DataFrame:
    return within_days(points, events, point_date, event_date, days)
