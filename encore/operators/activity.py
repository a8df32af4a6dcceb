"""Grouped activity reports and pivots (F)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.operators.ranking import top_k, top_k_per_group



def modal_values(df: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties: counts first, then one row per group."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v")))
    return counts.groupBy(*group).agg(best.alias("__b")).select(*group, F.col("__b.v").alias(f"modal_{col}"))


def session_stats(df: DataFrame, group: Sequence[str], ts: str, track: str, artist: str, ms: str, skipped: Column, modal: Sequence[str]) -> DataFrame:
    """One row per session."""
    minutes = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 60_000_000
    out = df.withColumn("__skip", skipped.cast("int")).groupBy(*group).agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count("*").alias("plays"),
        F.countDistinct(track).alias("tracks"),
        F.countDistinct(artist).alias("artists"),
        F.sum(ms).alias("total_ms"),
        F.sum("__skip").alias("skips"),
        minutes.alias("duration_min"),
        F.avg("__skip").alias("skip_rate"),
    )
    for c in modal:
        out = out.join(modal_values(df, group, c), list(group), "left")
    return out


def session_intensity(df: DataFrame, group: Sequence[str], ts: str, is_class: Column) -> DataFrame:
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 3_600_000_000
    return df.groupBy(*group).agg(
        F.count("*").alias("plays"),
        span.alias("span_hours"),
        (F.count("*") / (span + 0.1)).alias("intensity"),
        F.avg(is_class.cast("double")).alias("class_ratio"),
        F.min(F.hour(ts)).alias("min_hour"),
        F.max(F.hour(ts)).alias("max_hour"),
        F.avg(F.hour(ts)).alias("mean_hour"),
    )


def activity_by_dimension(df: DataFrame, dims: Sequence[str], ms: str) -> DataFrame:
    """Count, total ms and mean minutes by each dimension: one scan with grouping sets."""
    typed = df.select(*[F.col(d).cast("string").alias(d) for d in dims], ms)
    out = typed.groupingSets([[d] for d in dims], *dims).agg(
        F.count("*").alias("plays"), F.sum(ms).alias("total_ms"), F.avg(F.col(ms) / 60000).alias("avg_minutes"), F.grouping_id().alias("__gid")
    )
    # the grouping id has a 0 bit only for the dimension of the row
    full = 2 ** len(dims) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        here = F.col("__gid") == full - 2 ** (len(dims) - 1 - i)
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d)).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("key"), "plays", "total_ms", "avg_minutes")


def location_timeline(df: DataFrame, location: str, ts: str, ms: str, track: str, artist: str) -> DataFrame:
    return df.groupBy(location, F.to_date(ts).alias("date")).agg(
        F.sum(ms).alias("total_ms"), F.countDistinct(track).alias("tracks"), F.countDistinct(artist).alias("artists")
    )


def count_pivot(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts by row and column value, missing cells 0. The values are given, so no extra scan lists them."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def processing_stats(df: DataFrame, ts: str, ms: str, track: str, artist: str, user: str, listed: str) -> DataFrame:
    """Totals row; the listed column must be a short category list."""
    return df.agg(
        F.count("*").alias("plays"),
        F.countDistinct(track).alias("tracks"),
        F.countDistinct(artist).alias("artists"),
        F.countDistinct(user).alias("users"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.concat_ws(",", F.sort_array(F.collect_set(listed))).alias("listed"),
        F.sum(C.to_hours(ms)).alias("total_hours"),
        F.avg(C.completion_rate(ms)).alias("mean_completion"),
    )


def class_statistics(df: DataFrame, flags: dict[str, Column], confidence: str) -> DataFrame:
    n = F.count("*")
    any_flag = F.lit(False)
    aggs = [n.alias("total")]
    for name, cond in flags.items():
        cond = F.coalesce(cond, F.lit(False))
        any_flag = any_flag | cond
        aggs += [F.count_if(cond).alias(f"n_{name}"), F.try_divide(F.count_if(cond) * 100.0, n).alias(f"pct_{name}")]
    return df.agg(
        *aggs,
        F.count_if(~any_flag).alias("n_uncategorised"),
        F.avg(confidence).alias("mean_confidence"),
        F.stddev_samp(confidence).alias("std_confidence"),
    )


def daily_preferences(df: DataFrame, ts: str, track: str, artist: str, label: str, scores: Sequence[str]) -> DataFrame:
    """Per date: plays, distincts, mean and sample std of each score, exploration and class diversity.

    A one-row day has no std; it gets the column mean.
    """
    aggs = [F.count("*").alias("n_plays"), F.countDistinct(track).alias("tracks"), F.countDistinct(artist).alias("artists")]
    for s in scores:
        aggs += [F.avg(s).alias(f"avg_{s}"), F.stddev_samp(s).alias(f"std_{s}")]
    diversity = F.countDistinct(label) + F.max(F.col(label).isNull().cast("int"))
    daily = df.groupBy(F.to_date(ts).alias("date")).agg(*aggs, diversity.alias("diversity"))
    daily = daily.withColumn("exploration_rate", F.col("tracks") / F.col("n_plays"))
    whole = Window.partitionBy()  # daily grain: one row per date
    return daily.withColumns({f"std_{s}": F.coalesce(f"std_{s}", F.avg(f"std_{s}").over(whole)) for s in scores})


def daily_signals(df: DataFrame, ts: str, ms: str, artist: str, scores: Sequence[str]) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("date")).agg(
        F.sum(C.to_minutes(ms)).alias("total_minutes"),
        F.count("*").alias("n_plays"),
        F.countDistinct(artist).alias("artists"),
        *[F.avg(s).alias(f"avg_{s}") for s in scores],
    )


def daily_model_table(df: DataFrame, ts: str, features: dict[str, Column]) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("date")).agg(
        F.count("*").alias("plays"), *[F.avg(c.cast("double")).alias(n) for n, c in features.items()]
    )


def period_activity(df: DataFrame, period: Column, artist: str, ms: str, last: int | None = None) -> DataFrame:
    """Plays, distinct artists and minutes per period; optionally only the latest periods."""
    out = df.groupBy(period.alias("period")).agg(
        F.count("*").alias("plays"), F.countDistinct(artist).alias("artists"), F.sum(C.to_minutes(ms)).alias("minutes")
    )
    return out.orderBy(F.desc("period")).limit(last) if last else out


def yearly_overview(df: DataFrame, ts: str, artist: str, ms: str) -> DataFrame:
    return df.groupBy(F.year(ts).alias("year")).agg(
        F.count("*").alias("plays"),
        F.countDistinct(artist).alias("artists"),
        F.sum(C.to_hours(ms)).alias("hours"),
        (F.count("*") / 365).alias("plays_per_day"),
    )


def weekend_vs_weekday(df: DataFrame, ts: str, artist: str, ms: str) -> DataFrame:
    by = df.groupBy(C.weekend_flag(ts).alias("is_weekend")).agg(
        F.count("*").alias("plays"), F.avg(C.to_minutes(ms)).alias("avg_minutes"), F.countDistinct(artist).alias("artists")
    )
    both = Window.partitionBy()  # two rows
    boost = F.max(F.when(F.col("is_weekend"), F.col("plays"))).over(both) / F.max(
        F.when(~F.col("is_weekend"), F.col("plays"))
    ).over(both)
    return by.withColumn("weekend_boost", boost)


def hour_day_heatmap(df: DataFrame, ts: str) -> DataFrame:
    tagged = df.select(F.weekday(ts).alias("dow"), F.hour(ts).alias("hour"))
    return count_pivot(tagged, "dow", "hour", range(24))


def calendar_heatmap(df: DataFrame, ts: str) -> DataFrame:
    daily = df.groupBy(F.to_date(ts).alias("date")).agg(F.count("*").alias("plays"))
    cells = daily.select(F.month("date").alias("month"), F.dayofmonth("date").alias("dom"), "plays")
    return cells.groupBy("month").pivot("dom", list(range(1, 32))).agg(F.avg("plays"))


def session_summary(sessions: DataFrame, plays: str, minutes: str) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.avg(plays).alias("mean_tracks"),
        F.avg(minutes).alias("mean_minutes"),
        F.max(minutes).alias("max_minutes"),
        F.stddev_samp(minutes).alias("std_minutes"),
    )


def length_histogram(sessions: DataFrame, plays: str, k: int = 10) -> DataFrame:
    by = sessions.groupBy(F.col(plays).alias("tracks")).agg(F.count("*").alias("sessions"))
    return by.orderBy(F.desc("sessions"), "tracks").limit(k)


def category_share(df: DataFrame, col: str, within: Sequence[str] = ()) -> DataFrame:
    """Share of each value, overall or within context columns; the window runs on the counts."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*within, col).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def hourly_ratio(df: DataFrame, ts: str, is_class: Column) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("plays"), F.avg(is_class.cast("double")).alias("class_ratio"))


def artist_temporal_profile(df: DataFrame, artist: str, ts: str, label: str, k: int = 50, min_plays: int = 10) -> DataFrame:
    """For the k most played artists with more than ``min_plays``: modal band, hour and label, weekend and work share."""
    top = top_k(df, artist, k).filter(F.col("plays") > min_plays)
    mine = df.join(top.select(artist), artist, "left_semi")
    hour = F.hour(ts)
    return mine.groupBy(artist).agg(
        F.mode(C.time_of_day_bands(hour), True).alias("preferred_band"),
        F.mode(hour, True).alias("preferred_hour"),
        F.avg(C.weekend_flag(ts).cast("double")).alias("weekend_share"),
        F.avg(C.work_hours_flag(ts).cast("double")).alias("work_share"),
        F.mode(label, True).alias("modal_label"),
        F.count("*").alias("plays"),
    )


def artist_listening_patterns(df: DataFrame, artist: str, ts: str, session: Sequence[str], label: str, k: int = 20) -> DataFrame:
    """Top-k artists: peak hour and weekday, sample std of the hourly shares, plays per session, modal label."""
    top = top_k(df, artist, k)
    mine = df.join(top.select(artist), artist, "left_semi").withColumns({"__h": F.hour(ts), "__d": F.weekday(ts)})
    hours = category_share(mine, "__h", [artist]).groupBy(artist).agg(F.stddev_samp("share").alias("hour_spread"))
    per_session = mine.groupBy(artist, *session).agg(F.count("*").alias("n")).groupBy(artist).agg(F.avg("n").alias("plays_per_session"))
    peaks = mine.groupBy(artist).agg(
        F.mode("__h", True).alias("peak_hour"), F.mode("__d", True).alias("peak_day"), F.mode(label, True).alias("modal_label")
    )
    return top.join(peaks, artist).join(hours, artist).join(per_session, artist)


def artist_dim(df: DataFrame, artist: str, ms: str, location: str) -> DataFrame:
    return df.groupBy(artist).agg(
        F.count("*").alias("plays"), F.sum(ms).alias("total_ms"), F.mode(location, True).alias("modal_location")
    )


def track_stats(df: DataFrame, keys: Sequence[str], ms: str, label: str, means: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(C.to_minutes(ms)).alias("total_minutes"),
        F.count("*").alias("play_count"),
        F.mode(label, True).alias("modal_label"),
        *[F.avg(m).alias(f"avg_{m}") for m in means],
    )


def user_features(df: DataFrame, user: str, ts: str, track: str, artist: str, label: str, scores: Sequence[str]) -> DataFrame:
    out = df.groupBy(user).agg(
        *[F.avg(s).alias(f"mean_{s}") for s in scores],
        F.countDistinct(artist).alias("artists"),
        F.countDistinct(track).alias("tracks"),
        F.countDistinct(label).alias("classes"),
        F.avg(F.hour(ts)).alias("mean_hour"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count("*").alias("plays"),
    )
    span = F.floor((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 86_400_000_000)
    return out.withColumns(
        {"span_days": span, "plays_per_day": F.col("plays") / (span + 1), "artist_diversity": F.col("artists") / F.col("plays")}
    )


def user_personality_features(df: DataFrame, user: str, ts: str, artist: str, label: str, scores: Sequence[str], min_rows: int = 10) -> DataFrame:
    """Mean scores, share of the top artist, hour variance, plays per active day, class diversity."""
    top = df.filter(F.col(artist).isNotNull()).groupBy(user, artist).agg(F.count("*").alias("n")).groupBy(user).agg(F.max("n").alias("__top"))
    base = df.groupBy(user).agg(
        *[F.avg(s).alias(f"{s}_ratio") for s in scores],
        F.count("*").alias("plays"),
        F.countDistinct(artist).alias("unique_artists"),
        F.var_samp(F.hour(ts)).alias("hour_variance"),
        F.try_divide(F.count("*"), F.countDistinct(F.to_date(ts))).alias("listening_consistency"),
        (F.countDistinct(label) / 4).alias("cultural_diversity"),
    ).filter(F.col("plays") >= min_rows)
    return base.join(top, user).withColumn("artist_concentration", F.col("__top") / F.col("plays")).drop("__top")


def audio_profile(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    aggs = [F.count("*").alias("tracks")]
    for f in features:
        aggs += [F.avg(f).alias(f"mean_{f}"), F.stddev_samp(f).alias(f"std_{f}")]
    return df.groupBy(group).agg(*aggs)


def extremes(profile: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Group with the largest and smallest mean per feature; ties to the smaller key."""
    rows = []
    for f in features:
        rows += [F.struct(F.lit(f).alias("feature"), F.min_by(key, F.struct(-F.col(f"mean_{f}"), F.col(key))).alias("highest"), F.min_by(key, F.struct(F.col(f"mean_{f}"), F.col(key))).alias("lowest"))]
    return profile.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def category_profile(df: DataFrame, category: str, features: Sequence[str], artist: str, genres: str, added: str) -> DataFrame:
    """Per category: tracks, mean features, distinct artists and genres, first and last added."""
    base = df.groupBy(category).agg(
        F.count("*").alias("tracks"),
        *[F.avg(f).alias(f"mean_{f}") for f in features],
        F.countDistinct(artist).alias("artists"),
        F.min(added).alias("first_added"),
        F.max(added).alias("last_added"),
    )
    exploded = df.select(category, F.explode(genres).alias("g")).distinct()
    return base.join(exploded.groupBy(category).agg(F.count("*").alias("genres")), category, "left")


def culture_profile(df: DataFrame, group: str, label: str, classes: Sequence[str]) -> DataFrame:
    """Per group: rows, modal label, number of labels, share of each class."""
    return df.groupBy(group).agg(
        F.count("*").alias("tracks"),
        F.mode(label, True).alias("dominant"),
        F.countDistinct(label).alias("diversity"),
        *[F.avg((F.col(label) == c).cast("double")).alias(f"share_{c}") for c in classes],
    )


def timeline(df: DataFrame, group: str, ts: str) -> DataFrame:
    span = F.datediff(F.max(ts), F.min(ts))
    return df.groupBy(group).agg(
        F.min(ts).alias("first_added"),
        F.max(ts).alias("last_added"),
        span.alias("span_days"),
        F.count("*").alias("tracks"),
        (F.count("*") / F.greatest(span, F.lit(1))).alias("per_day"),
    )


def multi_group_items(df: DataFrame, item: Sequence[str], group: str, valence: str, energy: str, ts: str, min_groups: int = 2) -> DataFrame:
    """Items in several groups; score = groups + closeness of valence and energy to .5."""
    pairs = df.groupBy(*item, group).agg(
        F.sum(valence).alias("sv"), F.sum(energy).alias("se"), F.count("*").alias("n"), F.min(ts).alias("t")
    )
    out = pairs.groupBy(*item).agg(
        F.count("*").alias("n_groups"),
        (F.sum("sv") / F.sum("n")).alias("mean_valence"),
        (F.sum("se") / F.sum("n")).alias("mean_energy"),
        F.min("t").alias("first_added"),
    ).filter(F.col("n_groups") >= min_groups)
    return out.withColumn(
        "score", F.col("n_groups") + (1 - F.abs(F.col("mean_valence") - 0.5)) + (1 - F.abs(F.col("mean_energy") - 0.5))
    )


def artist_discovery(df: DataFrame, artist: str, ts: str, k: int = 5, names: int = 5) -> DataFrame:
    """Months with most first plays and the first few names (by first play)."""
    first = df.filter(F.col(artist).isNotNull()).groupBy(artist).agg(F.min(ts).alias("first_ts"))
    first = first.withColumn("month", C.month_period("first_ts"))
    months = first.groupBy("month").agg(F.count("*").alias("new_artists")).orderBy(F.desc("new_artists"), "month").limit(k)
    named = top_k_per_group(first, ["month"], [F.col("first_ts"), F.col(artist)], names)
    lists = named.groupBy("month").agg(F.sort_array(F.collect_list(F.struct("rank", artist))).alias("r"))
    return months.join(lists, "month").select(
        "month", "new_artists", F.concat_ws(",", F.transform("r", lambda x: x[artist].cast("string"))).alias("first_names")
    )


def yearly_class_ratio(df: DataFrame, ts: str, artist: str, is_class: Column, k: int = 10) -> DataFrame:
    """Class share per year over all plays and over the plays of the year's top-k artists, with the top-3 names."""
    by = df.groupBy(F.year(ts).alias("year"), artist).agg(F.count("*").alias("n"), F.count_if(is_class).alias("c"))
    top = top_k_per_group(by, ["year"], [F.desc("n"), F.col(artist)], k)
    lead = top.groupBy("year").agg(
        (F.sum("c") / F.sum("n")).alias("top_ratio"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", artist)))).alias("r"),
    )
    whole = by.groupBy("year").agg((F.sum("c") / F.sum("n")).alias("ratio"))
    return whole.join(lead, "year").select(
        "year", "ratio", "top_ratio", F.concat_ws(",", F.transform("r", lambda x: x[artist].cast("string"))).alias("top_names")
    )


def transition_counts(transitions: DataFrame, ts: str, k: int = 5) -> DataFrame:
    """Directions by count with their mean gap and their counts by hour (0 to 23), the k most common first."""
    hours = F.array(*[F.count_if(F.hour(ts) == h) for h in range(24)]).cast("array<string>")
    by = transitions.groupBy("from_label", "to_label").agg(
        F.count("*").alias("n"),
        F.avg("gap_minutes").alias("mean_gap"),
        F.mode(F.hour(ts), True).alias("modal_hour"),
        F.array_join(hours, ",").alias("by_hour"),
    )
    return by.orderBy(F.desc("n"), "from_label", "to_label").limit(k)


def overview(df: DataFrame, ts: str, artist: str, track: str, ms: str) -> DataFrame:
    span = F.datediff(F.max(ts), F.min(ts))
    return df.agg(
        F.count("*").alias("plays"),
        F.countDistinct(artist).alias("artists"),
        F.countDistinct(track).alias("tracks"),
        F.sum(C.to_hours(ms)).alias("hours"),
        span.alias("span_days"),
        (F.count("*") / F.greatest(span, F.lit(1))).alias("plays_per_day"),
    )


def activity_periods(df: DataFrame, ts: str) -> DataFrame:
    yearly = df.groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("plays"))
    mean = F.avg("plays").over(Window.partitionBy())  # one row per year
    label = F.when(F.col("plays") > 1.5 * mean, "High").when(F.col("plays") < 0.7 * mean, "Low").otherwise("Moderate")
    return yearly.withColumn("period_type", label)


def skip_rate(df: DataFrame, skipped: Column) -> DataFrame:
    return df.agg(F.avg(skipped.cast("double")).alias("skip_rate"))


def artist_deep_dive(df: DataFrame, artist: str, chosen: Sequence, ts: str, label: str) -> DataFrame:
    """Chosen artists: plays, peak hour, favourite day, label and plays by month as text."""
    mine = df.filter(F.col(artist).isin(*chosen))
    base = mine.groupBy(artist).agg(
        F.count("*").alias("plays"), F.mode(F.hour(ts), True).alias("peak_hour"), F.mode(F.weekday(ts), True).alias("peak_day"),
        F.mode(label, True).alias("modal_label"),
    )
    months = mine.groupBy(artist, C.month_period(ts).alias("m")).agg(F.count("*").alias("n"))
    lists = months.groupBy(artist).agg(F.sort_array(F.collect_list(F.struct("m", "n"))).alias("r"))
    text = F.concat_ws(",", F.transform("r", lambda x: F.concat(x["m"], F.lit(":"), x["n"].cast("string"))))
    return base.join(lists, artist).withColumn("months", text).drop("r")


def playlist_totals(df: DataFrame, item: str, group: str, added: str) -> DataFrame:
    """Overall rows for ``playlist_insights``: tracks, unique tracks, playlists, and the range of dates."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    facts = {
        "tracks": F.count("*"),
        "unique_tracks": F.countDistinct(item),
        "playlists": F.countDistinct(group),
        "first_added": day(F.min(added)),
        "last_added": day(F.max(added)),
    }
    row = df.agg(*[c.cast("string").alias(k) for k, c in facts.items()])
    pairs = ", ".join(f"'{k}', {k}" for k in facts)
    return row.selectExpr("'overall' AS kind", f"stack({len(facts)}, {pairs}) AS (subject, detail)")


def playlist_insights(profile: DataFrame, ext: DataFrame, multi: DataFrame, group: str, min_classes: int = 3, min_groups: int = 3) -> DataFrame:
    """One (kind, subject, detail) table from the profile, extreme and multi-group tables."""
    diverse = profile.filter(F.col("diversity") >= min_classes).select(
        F.lit("diverse").alias("kind"), F.col(group).alias("subject"), F.col("diversity").cast("string").alias("detail")
    )
    high = ext.select(F.lit("highest").alias("kind"), F.col("feature").alias("subject"), F.col("highest").alias("detail"))
    low = ext.select(F.lit("lowest").alias("kind"), F.col("feature").alias("subject"), F.col("lowest").alias("detail"))
    wide = multi.filter(F.col("n_groups") >= min_groups).select(
        F.lit("everywhere").alias("kind"), F.col("item").alias("subject"), F.col("n_groups").cast("string").alias("detail")
    )
    return diverse.unionByName(high).unionByName(low).unionByName(wide)


