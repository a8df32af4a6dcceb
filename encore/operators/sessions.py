"""Gap sessions, neighbours, rolling frames and runs over play logs (G1-G17, G24-G26)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.columns import time_of_day_bands
from encore.operators.joins import attach_group_stats, membership
from encore.operators.ranking import top_k_per_group
from encore.operators.scan import Cells, drop_ghosts, haloed, hot_cells, neighbours, numbered, segment_rows, time_cell


def _cells(ts: str, seconds: int | None) -> Cells:
    return hot_cells() if seconds is None else time_cell(ts, seconds)


def sessionize(
    df: DataFrame,
    ts: str = "ts",
    keys: Sequence[str] = ("user_id",),
    row_id: str = "event_id",
    gap_minutes: float = 30,
    cell_seconds: int | None = None,
) -> DataFrame:
    """``session_no`` per key: a gap strictly longer than ``gap_minutes`` opens a session.

    Also adds ``session_position`` (1-based) and ``is_start``.
    """
    gap = int(gap_minutes * 60_000_000)
    opens = lambda prev, cur: F.unix_micros(cur[ts]) - F.unix_micros(prev[ts]) > gap
    out = segment_rows(df, keys, [ts, row_id], [ts], opens, _cells(ts, cell_seconds))
    return out.select(
        *df.columns, F.col("segment_no").alias("session_no"), F.col("position").alias("session_position"), "is_start"
    )


def derive_users(
    df: DataFrame, keys: Sequence[str], ts: str, row_id: str, gap_minutes: float = 240, min_rows: int = 20
) -> DataFrame:
    """Pseudo users: key plus session number, kept with enough rows, named ``user_0000`` by first appearance."""
    tagged = sessionize(df, ts, keys, row_id, gap_minutes)
    group = [*keys, "session_no"]
    users = tagged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(ts, row_id)).alias("__first")
    )
    kept = users.filter(F.col("n") >= min_rows).withColumns({"__t": F.col(f"__first.{ts}"), "__i": F.col(f"__first.{row_id}")})
    named = numbered(kept, [], ["__t", "__i"], hot_cells()).select(
        *group, F.format_string("user_%04d", F.col("row_no") - 1).alias("derived_user")
    )
    return tagged.join(named, group)


def position_in_group(df: DataFrame, group: Sequence[str], position: str, out: str = "share_of_group") -> DataFrame:
    """Position divided by the size of its group."""
    sized = attach_group_stats(df, group, [F.count(F.lit(1)).alias("group_size")])
    return sized.withColumn(out, F.col(position) / F.col("group_size"))


def time_since_last_same(df: DataFrame, item: str, ts: str, row_id: str, out: str, cell_seconds: int | None = None) -> DataFrame:
    """Hours since the previous play of the same item."""
    near = neighbours(df, [item], [ts, row_id], [ts], _cells(ts, cell_seconds))
    hours = (F.unix_micros(ts) - F.unix_micros(F.col("prev")[ts])) / 3_600_000_000
    return near.withColumn(out, hours).drop("prev")


def neighbor_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, cell: Cells) -> DataFrame:
    """Previous and next label per key and the change flag (false on the first row)."""
    near = neighbours(df, keys, order, [label], cell, forward=True)
    prev = F.col("prev")[label]
    return (
        near.withColumn("prev_label", prev)
        .withColumn("next_label", F.col("next")[label])
        .withColumn("is_transition", F.coalesce((F.col(label) != prev), F.lit(False)))
        .drop("prev", "next")
    )


def transition_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, cell: Cells) -> DataFrame:
    """1 where the label differs from the previous row's; the first row counts as a change."""
    near = neighbours(df, keys, order, [label], cell)
    return near.withColumn("label_transition", F.coalesce((F.col(label) != F.col("prev")[label]).cast("int"), F.lit(1))).drop("prev")


def rolling_mean_last_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, cell: Cells, n: int = 10, out: str = "rolling_mean"
) -> DataFrame:
    """Mean of the last n rows, null until n non-null values are in the frame."""
    ext, w = haloed(df, keys, order, [value], cell, before=n - 1)
    frame = w.rowsBetween(-(n - 1), 0)
    mean = F.when(F.count(value).over(frame) >= n, F.avg(value).over(frame))
    return drop_ghosts(ext.withColumn(out, mean))


def rolling_daily_plays(df: DataFrame, ts: str, days: Sequence[int] = (7, 14, 30), keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample std of the daily plays over trailing calendar days, per date.

    Runs on the daily counts, so a window holds at most one row per date.
    """
    daily = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("plays"))
    daily = daily.withColumn("__day", F.datediff("date", F.lit("1970-01-01")))
    for n in days:
        w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-(n - 1), 0)
        daily = daily.withColumns(
            {f"mean_{n}d": F.avg("plays").over(w), f"std_{n}d": F.stddev_samp("plays").over(w)}
        )
    return daily.drop("__day")


def rolling_distinct(df: DataFrame, ts: str, entity: str, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct entities over the trailing ``days`` calendar days, per date with plays.

    Each (entity, date) covers the dates up to its next appearance or the end of
    the frame, so every covered (date, entity) is produced exactly once and the
    distinct count becomes a plain count over dates. No set is ever collected.
    """
    seen = df.filter(F.col(entity).isNotNull()).select(*keys, entity, F.to_date(ts).alias("date")).distinct()
    w = Window.partitionBy(*keys, entity).orderBy("date")
    last = F.date_add("date", days - 1)
    until = F.least(last, F.coalesce(F.date_sub(F.lead("date").over(w), 1), last))
    cover = seen.withColumn("__until", until).select(*keys, F.explode(F.sequence("date", "__until")).alias("date"))
    counts = cover.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias(f"distinct_{days}d"))
    present = df.select(*keys, F.to_date(ts).alias("date")).distinct()
    return present.join(counts, [*keys, "date"])


def group_count(df: DataFrame, key: str, out: str, single: str) -> DataFrame:
    counted = attach_group_stats(df, [key], [F.count(F.lit(1)).alias(out)])
    return counted.withColumn(single, (F.col(out) == 1).cast("int"))


def user_totals(df: DataFrame, user: str, track: str, artist: str, popularity: str) -> DataFrame:
    """Distinct tracks and artists and plays of the user on each row, popularity minus the user's mean."""
    aggs = [
        F.countDistinct(track).alias("user_tracks"),
        F.countDistinct(artist).alias("user_artists"),
        F.count(F.lit(1)).alias("user_plays"),
        F.avg(popularity).alias("__mean"),
    ]
    out = attach_group_stats(df, [user], aggs)
    return out.withColumn("popularity_deviation", F.col(popularity) - F.col("__mean")).drop("__mean")


def lag_features(monthly: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Lag 1 and 2, 0-based row index and its yearly sine and cosine; rows without lags dropped.

    For monthly series: one row per month and key.
    """
    import math

    w = Window.partitionBy(*keys).orderBy(order)
    idx = F.row_number().over(w) - 1
    out = monthly.withColumns({"lag_1": F.lag(value, 1).over(w), "lag_2": F.lag(value, 2).over(w), "idx": idx})
    angle = F.col("idx") * (2 * math.pi / 12)
    return out.withColumns({"idx_sin": F.sin(angle), "idx_cos": F.cos(angle)}).dropna(subset=["lag_1", "lag_2", value])


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, cell: Cells) -> DataFrame:
    """Gaps-and-islands: one row per run of equal labels with its length."""
    seg = segment_rows(df, keys, order, [label], lambda p, c: ~p[label].eqNullSafe(c[label]), cell)
    return seg.groupBy(*keys, "segment_no").agg(
        F.first(label).alias(label), F.count(F.lit(1)).alias("run_length"), F.min(order[0]).alias("run_start")
    )


def transitions_after_run(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    row_id: str,
    label: str,
    cell: Cells,
    main: Sequence[str],
    min_run: int = 3,
    unknown: str = "unknown",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Label changes that follow a run of at least ``min_run`` known rows.

    The row before a change knows its position in its run, which is the run's
    length, so one segmented pass and one neighbour pass are enough.
    """
    known = df.filter(F.col(label).isNotNull() & (F.col(label) != unknown))
    seg = segment_rows(known, keys, [ts, row_id], [label], lambda p, c: p[label] != c[label], cell)
    seg = seg.withColumn("from_label", F.col("prev")[label]).drop("prev")
    near = neighbours(seg, keys, [ts, row_id], ["position"], cell)
    run = F.col("prev")["position"]
    both = F.col("from_label").isin(*main) & F.col(label).isin(*main)
    strength = F.least(run / 10, F.lit(1.0)) * F.when(both, 1.0).otherwise(0.5)
    return near.filter(F.col("is_start") & (run >= min_run)).select(
        *keys,
        row_id,
        ts,
        "from_label",
        F.col(label).alias("to_label"),
        run.alias("run_length"),
        strength.alias("strength"),
        time_of_day_bands(F.hour(ts)).alias("band"),
        *carry,
    )


def adjacent_transitions(
    df: DataFrame, keys: Sequence[str], ts: str, row_id: str, label: str, cell: Cells, carry: Sequence[str], unknown: str = "unknown"
) -> DataFrame:
    """Adjacent rows with different, known labels: gap in minutes, the carried columns on both sides."""
    near = neighbours(df, keys, [ts, row_id], [ts, label, *carry], cell)
    prev = F.col("prev")
    changed = (prev[label] != F.col(label)) & (prev[label] != unknown) & (F.col(label) != unknown)
    return near.filter(changed).select(
        *keys,
        row_id,
        ts,
        prev[label].alias("from_label"),
        F.col(label).alias("to_label"),
        ((F.unix_micros(ts) - F.unix_micros(prev[ts])) / 60_000_000).alias("gap_minutes"),
        *[prev[c].alias(f"{c}_before") for c in carry],
        *[F.col(c).alias(f"{c}_after") for c in carry],
    )


def next_label(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, cell: Cells) -> DataFrame:
    near = neighbours(df, keys, order, [label], cell, forward=True)
    return near.withColumn("next_label", F.col("next")[label]).drop("prev", "next")


def exposure_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, exposed: Column, cell: Cells, span: int = 5, min_rows: int = 10
) -> DataFrame:
    """Distinct-label share of the ``span`` rows before and after each exposure with full context."""
    ext, w = haloed(df.withColumn("__hit", exposed), keys, order, [label], cell, before=span, after=span)
    before = F.collect_list(label).over(w.rowsBetween(-span, -1))
    after = F.collect_list(label).over(w.rowsBetween(1, span))
    n_rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows)
    out = drop_ghosts(ext.withColumns({"__b": before, "__a": after})).filter(F.coalesce("__hit", F.lit(False)))
    out = membership(out, n_rows, keys).filter((F.size("__b") == span) & (F.size("__a") == span))
    share = lambda c: F.size(F.array_distinct(c)) / span
    return out.select(*keys, *order, share("__b").alias("diversity_before"), share("__a").alias("diversity_after"))


def trailing_n_events(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, n: int = 1000) -> DataFrame:
    """Last n rows by time, per key; at most n per key and task are shuffled."""
    order = [F.desc(ts), F.desc(row_id)]
    if not keys:
        return df.orderBy(*order).limit(n)
    return top_k_per_group(df, keys, order, n, "__rank").drop("__rank")
