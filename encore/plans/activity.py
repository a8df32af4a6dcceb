"""Queries of the grouped activity reports (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.operators import activity as A
from encore.operators import sessions as S
from encore.operators.scan import hot_cells
from encore.plans.base import query, sql
from encore.plans.scalar import BANDS_SQL, six

SKIP = "(ms_played < 30000 OR label = 'error')"
IS_CLICK = "avg(CASE WHEN label = 'click' THEN 1.0 ELSE 0.0 END)"
HOURS4 = 240


def skip():
    return C.skip_flag("ms_played", F.col("label") == "error")


def sess(t):
    return S.sessionize(t.plays, gap_minutes=HOURS4)


def day(*cols):
    return [F.date_format(c, "yyyy-MM-dd").alias(c) for c in cols]


def modal(src: str, keys: str, value: str, name: str) -> str:
    """View text: modal value per key, smallest on ties."""
    return f"""SELECT {keys}, {value} AS {name} FROM {src} WHERE {value} IS NOT NULL GROUP BY {keys}, {value}
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {value}) = 1"""


@query(
    "f1_session_stats",
    sql(
        f"""SELECT s.user_id, CAST(s.session_no AS BIGINT) AS session_no, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, count(*) AS plays,
        count(DISTINCT track_id) AS tracks, count(DISTINCT artist_id) AS artists, CAST(sum(ms_played) AS BIGINT) AS total_ms,
        CAST(sum(CASE WHEN {SKIP} THEN 1 ELSE 0 END) AS BIGINT) AS skips, min(m.modal_label) AS modal_label,
        round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE + 1e-9, 6) AS duration_min,
        round(avg(CASE WHEN {SKIP} THEN 1.0 ELSE 0.0 END), 6) AS skip_rate
        FROM sess s JOIN m ON s.user_id = m.user_id AND s.session_no = m.session_no GROUP BY 1, 2""",
        "sess",
        m=modal("sess", "user_id, session_no", "label", "modal_label"),
    ),
)
def _(t):
    out = A.session_stats(
        sess(t), ["user_id", "session_no"], "ts", "track_id", "artist_id", "ms_played", skip(), ["label"]
    )
    return out.select(
        "user_id", "session_no", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "plays", "tracks",
        "artists", "total_ms", "skips", "modal_label",
        *six(("duration_min", F.col("duration_min") + 1e-9), ("skip_rate", F.col("skip_rate"))),
    )


@query(
    "f2_session_intensity",
    sql(
        f"""SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS plays, round(span, 6) AS span_hours,
        round(count(*) / (span + 0.1::DOUBLE), 6) AS intensity, round({IS_CLICK}, 6) AS class_ratio, min(hour(ts)) AS min_hour,
        max(hour(ts)) AS max_hour, round(avg(hour(ts)), 6) AS mean_hour FROM sess JOIN (SELECT user_id, session_no,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS span FROM sess GROUP BY 1, 2) USING (user_id, session_no)
        GROUP BY user_id, session_no, span""",
        "sess",
    ),
)
def _(t):
    out = A.session_intensity(sess(t), ["user_id", "session_no"], "ts", F.col("label") == "click")
    return out.select(
        "user_id", "session_no", "plays", "min_hour", "max_hour",
        *six(*[(c, F.col(c)) for c in ("span_hours", "intensity", "class_ratio", "mean_hour")]),
    )


DIMS = {"hour": "hour(ts)", "dow": "isodow(ts) - 1", "month": "month(ts)", "label": "label", "artist_id": "artist_id", "user_id": "user_id"}


@query(
    "f3_activity_by_dimension",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{d}' AS dimension, CAST({x} AS VARCHAR) AS key, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS total_ms,
            round(avg(ms_played / 60000) + 1e-9, 6) AS avg_minutes FROM plays GROUP BY {x}"""
            for d, x in DIMS.items()
        ),
        "plays",
    ),
)
def _(t):
    tagged = t.plays.withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts"), "month": F.month("ts")})
    out = A.activity_by_dimension(tagged, list(DIMS), "ms_played")
    return out.withColumn("avg_minutes", F.round(F.col("avg_minutes") + 1e-9, 6))


@query(
    "f4_location_timeline",
    sql(
        """SELECT label, strftime(ts, '%Y-%m-%d') AS date, CAST(sum(ms_played) AS BIGINT) AS total_ms,
        count(DISTINCT track_id) AS tracks, count(DISTINCT artist_id) AS artists FROM plays GROUP BY 1, 2""",
        "plays",
    ),
)
def _(t):
    out = A.location_timeline(t.plays, "label", "ts", "ms_played", "track_id", "artist_id")
    return out.withColumn("date", F.col("date").cast("string"))


LABELS = ["click", "error", "purchase", "signup", "view"]


@query(
    "f5_daily_balance_pivot",
    sql(
        "SELECT strftime(ts, '%Y-%m-%d') AS date, "
        + ", ".join(f"count(*) FILTER (label = '{v}') AS \"{v}\"" for v in LABELS)
        + " FROM plays GROUP BY 1",
        "plays",
    ),
)
def _(t):
    dated = t.plays.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "label")
    return A.count_pivot(dated, "date", "label", LABELS)


@query(
    "f6_processing_stats",
    sql(
        """SELECT count(*) AS plays, count(DISTINCT track_id) AS tracks, count(DISTINCT artist_id) AS artists,
        count(DISTINCT user_id) AS users, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
        (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM plays)) AS listed,
        round(sum(ms_played) / 3600000, 4) AS total_hours,
        round(avg(least(ms_played / 210000, 1)), 6) AS mean_completion FROM plays""",
        "plays",
    ),
)
def _(t):
    out = A.processing_stats(t.plays, "ts", "ms_played", "track_id", "artist_id", "user_id", "label")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.withColumns(
        {
            "first_ts": F.date_format("first_ts", fmt),
            "last_ts": F.date_format("last_ts", fmt),
            "total_hours": F.round("total_hours", 4),
            "mean_completion": F.round("mean_completion", 6),
        }
    )


@query(
    "f7_class_statistics",
    sql(
        """SELECT count(*) AS total, count(*) FILTER (genres = 'ECONOMY') AS n_economy,
        round(count(*) FILTER (genres = 'ECONOMY') * 100.0 / count(*), 6) AS pct_economy,
        count(*) FILTER (genres = 'SMALL' AND energy > 0.5) AS n_small,
        round(count(*) FILTER (genres = 'SMALL' AND energy > 0.5) * 100.0 / count(*), 6) AS pct_small,
        count(*) FILTER (NOT (genres = 'ECONOMY' OR (genres = 'SMALL' AND energy > 0.5))) AS n_uncategorised,
        round(avg(valence), 6) AS mean_confidence, round(stddev_samp(valence), 6) AS std_confidence FROM tracks""",
        "tracks",
    ),
)
def _(t):
    flags = {"economy": F.col("genres") == "ECONOMY", "small": (F.col("genres") == "SMALL") & (F.col("energy") > 0.5)}
    out = A.class_statistics(t.tracks, flags, "valence")
    return out.withColumns({c: F.round(c, 6) for c in ("pct_economy", "pct_small", "mean_confidence", "std_confidence")})


@query("f8_mode_per_group", sql("SELECT * FROM m", "plays", m=modal("plays", "user_id", "track_id", "track_id")))
def _(t):
    from encore.operators.ranking import arg_max

    return arg_max(t.plays, "track_id", ["user_id"]).select("user_id", "track_id")


@query(
    "f9_daily_preferences",
    sql(
        """SELECT date, n_plays, tracks, artists, diversity, round(avg_value, 6) AS avg_value,
        round(coalesce(std_value, avg(std_value) OVER ()), 6) AS std_value, round(avg_energy, 6) AS avg_energy,
        round(coalesce(std_energy, avg(std_energy) OVER ()), 6) AS std_energy, round(tracks / n_plays, 6) AS exploration_rate
        FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n_plays, count(DISTINCT track_id) AS tracks,
        count(DISTINCT artist_id) AS artists, count(DISTINCT label) AS diversity, avg(value) AS avg_value,
        stddev_samp(value) AS std_value, avg(energy) AS avg_energy, stddev_samp(energy) AS std_energy
        FROM plays JOIN tracks USING (track_id) GROUP BY 1)""",
        "plays",
        "tracks",
    ),
)
def _(t):
    plays = t.plays.join(t.tracks, "track_id")
    out = A.daily_preferences(plays, "ts", "track_id", "artist_id", "label", ["value", "energy"])
    cols = ["avg_value", "std_value", "avg_energy", "std_energy", "exploration_rate"]
    return out.withColumns({"date": F.col("date").cast("string"), **{c: F.round(c, 6) for c in cols}})


@query(
    "f10_daily_signals",
    sql(
        """SELECT strftime(ts, '%Y-%m-%d') AS date, round(sum(ms_played / 60000), 4) AS total_minutes, count(*) AS n_plays,
        count(DISTINCT artist_id) AS artists, round(avg(energy), 6) AS avg_energy, round(avg(valence), 6) AS avg_valence
        FROM plays JOIN tracks USING (track_id) GROUP BY 1""",
        "plays",
        "tracks",
    ),
)
def _(t):
    out = A.daily_signals(t.plays.join(t.tracks, "track_id"), "ts", "ms_played", "artist_id", ["energy", "valence"])
    return out.select(
        F.col("date").cast("string").alias("date"), F.round("total_minutes", 4).alias("total_minutes"), "n_plays", "artists",
        *six(("avg_energy", F.col("avg_energy")), ("avg_valence", F.col("avg_valence"))),
    )


@query(
    "f11_daily_model_table",
    sql(
        """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS plays, round(avg(hour(ts)), 6) AS hour,
        round(avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS weekend,
        round(avg(sin(2 * pi() * hour(ts) / 24)), 6) AS hour_sin, round(avg(CASE WHEN label = 'click' THEN 1.0 ELSE 0.0 END), 6) AS click
        FROM plays GROUP BY 1""",
        "plays",
    ),
)
def _(t):
    features = {
        "hour": F.hour("ts"), "weekend": C.weekend_flag("ts"), "hour_sin": C.cyclical(F.hour("ts"), 24)[0], "click": F.col("label") == "click",
    }
    out = A.daily_model_table(t.plays, "ts", features)
    return out.select(F.col("date").cast("string").alias("date"), "plays", *six(*[(c, F.col(c)) for c in features]))


@query(
    "f12_monthly_activity",
    sql(
        """SELECT strftime(ts, '%Y-%m') AS period, count(*) AS plays, count(DISTINCT artist_id) AS artists,
        round(sum(quantity * 60000 / 60000), 4) AS minutes FROM baskets GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
        "baskets",
    ),
)
def _(t):
    rows = t.baskets.withColumn("ms", F.col("quantity") * 60000)
    return A.period_activity(rows, C.month_period("ts"), "artist_id", "ms", 12).withColumn("minutes", F.round("minutes", 4))


@query(
    "f13_yearly_overview",
    sql(
        """SELECT year(ts) AS year, count(*) AS plays, count(DISTINCT artist_id) AS artists, round(sum(quantity) / 60, 4) AS hours,
        round(count(*) / 365, 6) AS plays_per_day FROM baskets GROUP BY 1""",
        "baskets",
    ),
)
def _(t):
    out = A.yearly_overview(t.baskets.withColumn("ms", F.col("quantity") * 60000), "ts", "artist_id", "ms")
    return out.withColumns({"hours": F.round("hours", 4), "plays_per_day": F.round("plays_per_day", 6)})


@query(
    "f14_weekend_vs_weekday",
    sql(
        """SELECT isodow(ts) >= 6 AS is_weekend, count(*) AS plays, round(avg(ms_played / 60000), 6) AS avg_minutes,
        count(DISTINCT artist_id) AS artists, round((SELECT count(*) FILTER (isodow(ts) >= 6) / count(*) FILTER (isodow(ts) < 6)
        FROM plays), 6) AS weekend_boost FROM plays GROUP BY 1""",
        "plays",
    ),
)
def _(t):
    out = A.weekend_vs_weekday(t.plays, "ts", "artist_id", "ms_played")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_minutes", "weekend_boost")})


@query(
    "f15_hour_day_heatmap",
    sql(
        "SELECT isodow(ts) - 1 AS dow, "
        + ", ".join(f'count(*) FILTER (hour(ts) = {h}) AS "{h}"' for h in range(24))
        + " FROM plays GROUP BY 1",
        "plays",
    ),
)
def _(t):
    return A.hour_day_heatmap(t.plays, "ts")


@query(
    "f16_calendar_heatmap",
    sql(
        "SELECT month(date) AS month, "
        + ", ".join(f'round(coalesce(avg(n_plays) FILTER (day(date) = {d}), -1), 6) AS "{d}"' for d in range(1, 32))
        + " FROM daily GROUP BY 1",
        "daily",
    ),
)
def _(t):
    out = A.calendar_heatmap(t.history, "ts").na.fill(-1.0)
    return out.select("month", *[F.round(F.col(str(d)), 6).alias(str(d)) for d in range(1, 32)])


@query(
    "f17_season_totals",
    sql(
        """SELECT CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
        WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, count(*) AS plays FROM history GROUP BY 1""",
        "history",
    ),
)
def _(t):
    return t.history.groupBy(C.season(F.month("ts")).alias("season")).agg(F.count(F.lit(1)).alias("plays"))


SESS_STATS = """SELECT user_id, session_no, count(*) AS plays, sum(ms_played) / 60000 AS minutes FROM sess GROUP BY 1, 2"""


def sess_stats(t):
    return sess(t).groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("plays"), (F.sum("ms_played") / 60000).alias("minutes")
    )


@query(
    "f18_session_summary",
    sql(
        """SELECT count(*) AS sessions, round(avg(plays), 6) AS mean_tracks, round(avg(minutes), 6) AS mean_minutes,
        round(max(minutes), 6) AS max_minutes, round(stddev_samp(minutes), 6) AS std_minutes,
        round(quantile_cont(minutes, 0.25), 6) AS q25, round(quantile_cont(minutes, 0.5), 6) AS q50,
        round(quantile_cont(minutes, 0.75), 6) AS q75 FROM st""",
        "sess",
        st=SESS_STATS,
    ),
)
def _(t):
    from encore.operators.scan import exact_quantiles

    stats = sess_stats(t)
    q = exact_quantiles(stats, "minutes", [0.25, 0.5, 0.75]).select(F.struct("q_0", "q_1", "q_2")).scalar()
    out = A.session_summary(stats, "plays", "minutes").withColumn("q", q)
    names = ["mean_tracks", "mean_minutes", "max_minutes", "std_minutes"]
    return out.select(
        "sessions", *six(*[(c, F.col(c)) for c in names]),
        *six(("q25", F.col("q.q_0")), ("q50", F.col("q.q_1")), ("q75", F.col("q.q_2"))),
    )


@query(
    "f19_session_length_histogram",
    sql("SELECT plays AS tracks, count(*) AS sessions FROM st GROUP BY 1 ORDER BY sessions DESC, tracks LIMIT 10", "sess", st=SESS_STATS),
)
def _(t):
    return A.length_histogram(sess_stats(t), "plays")


@query(
    "f20_category_share",
    sql("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM plays), 6) AS share FROM plays GROUP BY 1", "plays"),
)
def _(t):
    return A.category_share(t.plays, "label").withColumn("share", F.round("share", 6))


def banded(t):
    return t.plays.withColumns(
        {"band": C.time_of_day_bands(F.hour("ts")), "is_work": C.work_hours_flag("ts"), "is_weekend": C.weekend_flag("ts")}
    )


BANDED = f"""SELECT *, {BANDS_SQL} AS band, isodow(ts) < 6 AND h >= 9 AND h < 17 AS is_work, isodow(ts) >= 6 AS is_weekend
    FROM (SELECT *, hour(ts) AS h FROM plays)"""


@query(
    "f21_row_normalised_contingency",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS context, CAST({c} AS VARCHAR) AS level, label, count(*) AS n,
            round(count(*) / sum(count(*)) OVER (PARTITION BY {c}), 6) AS share FROM banded GROUP BY {c}, label"""
            for c in ("band", "is_work", "is_weekend")
        ),
        "plays",
        banded=BANDED,
    ),
)
def _(t):
    from encore.operators.quality import unpivot

    contexts = ["band", "is_work", "is_weekend"]
    long = unpivot(banded(t), contexts, "context", "level", "string", ["label"])
    return A.category_share(long, "label", ["context", "level"]).withColumn("share", F.round("share", 6))


@query("f22_hourly_ratio", sql(f"SELECT hour(ts) AS hour, count(*) AS plays, round({IS_CLICK}, 6) AS class_ratio FROM plays GROUP BY 1", "plays"))
def _(t):
    return A.hourly_ratio(t.plays, "ts", F.col("label") == "click").withColumn("class_ratio", F.round("class_ratio", 6))


@query(
    "f23_artist_temporal_profile",
    sql(
        """SELECT artist_id, b.preferred_band, h.preferred_hour, l.modal_label, count(*) AS plays,
        round(avg(CASE WHEN is_weekend THEN 1.0 ELSE 0.0 END), 6) AS weekend_share,
        round(avg(CASE WHEN is_work THEN 1.0 ELSE 0.0 END), 6) AS work_share
        FROM banded JOIN top USING (artist_id) JOIN b USING (artist_id) JOIN h USING (artist_id) JOIN l USING (artist_id)
        GROUP BY ALL HAVING count(*) > 10""",
        "plays",
        banded=BANDED,
        top="SELECT artist_id FROM plays GROUP BY 1 ORDER BY count(*) DESC, artist_id LIMIT 50",
        b=modal("banded", "artist_id", "band", "preferred_band"),
        h=modal("banded", "artist_id", "h", "preferred_hour"),
        l=modal("banded", "artist_id", "label", "modal_label"),
    ),
)
def _(t):
    out = A.artist_temporal_profile(t.plays, "artist_id", "ts", "label", 50)
    return out.withColumns({c: F.round(c, 6) for c in ("weekend_share", "work_share")})


@query(
    "f24_artist_listening_patterns",
    sql(
        """SELECT artist_id, plays, peak_hour, peak_day, modal_label, round(hour_spread, 6) AS hour_spread,
        round(plays_per_session, 6) AS plays_per_session FROM top JOIN h USING (artist_id) JOIN d USING (artist_id)
        JOIN l USING (artist_id) JOIN (SELECT artist_id, stddev_samp(share) AS hour_spread FROM (SELECT artist_id, hour(ts),
        count(*) / sum(count(*)) OVER (PARTITION BY artist_id) AS share FROM plays GROUP BY artist_id, hour(ts)) GROUP BY 1)
        USING (artist_id) JOIN (SELECT artist_id, avg(n) AS plays_per_session FROM (SELECT artist_id, user_id, session_no,
        count(*) AS n FROM sess GROUP BY ALL) GROUP BY 1) USING (artist_id)""",
        "sess",
        top="SELECT artist_id, count(*) AS plays FROM plays GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        tagged="SELECT *, hour(ts) AS hh, isodow(ts) - 1 AS dd FROM plays",
        h=modal("tagged", "artist_id", "hh", "peak_hour"),
        d=modal("tagged", "artist_id", "dd", "peak_day"),
        l=modal("tagged", "artist_id", "label", "modal_label"),
    ),
)
def _(t):
    out = A.artist_listening_patterns(sess(t), "artist_id", "ts", ["user_id", "session_no"], "label", 20)
    return out.withColumns({c: F.round(c, 6) for c in ("hour_spread", "plays_per_session")})


@query(
    "f25_artist_dim",
    sql(
        """SELECT artist_id, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS total_ms, min(modal_location) AS modal_location
        FROM plays JOIN m USING (artist_id) GROUP BY 1""",
        "plays",
        m=modal("plays", "artist_id", "label", "modal_location"),
    ),
)
def _(t):
    return A.artist_dim(t.plays, "artist_id", "ms_played", "label")


@query(
    "f26_track_stats",
    sql(
        """SELECT track_id, track_name, artist_name, round(sum(ms_played / 60000), 4) AS total_minutes, count(*) AS play_count,
        min(modal_label) AS modal_label, round(avg(energy), 6) AS avg_energy, round(avg(valence), 6) AS avg_valence
        FROM plays JOIN tracks USING (track_id) JOIN m USING (track_id) GROUP BY 1, 2, 3""",
        "plays",
        "tracks",
        m=modal("plays", "track_id", "label", "modal_label"),
    ),
)
def _(t):
    keys = ["track_id", "track_name", "artist_name"]
    out = A.track_stats(t.plays.join(t.tracks, "track_id"), keys, "ms_played", "label", ["energy", "valence"])
    return out.withColumns(
        {"total_minutes": F.round("total_minutes", 4), "avg_energy": F.round("avg_energy", 6), "avg_valence": F.round("avg_valence", 6)}
    )


@query(
    "f27_user_features",
    sql(
        """SELECT *, round(plays / (span_days + 1), 6) AS plays_per_day, round(artists / plays, 6) AS artist_diversity FROM (
        SELECT user_id, round(avg(energy) + 1e-9, 6) AS mean_energy, round(avg(valence) + 1e-9, 6) AS mean_valence, count(DISTINCT artist_id) AS artists,
        count(DISTINCT track_id) AS tracks, count(DISTINCT label) AS classes, round(avg(hour(ts)), 6) AS mean_hour,
        strftime(min(ts), '%Y-%m-%d') AS first_ts, strftime(max(ts), '%Y-%m-%d') AS last_ts, count(*) AS plays,
        (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS span_days FROM plays JOIN tracks USING (track_id) GROUP BY 1)""",
        "plays",
        "tracks",
    ),
)
def _(t):
    out = A.user_features(t.plays.join(t.tracks, "track_id"), "user_id", "ts", "track_id", "artist_id", "label", ["energy", "valence"])
    rounded = ["mean_energy", "mean_valence", "mean_hour", "plays_per_day", "artist_diversity"]
    return out.withColumns(
        {**{c: F.round(F.col(c) + (1e-9 if c in rounded[:2] else 0.0), 6) for c in rounded}, **{c: F.date_format(c, "yyyy-MM-dd") for c in ("first_ts", "last_ts")}}
    )


@query(
    "f28_user_personality_features",
    sql(
        """SELECT user_id, round(avg(energy) + 1e-9, 6) AS energy_ratio, count(*) AS plays, count(DISTINCT artist_id) AS unique_artists,
        round(var_samp(hour(ts)), 6) AS hour_variance, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS listening_consistency,
        round(count(DISTINCT label) / 4, 6) AS cultural_diversity, round(min(top) / count(*), 6) AS artist_concentration
        FROM plays JOIN tracks USING (track_id) JOIN (SELECT user_id, max(n) AS top FROM (SELECT user_id, artist_id, count(*) AS n
        FROM plays GROUP BY 1, 2) GROUP BY 1) USING (user_id) GROUP BY 1 HAVING count(*) >= 10""",
        "plays",
        "tracks",
    ),
)
def _(t):
    out = A.user_personality_features(t.plays.join(t.tracks, "track_id"), "user_id", "ts", "artist_id", "label", ["energy"])
    cols = ["energy_ratio", "hour_variance", "listening_consistency", "cultural_diversity", "artist_concentration"]
    return out.withColumns({c: F.round(F.col(c) + (1e-9 if c == "energy_ratio" else 0.0), 6) for c in cols})


# Playlists: documents grouped by source, with derived audio features and dates.
PLAYLIST = """SELECT doc_id AS item, source AS playlist, lang AS culture, CAST(n_chars % 101 AS DOUBLE) / 100 AS valence,
    CAST(doc_id % 97 AS DOUBLE) / 96 AS energy, length(text) AS size, DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) AS added,
    text FROM documents"""


def playlist(t):
    return t.documents.select(
        F.col("doc_id").alias("item"),
        F.col("source").alias("playlist"),
        F.col("lang").alias("culture"),
        (F.col("n_chars") % 101 / 100).alias("valence"),
        (F.col("doc_id") % 97 / 96).alias("energy"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("added"),
        "text",
    )


PROFILE = """SELECT playlist, count(*) AS tracks, avg(energy) AS mean_energy, stddev_samp(energy) AS std_energy,
    avg(valence) AS mean_valence, stddev_samp(valence) AS std_valence FROM pl GROUP BY 1"""


@query(
    "f29_playlist_audio_profile",
    sql(
        """SELECT playlist, tracks, round(mean_energy, 6) AS mean_energy, round(std_energy, 6) AS std_energy,
        round(mean_valence, 6) AS mean_valence, round(std_valence, 6) AS std_valence FROM prof""",
        pl=PLAYLIST,
        prof=PROFILE,
    ),
)
def _(t):
    out = A.audio_profile(playlist(t), "playlist", ["energy", "valence"])
    return out.select("playlist", "tracks", *six(*[(c, F.col(c)) for c in out.columns if c[:4] in ("mean", "std_")]))


EXTREMES = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, (SELECT playlist FROM prof ORDER BY mean_{f} DESC, playlist LIMIT 1) AS highest,
    (SELECT playlist FROM prof ORDER BY mean_{f}, playlist LIMIT 1) AS lowest"""
    for f in ("energy", "valence")
)


@query("f30_playlist_extremes", sql(EXTREMES, pl=PLAYLIST, prof=PROFILE))
def _(t):
    return A.extremes(A.audio_profile(playlist(t), "playlist", ["energy", "valence"]), "playlist", ["energy", "valence"])


@query(
    "f31_category_profile",
    sql(
        """SELECT category, count(*) AS tracks, round(avg(energy), 6) AS mean_energy, count(DISTINCT culture) AS artists,
        strftime(min(added), '%Y-%m-%d') AS first_added, strftime(max(added), '%Y-%m-%d') AS last_added, min(g.n) AS genres
        FROM cat JOIN (SELECT category, count(DISTINCT g) AS n FROM (SELECT category, unnest(string_split(lower(text), ' ')) AS g
        FROM cat) GROUP BY 1) g USING (category) GROUP BY 1""",
        pl=PLAYLIST,
        cat="""SELECT *, CASE WHEN playlist IN ('src0', 'src1', 'src2') THEN 'mood' WHEN playlist IN ('src3', 'src4') THEN 'energy'
        ELSE 'other' END AS category FROM pl""",
    ),
)
def _(t):
    mapping = {"mood": ["src0", "src1", "src2"], "energy": ["src3", "src4"]}
    tagged = playlist(t).withColumn("category", C.name_to_category("playlist", mapping, "other"))
    out = A.category_profile(tagged, "category", ["energy"], "culture", F.split(F.lower("text"), " "), "added")
    return out.withColumns({"mean_energy": F.round("mean_energy", 6), **{c: F.col(c).cast("string") for c in ("first_added", "last_added")}})


CULTURES = ["en", "fr", "de", "es"]


@query(
    "f32_playlist_culture_profile",
    sql(
        "SELECT playlist, count(*) AS tracks, min(dominant) AS dominant, count(DISTINCT culture) AS diversity, "
        + ", ".join(f"round(avg(CASE WHEN culture = '{c}' THEN 1.0 ELSE 0.0 END), 6) AS share_{c}" for c in CULTURES)
        + " FROM pl JOIN m USING (playlist) GROUP BY 1",
        pl=PLAYLIST,
        m=modal("pl", "playlist", "culture", "dominant"),
    ),
)
def _(t):
    out = A.culture_profile(playlist(t), "playlist", "culture", CULTURES)
    return out.withColumns({f"share_{c}": F.round(f"share_{c}", 6) for c in CULTURES})


@query(
    "f33_playlist_timeline",
    sql(
        """SELECT playlist, strftime(min(added), '%Y-%m-%d') AS first_added, strftime(max(added), '%Y-%m-%d') AS last_added,
        CAST(max(added) - min(added) AS INTEGER) AS span_days, count(*) AS tracks,
        round(count(*) / greatest(max(added) - min(added), 1), 6) AS per_day FROM pl GROUP BY 1""",
        pl=PLAYLIST,
    ),
)
def _(t):
    out = A.timeline(playlist(t), "playlist", "added")
    return out.withColumns(
        {"per_day": F.round("per_day", 6), **{c: F.col(c).cast("string") for c in ("first_added", "last_added")}}
    )


MULTI = """SELECT item_id AS item, count(DISTINCT artist_id) AS n_groups, avg(quantity / 50) AS mean_valence,
    avg(value / 500000) AS mean_energy, min(ts) AS first_added FROM baskets GROUP BY 1 HAVING count(DISTINCT artist_id) >= 2"""


def multi(t):
    rows = t.baskets.select(
        F.col("item_id").alias("item"), "artist_id", (F.col("quantity") / 50).alias("valence"), (F.col("value") / 500000).alias("energy"), "ts"
    )
    return A.multi_group_items(rows, ["item"], "artist_id", "valence", "energy", "ts")


@query(
    "f34_multi_playlist_tracks",
    sql(
        """SELECT item, n_groups, round(mean_valence, 6) AS mean_valence, round(mean_energy + 1e-9, 6) AS mean_energy,
        strftime(first_added, '%Y-%m-%d') AS first_added,
        round(n_groups + (1 - abs(mean_valence - 0.5)) + (1 - abs(mean_energy - 0.5)), 6) AS score FROM multi""",
        "baskets",
        multi=MULTI,
    ),
)
def _(t):
    out = multi(t)
    return out.withColumns(
        {"first_added": F.date_format("first_added", "yyyy-MM-dd"), "mean_energy": F.round(F.col("mean_energy") + 1e-9, 6),
         **{c: F.round(c, 6) for c in ("mean_valence", "score")}}
    )


@query(
    "f35_artist_discovery",
    sql(
        """SELECT month, new_artists, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rn) AS first_names FROM (
        SELECT month, item_id, count(*) OVER (PARTITION BY month) AS new_artists,
        row_number() OVER (PARTITION BY month ORDER BY first_ts, item_id) AS rn FROM f) WHERE rn <= 5 GROUP BY 1, 2
        ORDER BY new_artists DESC, month LIMIT 5""",
        "baskets",
        f="SELECT item_id, min(ts) AS first_ts, strftime(min(ts), '%Y-%m') AS month FROM baskets GROUP BY 1",
    ),
)
def _(t):
    return A.artist_discovery(t.baskets, "item_id", "ts")


@query(
    "f36_monthly_class_share",
    sql(
        """SELECT strftime(ts, '%Y-%m') AS month, label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER
        (PARTITION BY strftime(ts, '%Y-%m')), 6) AS pct FROM history GROUP BY 1, 2""",
        "history",
    ),
)
def _(t):
    shares = A.category_share(t.history.withColumn("month", C.month_period("ts")), "label", ["month"])
    return shares.select("month", "label", "n", F.round(F.col("share") * 100, 6).alias("pct"))


@query(
    "f37_yearly_class_ratio",
    sql(
        """SELECT year, round(sum(c) / sum(n), 6) AS ratio, round(sum(c) FILTER (rn <= 10) / sum(n) FILTER (rn <= 10), 6) AS top_ratio,
        string_agg(CAST(artist_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3) AS top_names FROM (SELECT year(ts) AS year, artist_id,
        count(*) AS n, count(*) FILTER (label = '1-URGENT') AS c, row_number() OVER (PARTITION BY year(ts) ORDER BY count(*) DESC,
        artist_id) AS rn FROM baskets GROUP BY 1, 2) GROUP BY 1""",
        "baskets",
    ),
)
def _(t):
    out = A.yearly_class_ratio(t.baskets, "ts", "artist_id", F.col("label") == "1-URGENT")
    return out.withColumns({c: F.round(c, 6) for c in ("ratio", "top_ratio")})


@query(
    "f38_transition_counts",
    sql(
        f"""SELECT from_label, to_label, count(*) AS n, round(avg(gap), 6) AS mean_gap, min(m.modal_hour) AS modal_hour,
        array_to_string([{", ".join(f"count(*) FILTER (h = {i})" for i in range(24))}], ',') AS by_hour
        FROM tr JOIN m USING (from_label, to_label) GROUP BY 1, 2 ORDER BY n DESC, from_label, to_label LIMIT 5""",
        "plays",
        pairs="""SELECT user_id, ts, label AS to_label, lag(label) OVER w AS from_label, (epoch_us(ts) - epoch_us(lag(ts) OVER w))
        / 60000000 AS gap, hour(ts) AS h FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
        tr="SELECT * FROM pairs WHERE from_label <> to_label AND from_label <> 'error' AND to_label <> 'error'",
        m=modal("tr", "from_label, to_label", "h", "modal_hour"),
    ),
)
def _(t):
    moves = S.adjacent_transitions(t.plays, ["user_id"], "ts", "event_id", "label", hot_cells(), ["track_id"], "error")
    return A.transition_counts(moves, "ts").withColumn("mean_gap", F.round("mean_gap", 6))


@query(
    "f39_overview_metrics",
    sql(
        """SELECT count(*) AS plays, count(DISTINCT artist_id) AS artists, count(DISTINCT item_id) AS tracks, round(sum(quantity) / 60, 4) AS hours,
        datediff('day', min(ts), max(ts)) AS span_days, round(count(*) / datediff('day', min(ts), max(ts)), 6) AS plays_per_day FROM baskets""",
        "baskets",
    ),
)
def _(t):
    out = A.overview(t.baskets.withColumn("ms", F.col("quantity") * 60000), "ts", "artist_id", "item_id", "ms")
    return out.withColumns({"hours": F.round("hours", 4), "plays_per_day": F.round("plays_per_day", 6)})


@query(
    "f40_activity_periods",
    sql(
        """SELECT year, plays, CASE WHEN plays > 1.5 * avg(plays) OVER () THEN 'High' WHEN plays < 0.7 * avg(plays) OVER () THEN 'Low'
        ELSE 'Moderate' END AS period_type FROM (SELECT year(ts) AS year, count(*) AS plays FROM history GROUP BY 1)""",
        "history",
    ),
)
def _(t):
    return A.activity_periods(t.history, "ts")


@query(
    "f41_period_statistics",
    sql(
        """SELECT period, datediff('day', min(date), max(date)) AS duration_days, count(*) AS n, round(avg(n_plays), 6) AS mean_plays,
        round(avg(urgent_share), 6) AS mean_urgent_share, round(stddev_samp(urgent_share), 6) AS std_urgent_share
        FROM (SELECT *, year(date) * 4 + quarter(date) AS period FROM daily) GROUP BY 1""",
        "daily",
    ),
)
def _(t):
    from encore.operators.timeseries import period_statistics

    tagged = t.daily.withColumn("period", F.year("date") * 4 + F.quarter("date"))
    out = period_statistics(tagged, ["period"], "date", ["urgent_share"], "n_plays")
    return out.select(
        "period", "duration_days", "n", *six(*[(c, F.col(c)) for c in ("mean_plays", "mean_urgent_share", "std_urgent_share")])
    )


@query("f42_skip_rate", sql(f"SELECT round(avg(CASE WHEN {SKIP} THEN 1.0 ELSE 0.0 END), 6) AS skip_rate FROM plays", "plays"))
def _(t):
    return A.skip_rate(t.plays, skip()).withColumn("skip_rate", F.round("skip_rate", 6))


@query(
    "f43_artist_deep_dive",
    sql(
        """SELECT artist_id, count(*) AS plays, min(peak_hour) AS peak_hour, min(peak_day) AS peak_day, min(modal_label) AS modal_label,
        min(months) AS months FROM tagged JOIN h USING (artist_id) JOIN d USING (artist_id) JOIN l USING (artist_id) JOIN (
        SELECT artist_id, string_agg(m || ':' || n, ',' ORDER BY m) AS months FROM (SELECT artist_id, strftime(ts, '%Y-%m') AS m,
        count(*) AS n FROM tagged GROUP BY 1, 2) GROUP BY 1) USING (artist_id) GROUP BY 1""",
        "baskets",
        tagged="SELECT *, quarter(ts) AS hh, isodow(ts) - 1 AS dd FROM baskets WHERE artist_id IN (3, 14, 15)",
        h=modal("tagged", "artist_id", "hour(ts)", "peak_hour"),
        d=modal("tagged", "artist_id", "dd", "peak_day"),
        l=modal("tagged", "artist_id", "label", "modal_label"),
    ),
)
def _(t):
    return A.artist_deep_dive(t.baskets, "artist_id", [3, 14, 15], "ts", "label")


@query(
    "f44_playlist_insights",
    sql(
        """SELECT 'diverse' AS kind, playlist AS subject, CAST(count(DISTINCT culture) AS VARCHAR) AS detail FROM pl GROUP BY 2
        HAVING count(DISTINCT culture) >= 3 UNION ALL SELECT 'highest', feature, highest FROM ext UNION ALL
        SELECT 'lowest', feature, lowest FROM ext UNION ALL
        SELECT 'everywhere', CAST(item AS VARCHAR), CAST(n_groups AS VARCHAR) FROM multi WHERE n_groups >= 5 UNION ALL
        SELECT 'overall', 'tracks', CAST(count(*) AS VARCHAR) FROM pl UNION ALL
        SELECT 'overall', 'unique_tracks', CAST(count(DISTINCT item) AS VARCHAR) FROM pl UNION ALL
        SELECT 'overall', 'playlists', CAST(count(DISTINCT playlist) AS VARCHAR) FROM pl UNION ALL
        SELECT 'overall', 'first_added', strftime(min(added), '%Y-%m-%d') FROM pl UNION ALL
        SELECT 'overall', 'last_added', strftime(max(added), '%Y-%m-%d') FROM pl""",
        "baskets",
        pl=PLAYLIST,
        prof=PROFILE,
        ext=EXTREMES,
        multi=MULTI,
    ),
)
def _(t):
    rows = playlist(t)
    return A.playlist_insights(
        A.culture_profile(rows, "playlist", "culture", CULTURES),
        A.extremes(A.audio_profile(rows, "playlist", ["energy", "valence"]), "playlist", ["energy", "valence"]),
        multi(t).withColumn("item", F.col("item").cast("string")),
        "playlist",
        3,
        5,
    ).unionByName(A.playlist_totals(rows, "item", "playlist", "added"))
