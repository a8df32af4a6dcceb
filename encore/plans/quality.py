"""Queries of the filters and data-quality operators (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.operators import quality as Q
from encore.plans.base import query, sql
from encore.plans.scalar import six

FEATURES = ["energy", "valence", "danceability", "acousticness"]


def conditions():
    return Q.quality_conditions("ms_played", F.col("label") != "error", ["track_id", "artist_id"])


PASS = "ms_played >= 30000 AND ms_played <= 1800000 AND label <> 'error' AND track_id IS NOT NULL AND artist_id IS NOT NULL"


@query("d1_quality_filter", sql(f"SELECT event_id, user_id, track_id, ms_played FROM plays WHERE {PASS}", "plays"))
def _(t):
    return Q.quality_filter(t.plays, conditions()).select("event_id", "user_id", "track_id", "ms_played")


@query(
    "d2_quality_filter_counts",
    sql(
        """SELECT count(*) AS input, count(*) FILTER (ms_played >= 30000) AS long_enough,
        count(*) FILTER (ms_played >= 30000 AND ms_played <= 1800000) AS short_enough,
        count(*) FILTER (ms_played >= 30000 AND ms_played <= 1800000 AND label <> 'error') AS music,
        count(*) FILTER (ms_played >= 30000 AND ms_played <= 1800000 AND label <> 'error') AS has_track_id,
        count(*) FILTER (ms_played >= 30000 AND ms_played <= 1800000 AND label <> 'error') AS has_artist_id FROM plays""",
        "plays",
    ),
)
def _(t):
    return Q.quality_filter_counts(t.plays, conditions())


@query(
    "d3_min_support_filter",
    sql(
        """SELECT event_id, user_id, item_id FROM kept WHERE item_id IN
        (SELECT item_id FROM kept GROUP BY item_id HAVING count(*) >= 5)""",
        "baskets",
        kept="""SELECT * FROM baskets WHERE user_id IN (SELECT user_id FROM baskets GROUP BY user_id HAVING count(*) >= 40)""",
    ),
)
def _(t):
    return Q.min_support(t.baskets, "user_id", "item_id", 40, 5).select("event_id", "user_id", "item_id")


@query(
    "d4_time_slice",
    sql(
        "SELECT event_id, value FROM history WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-07-01'",
        "history",
    ),
)
def _(t):
    import datetime as dt

    part = Q.time_slice(t.orders, "o_orderdate", dt.datetime(1997, 1, 1), dt.datetime(1998, 7, 1))
    return part.select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("value"))


@query(
    "d5_dimension_filter",
    sql(
        """SELECT event_id, value FROM history WHERE year(ts) IN (1996, 1999) AND month(ts) IN (6, 7, 8, 12, 1, 2)
        AND label IN ('1-URGENT', '5-LOW')""",
        "history",
    ),
)
def _(t):
    tagged = t.history.withColumns({"year": F.year("ts"), "season": C.season(F.month("ts"))})
    allowed = {"year": [1996, 1999], "season": ["summer", "winter"], "label": ["1-URGENT", "5-LOW"]}
    return Q.dimension_filter(tagged, allowed).select("event_id", "value")


def per_feature(expr: str, alias: str, table: str = "tracks", cols=FEATURES) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {expr.format(c=c)} AS {alias} FROM {table}" for c in cols)


@query("d7_range_check", sql(per_feature("count(*) FILTER ({c} < 0.1 OR {c} > 0.8)", "n_outside"), "tracks"))
def _(t):
    return Q.range_check(t.tracks, FEATURES, 0.1, 0.8)


GAPPY = """SELECT track_id, CASE WHEN energy > 0.2 THEN energy END AS energy, CASE WHEN valence < 0.9 THEN valence END AS valence,
    CASE WHEN acousticness <> 0.5 THEN acousticness END AS acousticness, danceability FROM tracks"""


def gappy(t):
    """Tracks with holes, for the null-handling operators."""
    return t.tracks.select(
        "track_id",
        F.when(F.col("energy") > 0.2, F.col("energy")).alias("energy"),
        F.when(F.col("valence") < 0.9, F.col("valence")).alias("valence"),
        F.when(F.col("acousticness") != 0.5, F.col("acousticness")).alias("acousticness"),
        "danceability",
    )


@query(
    "d8_null_profile",
    sql(per_feature("count(*) FILTER ({c} IS NULL)", "n_null", "gappy", ["track_id", *FEATURES]), "tracks", gappy=GAPPY),
)
def _(t):
    return Q.null_profile(gappy(t), ["track_id", *FEATURES])


@query(
    "d9_feature_moments",
    sql(per_feature("round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6)", "std", "gappy"), "tracks", gappy=GAPPY),
)
def _(t):
    return Q.feature_moments(gappy(t), FEATURES).select("feature", *six(("mean", F.col("mean")), ("std", F.col("std"))))


@query(
    "d10_domain_check",
    sql("SELECT label, count(*) AS n FROM plays WHERE label NOT IN ('click', 'view', 'purchase') GROUP BY 1", "plays"),
)
def _(t):
    return Q.domain_check(t.plays, "label", ["click", "view", "purchase"])


@query(
    "d11_skew_check",
    """SELECT lang, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () > 0.6 AS skewed
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""",
)
def _(t):
    out = Q.skew_check(t.documents, "lang", 0.6)
    return out.select("lang", "n", F.round("share", 6).alias("share"), "skewed")


@query(
    "d12_timestamp_check",
    """SELECT count(*) FILTER (ts IS NULL) AS n_invalid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, datediff('day', min(ts), max(ts)) AS span_days,
    datediff('day', min(ts), max(ts)) < 30 AS short_span FROM (SELECT CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events)""",
)
def _(t):
    raw = F.when(F.col("event_type") != "error", F.col("ts").cast("string")).otherwise(F.lit("n/a"))
    out = Q.timestamp_check(t.events.select(raw.alias("raw_ts")), "raw_ts")
    day = "yyyy-MM-dd HH:mm:ss"
    return out.withColumns({c: F.date_format(c, day) for c in ("first_ts", "last_ts")})


@query(
    "d13_duplicate_events",
    sql(
        """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (n > 1) AS n_keys
        FROM (SELECT count(*) AS n FROM plays GROUP BY track_id, date_trunc('hour', ts))""",
        "plays",
    ),
)
def _(t):
    return Q.duplicate_events(t.plays.withColumn("slot", F.date_trunc("hour", "ts")), ["track_id", "slot"])


@query(
    "d14_coherence_check",
    """SELECT p_type, round(avg(own), 6) AS mean_own, avg(own) < 0.5 AS weak, count(*) FILTER (own < other) AS n_contradict
    FROM (SELECT p_type, CASE WHEN p_type = 'ECONOMY' THEN p_size / 50.0 ELSE (p_retailprice - 900) / 100 END AS own,
    CASE WHEN p_type = 'ECONOMY' THEN (p_retailprice - 900) / 100 ELSE p_size / 50.0 END AS other FROM part
    WHERE p_type IN ('ECONOMY', 'SMALL')) GROUP BY 1""",
)
def _(t):
    out = Q.coherence_check(t.tracks, "genres", {"ECONOMY": "energy", "SMALL": "valence"})
    return out.withColumnRenamed("genres", "p_type").withColumn("mean_own", F.round("mean_own", 6))


@query(
    "d15_data_profile",
    sql(
        """SELECT count(*) AS n_rows, 5 AS n_columns,
        'track_id:int,energy:double,valence:double,acousticness:double,danceability:double' AS columns,
        count(*) FILTER (energy IS NULL) + count(*) FILTER (valence IS NULL) + count(*) FILTER (acousticness IS NULL) AS n_nulls,
        min(track_id) AS first_ts, max(track_id) AS last_ts FROM gappy""",
        "tracks",
        gappy=GAPPY,
    ),
)
def _(t):
    return Q.data_profile(gappy(t), "track_id")


@query(
    "d16_readiness_gate",
    sql(
        """SELECT *, n_users >= 100 AND n_flagged >= 500 AND smallest_class >= 50 AS ready FROM (
        SELECT count(DISTINCT user_id) AS n_users, count(*) FILTER (value > 300) AS n_flagged,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM plays GROUP BY label)) AS smallest_class,
        0 AS n_missing_columns FROM plays)""",
        "plays",
    ),
)
def _(t):
    return Q.readiness_gate(
        t.plays, ["user_id", "ts", "track_id"], "user_id", "label", F.col("value") > 300, 100, 500, 50
    )


def filled(agg: str) -> str:
    return ", ".join(
        f"round(coalesce({c}, (SELECT {agg.format(c=c)} FROM gappy)), 6) AS {c}" for c in ("energy", "valence", "acousticness")
    )


@query(
    "d17_impute_median",
    sql(f"SELECT track_id, {filled('quantile_cont({c}, 0.5)')} FROM gappy", "tracks", gappy=GAPPY),
)
def _(t):
    cols = ["energy", "valence", "acousticness"]
    return Q.impute_median(gappy(t), cols).select("track_id", *six(*[(c, F.col(c)) for c in cols]))


@query("d18_impute_mean", sql(f"SELECT track_id, {filled('avg({c})')} FROM gappy", "tracks", gappy=GAPPY))
def _(t):
    cols = ["energy", "valence", "acousticness"]
    return Q.impute_mean(gappy(t), cols).select("track_id", *six(*[(c, F.col(c)) for c in cols]))


@query(
    "d19_fill_forward_backward",
    sql(
        """SELECT strftime(date, '%Y-%m-%d') AS date, signal, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY signal
        ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY signal
        ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS x FROM holes""",
        "signals",
        holes="SELECT date, signal, CASE WHEN day(date) % 4 <> 1 THEN x END AS x FROM signals",
    ),
)
def _(t):
    holes = t.signals.withColumn("x", F.when(F.dayofmonth("date") % 4 != 1, F.col("x")))
    out = Q.fill_forward_backward(holes, ["x"], "date", ["signal"])
    return out.select(F.col("date").cast("string").alias("date"), "signal", F.round("x", 4).alias("x"))
