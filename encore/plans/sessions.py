"""Queries of the window operators (G), top-k and sampling (H) and set operators (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.operators import ranking as K
from encore.operators import sessions as S
from encore.operators import timeseries as TS
from encore.operators.scan import HotCells, hot_cells, numbered
from encore.plans.activity import sess
from encore.plans.base import hash_sql, query, sql
from encore.plans.scalar import BANDS_SQL, six

W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(
    "g1_sessionize",
    sql(
        """SELECT event_id, user_id, CAST(session_no AS BIGINT) AS session_no, row_number() OVER (PARTITION BY user_id, session_no
        ORDER BY ts, event_id) AS session_position, is_new = 1 AS is_start FROM sess""",
        "sess",
    ),
)
def _(t):
    return sess(t).select("event_id", "user_id", "session_no", "session_position", "is_start")


@query(
    "g2_derive_users",
    sql(
        """SELECT event_id, 'user_' || lpad(CAST(n - 1 AS VARCHAR), 4, '0') AS derived_user FROM s JOIN (SELECT label,
        session_no, row_number() OVER (ORDER BY min(ts), arg_min(event_id, ts)) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 20)
        USING (label, session_no)""",
        "plays",
        s="""SELECT *, sum(is_new) OVER (PARTITION BY label ORDER BY ts, event_id) AS session_no FROM (SELECT *,
        CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS is_new
        FROM plays WINDOW w AS (PARTITION BY label ORDER BY ts, event_id))""",
    ),
)
def _(t):
    out = S.derive_users(t.plays, ["label"], "ts", "event_id", 240, 20)
    return out.select("event_id", "derived_user")


@query(
    "g3_position_in_group",
    sql(
        """SELECT event_id, row_number() OVER s AS session_position, round(row_number() OVER s / count(*) OVER
        (PARTITION BY user_id, session_no), 6) AS relative, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS user_position
        FROM sess WINDOW s AS (PARTITION BY user_id, session_no ORDER BY ts, event_id)""",
        "sess",
    ),
)
def _(t):
    sized = S.position_in_group(sess(t), ["user_id", "session_no"], "session_position")
    users = numbered(sized, ["user_id"], ["ts", "event_id"], hot_cells())
    return users.select(
        "event_id", "session_position", F.round("share_of_group", 6).alias("relative"), (F.col("row_no") - 1).alias("user_position")
    )


@query(
    "g4_time_since_last_same",
    sql(
        """SELECT event_id, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY track_id ORDER BY ts, event_id)))
        / 3600000000, -1), 6) AS hours_since_track, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY artist_id
        ORDER BY ts, event_id))) / 3600000000, -1), 6) AS hours_since_artist FROM plays""",
        "plays",
    ),
)
def _(t):
    out = S.time_since_last_same(t.plays, "track_id", "ts", "event_id", "a")
    out = S.time_since_last_same(out, "artist_id", "ts", "event_id", "b")
    return out.select(
        "event_id",
        *six(("hours_since_track", F.coalesce("a", F.lit(-1.0))), ("hours_since_artist", F.coalesce("b", F.lit(-1.0)))),
    )


@query(
    "g5_neighbor_labels",
    f"""SELECT conv_id, turn, coalesce(lag(role) OVER w, '-') AS prev_label, coalesce(lead(role) OVER w, '-') AS next_label,
    coalesce(role <> lag(role) OVER w, false) AS is_transition FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def _(t):
    out = S.neighbor_labels(t.conversations, ["conv_id"], ["turn"], "role", HotCells())
    return out.select(
        "conv_id", "turn", F.coalesce("prev_label", F.lit("-")).alias("prev_label"),
        F.coalesce("next_label", F.lit("-")).alias("next_label"), "is_transition",
    )


@query(
    "g6_transition_flag_global",
    sql(
        """SELECT event_id, coalesce(CAST(label <> lag(label) OVER (ORDER BY ts, event_id) AS INTEGER), 1) AS label_transition FROM plays""",
        "plays",
    ),
)
def _(t):
    out = S.transition_flag(t.plays, [], ["ts", "event_id"], "label", hot_cells())
    return out.select("event_id", "label_transition")


@query(
    "g7_rolling_mean_last_n",
    sql(
        f"""SELECT event_id, round(CASE WHEN count(v) OVER w = 10 THEN avg(v) OVER w ELSE -1 END + 1e-9, 6) AS rolling_mean FROM (SELECT *,
        CASE WHEN label <> 'error' OR value > 20 THEN value END AS v FROM plays)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
        "plays",
    ),
)
def _(t):
    rows = t.plays.withColumn("v", F.when((F.col("label") != "error") | (F.col("value") > 20), F.col("value")))
    out = S.rolling_mean_last_n(rows, ["user_id"], ["ts", "event_id"], "v", hot_cells())
    return out.select("event_id", F.round(F.coalesce("rolling_mean", F.lit(-1.0)) + 1e-9, 6).alias("rolling_mean"))


@query(
    "g8_rolling_daily_plays",
    sql(
        "SELECT event_id, "
        + ", ".join(
            f"round(d.m{n}, 6) AS mean_{n}d, round(coalesce(d.s{n}, -1), 6) AS std_{n}d" for n in (7, 14, 30)
        )
        + " FROM history JOIN d ON d.date = CAST(ts AS DATE)",
        "history",
        "daily",
        d="SELECT date, "
        + ", ".join(
            f"avg(n_plays) OVER w{n} AS m{n}, stddev_samp(n_plays) OVER w{n} AS s{n}" for n in (7, 14, 30)
        )
        + " FROM daily WINDOW "
        + ", ".join(
            f"w{n} AS (ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)" for n in (7, 14, 30)
        ),
    ),
)
def _(t):
    daily = S.rolling_daily_plays(t.history, "ts")
    out = t.history.withColumn("date", F.to_date("ts")).join(daily, "date")
    cols = [(f"mean_{n}d", F.col(f"mean_{n}d")) for n in (7, 14, 30)]
    cols += [(f"std_{n}d", F.coalesce(f"std_{n}d", F.lit(-1.0))) for n in (7, 14, 30)]
    return out.select("event_id", *six(*cols))


@query(
    "g9_rolling_distinct_entities",
    sql(
        """SELECT strftime(d.date, '%Y-%m-%d') AS date, d.user_id, count(DISTINCT p.artist_id) FILTER (p.date > d.date - 7) AS distinct_7d,
        count(DISTINCT p.artist_id) AS distinct_30d FROM (SELECT DISTINCT user_id, date FROM p) d JOIN p ON p.user_id = d.user_id
        AND p.date BETWEEN d.date - 29 AND d.date GROUP BY 1, 2""",
        "plays",
        p="SELECT user_id, artist_id, CAST(ts AS DATE) AS date FROM plays",
    ),
)
def _(t):
    week = S.rolling_distinct(t.plays, "ts", "artist_id", 7, ["user_id"])
    month = S.rolling_distinct(t.plays, "ts", "artist_id", 30, ["user_id"])
    return week.join(month, ["user_id", "date"]).withColumn("date", F.col("date").cast("string"))


@query(
    "g10_group_count_broadcast",
    sql(
        """SELECT event_id, count(*) OVER (PARTITION BY user_id, track_id) AS n, CAST(count(*) OVER (PARTITION BY user_id, track_id) = 1
        AS INTEGER) AS is_single FROM plays""",
        "plays",
    ),
)
def _(t):
    keyed = t.plays.withColumn("key", C.composite_key("user_id", "track_id"))
    return S.group_count(keyed, "key", "n", "is_single").select("event_id", "n", "is_single")


@query(
    "g11_user_totals_broadcast",
    sql(
        """SELECT event_id, user_tracks, user_artists, user_plays, round(value - mean_value + 1e-9, 6) AS popularity_deviation FROM plays JOIN (SELECT user_id,
        count(DISTINCT track_id) AS user_tracks, count(DISTINCT artist_id) AS user_artists, count(*) AS user_plays, avg(value) AS mean_value
        FROM plays GROUP BY 1) USING (user_id)""",
        "plays",
    ),
)
def _(t):
    out = S.user_totals(t.plays, "user_id", "track_id", "artist_id", "value")
    return out.select("event_id", "user_tracks", "user_artists", "user_plays", F.round(F.col("popularity_deviation") + 1e-9, 6).alias("popularity_deviation"))


@query(
    "g12_session_class_diversity",
    sql(
        """SELECT event_id, n_labels, round(mean_value + 1e-9, 6) AS mean_value FROM sess JOIN (SELECT user_id, session_no,
        count(DISTINCT label) AS n_labels, avg(value) AS mean_value FROM sess GROUP BY 1, 2) USING (user_id, session_no)""",
        "sess",
    ),
)
def _(t):
    from encore.operators.joins import attach_group_stats

    aggs = [F.countDistinct("label").alias("n_labels"), F.round(F.avg("value") + 1e-9, 6).alias("mean_value")]
    return attach_group_stats(sess(t), ["user_id", "session_no"], aggs).select("event_id", "n_labels", "mean_value")


MONTHLY_RATIO = """SELECT strftime(ts, '%Y-%m') AS month, avg(CASE WHEN label = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS ratio
    FROM history GROUP BY 1"""


def monthly_ratio(t):
    return t.history.groupBy(C.month_period("ts").alias("month")).agg(
        F.avg((F.col("label") == "1-URGENT").cast("double")).alias("ratio")
    )


@query(
    "g13_lag_features",
    sql(
        """SELECT month, round(ratio, 6) AS ratio, round(lag_1, 6) AS lag_1, round(lag_2, 6) AS lag_2, idx,
        round(sin(2 * pi() * idx / 12), 6) AS idx_sin, round(cos(2 * pi() * idx / 12), 6) AS idx_cos FROM (SELECT month, ratio,
        lag(ratio, 1) OVER w AS lag_1, lag(ratio, 2) OVER w AS lag_2, row_number() OVER w - 1 AS idx FROM m
        WINDOW w AS (ORDER BY month)) WHERE lag_2 IS NOT NULL""",
        "history",
        m=MONTHLY_RATIO,
    ),
)
def _(t):
    out = S.lag_features(monthly_ratio(t), "month", "ratio")
    return out.select("month", "idx", *six(*[(c, F.col(c)) for c in ("ratio", "lag_1", "lag_2", "idx_sin", "idx_cos")]))


@query(
    "g14_run_lengths",
    sql(
        """SELECT user_id, label, count(*) AS run_length, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, label ORDER BY ts,
        event_id) AS island FROM plays) GROUP BY user_id, label, island""",
        "plays",
    ),
)
def _(t):
    out = S.runs(t.plays, ["user_id"], ["ts", "event_id"], "label", hot_cells())
    return out.select("user_id", "label", "run_length", F.date_format("run_start", "yyyy-MM-dd HH:mm:ss").alias("run_start"))


TRANSITIONS = f"""SELECT user_id, event_id, ts, track_id, prev_label AS from_label, label AS to_label, prev_len AS run_length,
    least(prev_len / 10.0::DOUBLE, 1) * CASE WHEN prev_label IN ('click', 'view') AND label IN ('click', 'view') THEN 1 ELSE 0.5 END AS strength,
    {BANDS_SQL.replace("h >=", "hour(ts) >=").replace("h <", "hour(ts) <")} AS band FROM (SELECT *, lag(label) OVER w AS prev_label,
    lag(len) OVER w AS prev_len FROM (SELECT user_id, label, count(*) AS len, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id,
    arg_min(track_id, (ts, event_id)) AS track_id
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, label
    ORDER BY ts, event_id) AS island FROM plays WHERE label <> 'error') GROUP BY user_id, label, island)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE prev_len >= 3"""


def after_runs(t):
    return S.transitions_after_run(
        t.plays, ["user_id"], "ts", "event_id", "label", hot_cells(), ["click", "view"], 3, "error", ["track_id"]
    )


@query(
    "g15_class_transitions_after_run",
    sql("SELECT event_id, from_label, to_label, run_length, round(strength, 6) AS strength, band FROM tr", "plays", tr=TRANSITIONS),
)
def _(t):
    return after_runs(t).select("event_id", "from_label", "to_label", "run_length", F.round("strength", 6).alias("strength"), "band")


@query(
    "g16_adjacent_transitions",
    sql(
        """SELECT event_id, from_label, label AS to_label, round(gap + 1e-9, 6) AS gap_minutes, before AS track_id_before, track_id AS track_id_after
        FROM (SELECT *, lag(label) OVER w AS from_label, lag(track_id) OVER w AS before, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000 AS gap
        FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_label <> label AND from_label <> 'error' AND label <> 'error'""",
        "plays",
    ),
)
def _(t):
    out = S.adjacent_transitions(t.plays, ["user_id"], "ts", "event_id", "label", hot_cells(), ["track_id"], "error")
    return out.select(
        "event_id", "from_label", "to_label", F.round(F.col("gap_minutes") + 1e-9, 6).alias("gap_minutes"), "track_id_before", "track_id_after"
    )


@query(
    "g17_next_label_by_track",
    sql(f"SELECT event_id, track_id, coalesce(lead(label) OVER {W}, '-') AS next_label FROM plays", "plays"),
)
def _(t):
    out = S.next_label(t.plays, ["user_id"], ["ts", "event_id"], "label", hot_cells())
    return out.select("event_id", "track_id", F.coalesce("next_label", F.lit("-")).alias("next_label"))


SHIFT = """SELECT date, signal, x, row_number() OVER s - 1 AS idx, count(*) OVER (PARTITION BY signal) AS n,
    avg(x) OVER l AS lm, avg(x) OVER r AS rm, var_pop(x) OVER l AS lv, var_pop(x) OVER r AS rv FROM signals
    WINDOW s AS (PARTITION BY signal ORDER BY date), l AS (PARTITION BY signal ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY signal ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)"""


@query(
    "g18_two_sided_variance_shift",
    sql(
        """SELECT strftime(date, '%Y-%m-%d') AS date, signal, round(abs(lv - rv), 3) AS score FROM sh WHERE idx >= 7 AND idx < n - 7""",
        "signals",
        sh=SHIFT,
    ),
)
def _(t):
    out = TS.two_sided_shift(t.signals, ["signal"], "date", "x").filter("score IS NOT NULL")
    return out.select(F.col("date").cast("string").alias("date"), "signal", F.round("score", 3).alias("score"))


@query(
    "g19_two_sided_mean_var_shift",
    sql(
        """SELECT strftime(date, '%Y-%m-%d') AS date, signal, round(abs(lv - rv) + 2 * abs(lm - rm), 3) AS score FROM sh
        WHERE idx >= 7 AND idx < n - 7""",
        "signals",
        sh=SHIFT,
    ),
)
def _(t):
    out = TS.two_sided_shift(t.signals, ["signal"], "date", "x", 7, 1.0, 2.0).filter("score IS NOT NULL")
    return out.select(F.col("date").cast("string").alias("date"), "signal", F.round("score", 3).alias("score"))


VOL = """SELECT date, CASE WHEN row_number() OVER (ORDER BY date) > 7 THEN (stddev_samp(urgent_share) OVER f + stddev_samp(open_share) OVER f)
    / 2 ELSE 0 END AS volatility FROM daily WINDOW f AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


@query(
    "g20_rolling_volatility",
    sql("SELECT strftime(date, '%Y-%m-%d') AS date, round(volatility, 6) AS volatility FROM v", "daily", v=VOL),
)
def _(t):
    out = TS.rolling_volatility(t.daily, [], "date", ["urgent_share", "open_share"])
    return out.select(F.col("date").cast("string").alias("date"), F.round("volatility", 6).alias("volatility"))


@query(
    "g21_centred_smoothing",
    sql(
        "SELECT strftime(date, '%Y-%m-%d') AS date, signal, round(coalesce("
        + " + ".join(
            f"{w} / 143.0::DOUBLE * {'lag' if i < 6 else 'lead'}(x, {abs(i - 6)}) OVER s" for i, w in enumerate(TS.SMOOTH_WEIGHTS)
        )
        + """, x), 4) AS smoothed, round(avg(x) OVER (PARTITION BY signal ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), 4)
        AS moving_average FROM signals WINDOW s AS (PARTITION BY signal ORDER BY date)""",
        "signals",
    ),
)
def _(t):
    out = TS.centred_smoothing(t.signals, ["signal"], "date", "x")
    return out.select(
        F.col("date").cast("string").alias("date"), "signal", F.round("smoothed", 4).alias("smoothed"), F.round("moving_average", 4).alias("moving_average")
    )


EXTREMA = """SELECT signal, date, idx, x, CASE WHEN x > b AND x > a AND x >= hi THEN 'peak' WHEN x < b AND x < a AND x <= lo THEN 'valley' END AS kind
    FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM (SELECT * FROM (SELECT *, row_number() OVER w - 1 AS idx, lag(x) OVER w AS p
    FROM signals WINDOW w AS (PARTITION BY signal ORDER BY date)) WHERE p IS NULL OR p <> x) WINDOW w AS (PARTITION BY signal ORDER BY date))
    JOIN (SELECT signal, quantile_cont(x, 0.7) AS hi, quantile_cont(x, 0.3) AS lo FROM signals GROUP BY 1) USING (signal)"""


@query(
    "g22_local_extrema",
    sql(
        "SELECT signal, strftime(date, '%Y-%m-%d') AS date, kind FROM e WHERE kind IS NOT NULL",
        "signals",
        e=EXTREMA,
    ),
)
def _(t):
    out = TS.local_extrema(t.signals, ["signal"], "date", "x")
    return out.select("signal", F.col("date").cast("string").alias("date"), "kind")


@query(
    "g23_day_to_day_change",
    sql(
        """SELECT signal, round(avg(d) / greatest(stddev_samp(x), 0.001), 6) AS volatility FROM (SELECT signal, x,
        abs(x - lag(x) OVER (PARTITION BY signal ORDER BY date)) AS d FROM signals) GROUP BY 1""",
        "signals",
    ),
)
def _(t):
    return TS.day_to_day_change(t.signals, ["signal"], "date", "x").withColumn("volatility", F.round("volatility", 6))


EXPOSURE = """SELECT user_id, event_id, len(list_distinct(b)) / 5 AS diversity_before, len(list_distinct(a)) / 5 AS diversity_after FROM (
    SELECT user_id, event_id, track_id, count(*) OVER (PARTITION BY user_id) AS n, list(label) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
    list(label) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE track_id < 20 AND n >= 10 AND len(b) = 5 AND len(a) = 5"""


def exposures(t):
    return S.exposure_windows(t.plays, ["user_id"], ["ts", "event_id"], "label", F.col("track_id") < 20, hot_cells())


@query("g24_exposure_windows", sql(EXPOSURE, "plays"))
def _(t):
    return exposures(t).drop("ts")


@query(
    "g25_trailing_n_events",
    sql(
        """SELECT event_id, user_id FROM plays QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 1000""",
        "plays",
    ),
)
def _(t):
    return S.trailing_n_events(t.plays, ["user_id"], "ts", "event_id", 1000).select("event_id", "user_id")


@query(
    "g26_per_group_top_n",
    sql(
        """SELECT year(ts) AS year, item_id, count(*) AS n, row_number() OVER (PARTITION BY year(ts) ORDER BY count(*) DESC, item_id) AS rank
        FROM baskets GROUP BY 1, 2 QUALIFY rank <= 10""",
        "baskets",
    ),
)
def _(t):
    counts = t.baskets.groupBy(F.year("ts").alias("year"), "item_id").agg(F.count(F.lit(1)).alias("n"))
    return K.top_k_per_group(counts, ["year"], [F.desc("n"), F.col("item_id")], 10)


# ---- H -------------------------------------------------------------------


@query(
    "h1_top_k_entities",
    "SELECT l_partkey, count(*) AS plays, round(sum(l_quantity), 2) AS minutes FROM lineitem GROUP BY 1 ORDER BY plays DESC, l_partkey LIMIT 50",
)
def _(t):
    return K.top_k(t.lineitem, "l_partkey", 50, [F.round(F.sum("l_quantity"), 2).alias("minutes")])


@query(
    "h2_top_k_scores",
    """SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey,
    l_linenumber) AS rank FROM lineitem QUALIFY rank <= 10""",
)
def _(t):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    items = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return K.top_k_per_group(items, ["l_suppkey"], order, 10).drop("l_extendedprice")


POINTS = """SELECT *, abs(rm - lm) / greatest(sd, 0.001) AS magnitude, least(1, abs(rm - lm) / greatest(sd, 0.001) / 2) AS confidence FROM (
    SELECT *, avg(sc) OVER (PARTITION BY signal) + 2 * stddev_pop(sc) OVER (PARTITION BY signal) AS bound, stddev_pop(x) OVER (PARTITION BY signal) AS sd
    FROM (SELECT *, CASE WHEN idx >= 7 AND idx < n - 7 THEN abs(lv - rv) END AS sc FROM sh)) WHERE sc > bound"""


def points(t):
    return TS.change_points(t.signals, ["signal"], "date", "x")


@query(
    "h3_strongest_change_points",
    sql(
        """SELECT signal, strftime(date, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY signal ORDER BY magnitude DESC, date) AS rank
        FROM pts QUALIFY rank <= 5""",
        "signals",
        sh=SHIFT,
        pts=POINTS,
    ),
)
def _(t):
    out = TS.strongest(points(t), ["signal"], "date")
    return out.select("signal", F.col("date").cast("string").alias("date"), "rank")


def effective_items(t):
    from encore.operators.bridges import effective_transition_items

    return effective_transition_items(after_runs(t), "track_id")


EFFECTIVE = """SELECT track_id, count(*) AS n, avg(strength) AS mean_strength FROM tr GROUP BY 1 HAVING count(*) >= 2
    ORDER BY round(mean_strength, 9) DESC, track_id LIMIT 20"""


@query(
    "h4_effective_transition_items",
    sql(f"SELECT track_id, n, round(mean_strength, 6) AS mean_strength FROM ({EFFECTIVE})", "plays", tr=TRANSITIONS),
)
def _(t):
    return effective_items(t).withColumn("mean_strength", F.round("mean_strength", 6))


@query(
    "h5_arg_max",
    sql(
        """SELECT user_id, h AS hour, n FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM plays GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) = 1""",
        "plays",
    ),
)
def _(t):
    return K.arg_max(t.plays.withColumn("hour", F.hour("ts")), "hour", ["user_id"])


@query(
    "h6_peak_periods",
    sql(
        """SELECT month, n, round(n / (SELECT avg(n) FROM m), 6) AS intensity FROM m WHERE n >= (SELECT quantile_cont(n, 0.95) FROM m)""",
        "baskets",
        m="SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM baskets GROUP BY 1",
    ),
)
def _(t):
    months = t.baskets.groupBy(C.month_period("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return peak_periods(months).withColumn("intensity", F.round("intensity", 6))


def peak_periods(months, q: float = 0.95):
    """Months at or above the quantile with their plays over the mean month."""
    stats = months.select(F.struct(F.percentile("n", q).alias("q"), F.avg("n").alias("m"))).scalar()
    out = months.withColumn("s", stats).filter(F.col("n") >= F.col("s.q"))
    return out.withColumn("intensity", F.col("n") / F.col("s.m")).drop("s")


@query("h8_seeded_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 100")
def _(t):
    return K.seeded_sample(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@query(
    "h9_balanced_negative_sample",
    f"""WITH t AS (SELECT o_orderkey, o_totalprice, o_totalprice > 480000 AS positive FROM orders)
    SELECT * FROM t WHERE positive UNION ALL SELECT * FROM (SELECT * FROM t WHERE NOT positive
    ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT (SELECT 3 * count(*) FROM t WHERE positive))""",
)
def _(t):
    tagged = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 480000).alias("positive"))
    return K.balanced_negatives(tagged, "positive", ["o_orderkey"])


@query(
    "h10_global_sort_by_time",
    sql("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_no FROM history", "history"),
)
def _(t):
    return numbered(t.history, [], ["ts", "event_id"], hot_cells()).select("event_id", "row_no")


# ---- I -------------------------------------------------------------------


@query(
    "i1_union_by_name",
    """SELECT o_orderkey AS id, o_totalprice AS amount, 'order' AS kind, '-' AS segment FROM orders UNION ALL
    SELECT c_custkey, c_acctbal, '-', c_mktsegment FROM customer""",
)
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.lit("order").alias("kind"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment"))
    return K.union_by_name(a, b).na.fill("-", ["kind", "segment"])


@query(
    "i2_distinct_by_key",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey,
    l_linenumber, l_quantity) = 1""",
)
def _(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return K.distinct_by_key(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"])


@query(
    "i3_overlap_report",
    """SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS shared, count(*) FILTER (r IS NULL) AS left_only,
    count(*) FILTER (l IS NULL) AS right_only, round(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) * 100.0 / count(*), 6) AS overlap_pct
    FROM (SELECT DISTINCT l_partkey AS k, 1 AS l FROM lineitem) FULL JOIN (SELECT DISTINCT track_id AS k, 1 AS r FROM (
    SELECT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS track_id FROM events)) USING (k)""",
)
def _(t):
    heard = t.plays.select(F.col("track_id").cast("bigint").alias("l_partkey"))
    out = K.overlap_report(t.lineitem.select("l_partkey"), heard, "l_partkey")
    return out.withColumn("overlap_pct", F.round("overlap_pct", 6))


@query(
    "i4_union_of_candidates",
    """SELECT l_partkey FROM lineitem UNION SELECT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) FROM events""",
)
def _(t):
    heard = t.plays.select(F.col("track_id").cast("bigint").alias("l_partkey"))
    return K.union_of_candidates(t.lineitem.select("l_partkey"), heard)
