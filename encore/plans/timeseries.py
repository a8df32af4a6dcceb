"""Queries of the daily time-series analytics (J) and the timeline (I5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.operators import joins as J
from encore.operators import ranking as K
from encore.operators import timeseries as TS
from encore.plans.base import query, sql
from encore.plans.scalar import six
from encore.plans.sessions import EXTREMA, POINTS, SHIFT, VOL, monthly_ratio, peak_periods, points

DATE = "strftime(date, '%Y-%m-%d') AS date"


def dated(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols or ("date",)})


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "j1_change_points",
    sql(
        f"SELECT signal, {DATE}, round(magnitude, 6) AS magnitude, round(confidence, 6) AS confidence FROM pts",
        "signals",
        sh=SHIFT,
        pts=POINTS,
    ),
)
def _(t):
    return dated(rounded(points(t), "magnitude", "confidence")).select("signal", "date", "magnitude", "confidence")


SPACED = {
    "cand": """SELECT signal, idx, date FROM (SELECT *, abs(lv - rv) + abs(lm - rm) AS sc, stddev_pop(x) OVER (PARTITION BY signal) AS sd FROM sh)
        WHERE idx >= 7 AND idx < n - 7 AND sc > 1.5 * sd""",
    "kept": """SELECT signal, min(idx) AS idx FROM cand GROUP BY 1 UNION ALL SELECT signal, (SELECT min(c.idx) FROM cand c
        WHERE c.signal = kept.signal AND c.idx >= kept.idx + 7) AS idx FROM kept WHERE idx IS NOT NULL""",
}


@query(
    "j2_change_points_spaced",
    sql(
        f"SELECT signal, idx, {DATE} FROM cand JOIN kept USING (signal, idx)",
        "signals",
        sh=SHIFT,
        **SPACED,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(t):
    return dated(TS.spaced_change_points(t.signals, ["signal"], "date", "x"))


CHAIN = """SELECT *, sum(is_new) OVER (ORDER BY date, signal) AS g FROM (SELECT *, CASE WHEN lag(date) OVER (ORDER BY date, signal) IS NULL
    OR date - lag(date) OVER (ORDER BY date, signal) > 3 THEN 1 ELSE 0 END AS is_new FROM pts)"""
TYPE_SQL = "CASE WHEN signal LIKE '%urgent%' THEN 'cultural_shift' ELSE 'preference_change' END"


@query(
    "j3_merge_change_points_chain",
    sql(
        f"""SELECT {DATE}, magnitude, confidence, change_type, n_points FROM (SELECT (SELECT date FROM c b WHERE b.g = a.g ORDER BY confidence DESC, date, signal LIMIT 1) AS date,
        round(avg(magnitude), 6) AS magnitude, round(avg(confidence), 6) AS confidence,
        CASE WHEN count(*) FILTER ({TYPE_SQL} = 'cultural_shift') >= count(*) FILTER ({TYPE_SQL} <> 'cultural_shift')
        THEN 'cultural_shift' ELSE 'preference_change' END AS change_type, count(*) AS n_points FROM c a GROUP BY g)""",
        "signals",
        sh=SHIFT,
        pts=POINTS,
        c=CHAIN,
    ),
)
def _(t):
    out = TS.merge_chain(points(t), [], "date", "signal", class_words=["urgent"]).drop("group_no")
    return dated(rounded(out, "magnitude", "confidence"))


def mixed_points(t):
    return TS.change_points(t.signals, ["signal"], "date", "x", 7, 1.0, 2.0, relative=False, min_rows=21)


def anchored(t):
    return TS.merge_anchor(mixed_points(t), [], "date", "signal")


MIXED = """SELECT *, abs(rm - lm) AS magnitude FROM (SELECT *, avg(sc) OVER (PARTITION BY signal) + 2 * stddev_pop(sc) OVER (PARTITION BY signal) AS bound
    FROM (SELECT *, CASE WHEN idx >= 7 AND idx < n - 7 THEN abs(lv - rv) + 2 * abs(lm - rm) END AS sc FROM sh)) WHERE sc > bound AND n >= 21"""
HEADS = """SELECT min(date) AS head FROM mixed UNION ALL SELECT (SELECT min(m.date) FROM mixed m WHERE m.date > heads.head + 3) FROM heads WHERE head IS NOT NULL"""
ANCHORED = """SELECT head, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals, avg(magnitude) AS magnitude, count(*) AS n_points,
    CASE WHEN count(*) > 1 THEN 'multi_signal_shift' ELSE 'single_signal_shift' END AS change_type FROM (SELECT m.*,
    (SELECT max(h.head) FROM heads h WHERE h.head <= m.date) AS head FROM mixed m) GROUP BY head"""


@query(
    "j4_merge_change_points_anchor",
    sql(
        "SELECT strftime(head, '%Y-%m-%d') AS head, signals, round(magnitude, 6) AS magnitude, n_points, change_type FROM anchored",
        "signals",
        sh=SHIFT,
        mixed=MIXED,
        heads=HEADS,
        anchored=ANCHORED,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(t):
    return dated(rounded(anchored(t), "magnitude"), "head")


TREND = """SELECT signal, regr_slope(x, d) AS slope, regr_intercept(x, d) AS intercept, regr_r2(x, d) AS r_squared, count(*) AS n
    FROM (SELECT signal, x, date - (SELECT min(date) FROM signals) AS d FROM signals) GROUP BY 1"""


@query(
    "j5_linear_trends",
    sql(
        """SELECT signal, round(slope, 9) AS slope, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared, n,
        CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM tr""",
        "signals",
        tr=TREND,
    ),
)
def _(t):
    out = TS.linear_trends(t.signals, ["signal"], "date", "x")
    out = rounded(out, "intercept", "r_squared").withColumn("slope", F.round("slope", 9))
    return out.select("signal", "slope", "intercept", "r_squared", "n", "direction")


@query(
    "j6_balance_trend",
    sql(
        """SELECT round(regr_slope(y, i), 9) AS slope, round(regr_r2(y, i), 6) AS r_squared, count(*) AS n FROM
        (SELECT urgent_share - open_share AS y, row_number() OVER (ORDER BY date) - 1 AS i FROM daily)""",
        "daily",
    ),
)
def _(t):
    out = TS.balance_trend(t.daily, "date", "urgent_share", "open_share")
    return out.select(F.round("slope", 9).alias("slope"), F.round("r_squared", 6).alias("r_squared"), "n")


@query(
    "j7_high_value_periods",
    sql(
        """SELECT signal, CAST(sum(len) AS BIGINT) AS n_high, round(avg(len), 6) AS mean_run, round(sum(len) / min(n), 6) AS frequency FROM (
        SELECT signal, n, count(*) AS len FROM (SELECT signal, n, hi, rn - row_number() OVER (PARTITION BY signal, hi ORDER BY date) AS island
        FROM (SELECT s.signal, date, x > q AS hi, n, row_number() OVER (PARTITION BY s.signal ORDER BY date) AS rn FROM signals s JOIN
        (SELECT signal, quantile_cont(x, 0.75) AS q, count(*) AS n FROM signals GROUP BY 1) USING (signal))) WHERE hi GROUP BY signal, n, island)
        GROUP BY 1""",
        "signals",
    ),
)
def _(t):
    return rounded(TS.high_value_periods(t.signals, ["signal"], "date", "x"), "mean_run", "frequency")


@query(
    "j8_weekday_month_profile",
    sql(
        """SELECT signal, 'weekday' AS part, CAST(isodow(date) - 1 AS INTEGER) AS level, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(*) AS n
        FROM signals GROUP BY 1, 3 UNION ALL SELECT signal, 'month', month(date), round(avg(x), 6), round(stddev_samp(x), 6), count(*)
        FROM signals GROUP BY 1, 3""",
        "signals",
    ),
)
def _(t):
    return rounded(TS.calendar_profile(t.signals, ["signal"], "date", "x"), "mean", "std")


ANOVA = """SELECT {k} AS signal, count(DISTINCT g) AS k, count(*) AS n_total, sum((gm - m) ** 2) / (count(DISTINCT g) - 1)
    / (sum((x - gm) ** 2) / (count(*) - count(DISTINCT g))) AS f FROM (SELECT *, avg(x) OVER (PARTITION BY {k}, g) AS gm,
    avg(x) OVER (PARTITION BY {k}) AS m FROM ({src})) GROUP BY 1"""


@query(
    "j9_weekday_anova",
    sql(
        "SELECT signal, k, n_total, round(f, 6) AS f_statistic FROM a",
        "signals",
        a=ANOVA.format(k="signal", src="SELECT signal, x, isodow(date) AS g FROM signals"),
    ),
)
def _(t):
    out = TS.anova(t.signals.withColumn("dow", F.weekday("date")), ["signal"], "dow", "x", 21)
    return rounded(out, "f_statistic").drop("p_value")


DECOMP = {
    "b0": """SELECT signal, date, x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY signal) AS n,
        avg(x) OVER (PARTITION BY signal ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ma0 FROM signals
        WINDOW w AS (PARTITION BY signal ORDER BY date)""",
    "b1": "SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN ma0 END AS ma FROM b0",
    "ends": """SELECT signal, regr_slope(ma, i) FILTER (i < 10) AS hs, regr_intercept(ma, i) FILTER (i < 10) AS hi,
        regr_slope(ma, i) FILTER (i >= n - 10) AS ts, regr_intercept(ma, i) FILTER (i >= n - 10) AS ti FROM b1 GROUP BY 1""",
    "b2": """SELECT b1.*, coalesce(ma, CASE WHEN i < 3 THEN hs * i + hi ELSE ts * i + ti END) AS trend FROM b1 JOIN ends USING (signal)""",
    "ph": "SELECT signal, i % 7 AS p, avg(x - trend) AS s FROM b2 GROUP BY 1, 2",
    "b3": """SELECT b2.*, s - (SELECT avg(s) FROM ph q WHERE q.signal = b2.signal) AS seasonal FROM b2 JOIN ph ON ph.signal = b2.signal AND ph.p = i % 7""",
}


@query(
    "j10_seasonal_decompose",
    sql(
        f"""SELECT signal, {DATE}, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(x - trend - seasonal, 6) AS residual FROM b3""",
        "signals",
        **DECOMP,
    ),
)
def _(t):
    out = TS.seasonal_decompose(t.signals, ["signal"], "date", "x").drop("x")
    return dated(rounded(out, "trend", "seasonal", "residual"))


@query(
    "j10_component_strength",
    sql(
        """SELECT signal, round(var_pop(trend) / var_pop(x), 6) AS trend_strength, round(var_pop(seasonal) / var_pop(x), 6) AS seasonal_strength
        FROM b3 GROUP BY 1""",
        "signals",
        **DECOMP,
    ),
)
def _(t):
    parts = TS.seasonal_decompose(t.signals, ["signal"], "date", "x")
    return rounded(TS.component_strength(parts, ["signal"], "x"), "trend_strength", "seasonal_strength")


@query(
    "j11_habit_strength",
    sql(
        """SELECT signal, round(c, 6) AS consistency, round(avg(c) OVER (), 6) AS overall FROM (SELECT signal, greatest(0, 1 - stddev_samp(x)
        / greatest(avg(x), CASE WHEN signal = 'n_plays' THEN 1 ELSE 0.001 END)) AS c FROM signals GROUP BY 1)""",
        "signals",
    ),
)
def _(t):
    return rounded(TS.habit_strength(t.signals, [], "signal", "x"), "consistency", "overall")


@query(
    "j12_exploration_cycles",
    sql(
        """SELECT signal, count(*) FILTER (kind = 'peak') AS n_peaks, count(*) FILTER (kind = 'valley') AS n_valleys,
        round(avg(g), 6) AS avg_cycle_length, round(greatest(0, 1 - stddev_pop(g) / greatest(avg(g), 1)), 6) AS rhythm_regularity FROM (
        SELECT *, CASE WHEN kind = 'peak' THEN idx - lag(idx) OVER (PARTITION BY signal, kind ORDER BY idx) END AS g FROM e
        WHERE kind IS NOT NULL) GROUP BY 1""",
        "signals",
        e=EXTREMA,
    ),
)
def _(t):
    return rounded(TS.exploration_cycles(t.signals, ["signal"], "date", "x"), "avg_cycle_length", "rhythm_regularity")


USER_YEARLY = """SELECT user_id, label, year, n / sum(n) OVER (PARTITION BY user_id, year) AS share FROM (SELECT user_id, year(ts) AS year, label, count(*) AS n
    FROM history GROUP BY 1, 2, 3)"""
YEARLY = """SELECT label, year, n / sum(n) OVER (PARTITION BY year) AS share FROM (SELECT year(ts) AS year, label, count(*) AS n
    FROM history GROUP BY 1, 2)"""


@query(
    "j13_year_over_year_shift",
    sql(
        """SELECT user_id, label, year, round(change, 6) AS change, CASE WHEN change > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM (
        SELECT *, share - lag(share) OVER (PARTITION BY user_id, label ORDER BY year) AS change FROM y) WHERE abs(change) > 0.15""",
        "history",
        y=USER_YEARLY,
    ),
)
def _(t):
    from encore.operators.activity import category_share

    yearly = category_share(t.history.withColumn("year", F.year("ts")), "label", ["user_id", "year"])
    out = TS.year_over_year_shift(yearly, "year", "share", ["user_id", "label"])
    return rounded(out, "change").select("user_id", "label", "year", "change", "direction")


CPS = "SELECT DISTINCT date AS p FROM pts"
SPANS = """SELECT * FROM (SELECT 'between' AS kind, p AS s, lead(p) OVER (ORDER BY p) AS e FROM cps UNION ALL SELECT 'before',
    (SELECT min(date) FROM daily), min(p) FROM cps UNION ALL SELECT 'after', max(p), (SELECT max(date) FROM daily) FROM cps)
    WHERE e - s >= 14"""
STABLE = """SELECT kind, s, e, count(*) AS n, avg(n_plays) AS mean_plays, avg(avg_value) AS m, stddev_samp(avg_value) AS sd FROM spans JOIN daily
    ON (kind IN ('before', 'between') AND date >= s AND date < e) OR (kind = 'after' AND date > s AND date <= e) GROUP BY 1, 2, 3"""


@query(
    "j14_stability_periods",
    sql(
        """SELECT kind, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date, n, round(mean_plays, 6) AS mean_plays,
        round(m, 6) AS mean_avg_value, round(sd, 6) AS std_avg_value FROM st WHERE kind <> 'between' OR sd / greatest(m, 0.001) <= 0.1""",
        "signals",
        sh=SHIFT,
        pts=POINTS,
        cps=CPS,
        spans=SPANS,
        st=STABLE,
    ),
)
def _(t):
    out = TS.stability_periods(t.daily, points(t), "date", ["avg_value"], "n_plays")
    return dated(rounded(out, "mean_plays", "mean_avg_value", "std_avg_value"), "start_date", "end_date")


@query(
    "j15_month_clustering",
    sql(
        """SELECT month, n, round(sum((n - e) ** 2 / e) OVER (), 6) AS chi_square, row_number() OVER (ORDER BY n DESC, month) AS rank FROM (
        SELECT CAST(m.month AS INTEGER) AS month, count(p.date) AS n, (SELECT count(*) FROM pts) / 12 AS e FROM generate_series(1, 12) m(month)
        LEFT JOIN pts p ON month(p.date) = m.month GROUP BY 1)""",
        "signals",
        sh=SHIFT,
        pts=POINTS,
    ),
)
def _(t):
    return rounded(TS.month_clustering(points(t), "date"), "chi_square").drop("p_value")


SHIFTING = ["urgent_share", "open_share", "avg_value"]
NAMES = {"urgent_share": "Urgent Share", "open_share": "Open Share", "avg_value": "Average Value"}


def _means(side: str, on: str) -> str:
    cols = ", ".join(f"avg({c}) AS {c}_{side}" for c in SHIFTING)
    return f"SELECT head, {cols} FROM strong JOIN daily ON {on} GROUP BY 1"


MAJOR = f"""SELECT head, rank, magnitude, {', '.join(f'CASE WHEN {c}_b <> 0 THEN ({c}_a - {c}_b) / {c}_b * 100 ELSE 0 END AS {c}_pct' for c in SHIFTING)}
    FROM strong JOIN ({_means('b', 'date >= head - 14 AND date < head')}) USING (head) JOIN ({_means('a', 'date > head AND date <= head + 14')}) USING (head)"""
SAID = ", ".join(
    f"CASE WHEN abs({c}_pct) > 10 THEN '{NAMES[c]} ' || CASE WHEN {c}_pct > 0 THEN 'increased' ELSE 'decreased' END || printf(' by %.1f%%', abs({c}_pct)) END" for c in SHIFTING
)


@query(
    "j16_major_shifts",
    sql(
        f"""SELECT strftime(head, '%Y-%m-%d') AS shift_date, CAST(rank AS INTEGER) AS rank, round(magnitude, 6) AS magnitude, CASE WHEN said = '' THEN 'Subtle preference shift on ' || strftime(head, '%Y-%m-%d')
        ELSE 'On ' || strftime(head, '%Y-%m-%d') || ': ' || said END AS description,
        CASE WHEN abs(urgent_share_pct) > abs(open_share_pct) AND abs(urgent_share_pct) > 15 THEN CASE WHEN urgent_share_pct > 0 THEN 'cultural_shift' ELSE 'cultural_shift_away' END
        WHEN abs(open_share_pct) > 15 THEN CASE WHEN open_share_pct > 0 THEN 'western_cultural_shift' ELSE 'western_shift_away' END
        WHEN abs(avg_value_pct) > 15 THEN CASE WHEN avg_value_pct > 0 THEN 'energy_shift' ELSE 'mellowing_shift' END ELSE 'general_preference_shift' END AS shift_type,
        {', '.join(f'round({c}_pct, 6) AS {c}_pct' for c in SHIFTING)} FROM (SELECT *, concat_ws('; ', {SAID}) AS said FROM major)""",
        "signals",
        sh=SHIFT,
        mixed=MIXED,
        heads=HEADS,
        anchored=ANCHORED,
        strong="""SELECT head, magnitude, row_number() OVER (ORDER BY magnitude DESC, head) AS rank FROM anchored WHERE magnitude > (SELECT quantile_cont(magnitude, 0.5) FROM anchored)
        QUALIFY rank <= 5""",
        major=MAJOR,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(t):
    merged = anchored(t).withColumnRenamed("head", "date")
    out = TS.major_shifts(t.daily, merged, "date", SHIFTING)
    return dated(rounded(out, "magnitude", *[f"{s}_pct" for s in SHIFTING]), "shift_date").select(
        "shift_date", "rank", "magnitude", "description", "shift_type", *[f"{s}_pct" for s in SHIFTING]
    )


# Share of customers who come back within the horizon, per segment: a real curve over days ahead.
CURVE = """SELECT s.series, h.days_ahead, avg(CASE WHEN s.gap <= h.days_ahead THEN 0.0 ELSE 1.0 END) AS accuracy FROM (
    SELECT label AS series, date_diff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM history) s,
    (SELECT unnest([1, 7, 14, 30, 60, 90, 180, 360]) AS days_ahead) h WHERE gap IS NOT NULL GROUP BY 1, 2"""
HORIZONS = [1, 7, 14, 30, 60, 90, 180, 360]


def curve(t):
    from encore.operators.scan import hot_cells, neighbours

    near = neighbours(t.history, ["user_id"], ["ts", "event_id"], ["ts"], hot_cells()).filter("prev IS NOT NULL")
    gaps = near.select(F.col("label").alias("series"), F.datediff("ts", F.col("prev.ts")).alias("gap"))
    rows = gaps.groupBy("series").agg(
        *[F.avg((F.col("gap") > h).cast("double")).alias(f"h{h}") for h in HORIZONS]
    )
    pairs = ", ".join(f"{h}, h{h}" for h in HORIZONS)
    return rows.selectExpr("series", f"stack({len(HORIZONS)}, {pairs}) AS (days_ahead, accuracy)")


FITS = """SELECT series, 'exponential' AS model, exp(regr_intercept(ly, x)) AS a, -regr_slope(ly, x) AS b, regr_r2(ly, x) AS r2 FROM v GROUP BY 1
    UNION ALL SELECT series, 'power_law', exp(regr_intercept(ly, lx)), -regr_slope(ly, lx), regr_r2(ly, lx) FROM v GROUP BY 1
    UNION ALL SELECT series, 'linear', regr_intercept(y, x), regr_slope(y, x), regr_r2(y, x) FROM v GROUP BY 1"""
DECAY = {
    "c": CURVE,
    "v": """SELECT series, CAST(days_ahead AS DOUBLE) AS x, accuracy AS y, ln(greatest(days_ahead, 0.1)) AS lx, ln(greatest(accuracy, 0.001)) AS ly FROM c""",
    "fits": FITS,
    "scored": """SELECT series, model, a, b, r2, sqrt(avg((y - CASE model WHEN 'exponential' THEN a * exp(-b * x) WHEN 'power_law'
        THEN a * pow(greatest(x, 0.1), -b) ELSE a + b * x END) ** 2)) AS rmse FROM fits JOIN v USING (series) GROUP BY 1, 2, 3, 4, 5""",
}


@query(
    "j17_decay_fit",
    sql(
        """SELECT series, model, round(a, 6) AS a, round(b, 6) AS b, round(r2, 6) AS r_squared, round(rmse, 6) AS rmse,
        row_number() OVER (PARTITION BY series ORDER BY rmse) = 1 AS is_best FROM scored""",
        "history",
        **DECAY,
    ),
)
def _(t):
    return rounded(TS.decay_fit(curve(t), ["series"], "days_ahead", "accuracy"), "a", "b", "r_squared", "rmse")


@query(
    "j17_decay_predictions",
    sql(
        """SELECT series, model, h AS horizon, round(least(1, greatest(0.1, CASE model WHEN 'exponential' THEN a * exp(-b * h) WHEN 'power_law'
        THEN a * pow(greatest(h, 0.1), -b) ELSE a + b * h END)), 6) AS predicted FROM (SELECT * FROM scored
        QUALIFY row_number() OVER (PARTITION BY series ORDER BY rmse) = 1), (SELECT unnest([1, 30, 90]) AS h)""",
        "history",
        **DECAY,
    ),
)
def _(t):
    fits = TS.decay_fit(curve(t), ["series"], "days_ahead", "accuracy")
    return rounded(TS.decay_predictions(fits, [1, 30, 90]), "predicted").select("series", "model", "horizon", "predicted")


@query(
    "j18_decay_from_volatility",
    sql(
        """SELECT h AS days_ahead, round(avg(volatility), 6) AS avg_volatility, round(0.95 * exp(-(0.02 + 0.1 * avg(volatility)) * h), 6)
        AS predicted_accuracy FROM v, (SELECT unnest([1, 7, 14, 30, 60, 90]) AS h) GROUP BY h""",
        "daily",
        v=VOL,
    ),
)
def _(t):
    out = TS.decay_from_volatility(t.daily, "date", ["urgent_share", "open_share"])
    return rounded(out, "avg_volatility", "predicted_accuracy")


@query(
    "j19_period_stability",
    sql(
        """SELECT a.i AS period, round(corr(a.x, b.x), 6) AS r, count(*) AS n_common FROM v a JOIN v b ON a.item_id = b.item_id AND a.i + 1 = b.i
        GROUP BY 1 HAVING count(*) >= 10""",
        "baskets",
        m="SELECT strftime(ts, '%Y-%m') AS month, item_id, sum(quantity) AS x FROM baskets GROUP BY 1, 2",
        v="""SELECT m.*, i FROM m JOIN (SELECT month, row_number() OVER (ORDER BY month) AS i FROM m GROUP BY 1 HAVING count(*) >= 50)
        USING (month)""",
    ),
)
def _(t):
    monthly = t.baskets.groupBy(C.month_period("ts").alias("month"), "item_id").agg(F.sum("quantity").alias("x"))
    return rounded(TS.period_stability(monthly, "month", "item_id", "x"), "r")


@query(
    "j20_recent_context_label",
    sql(
        """SELECT as_of, n AS n_recent, CASE WHEN n = 0 THEN 'stable' WHEN a > 0 THEN 'urgent_share_shift' WHEN b > 0 THEN 'open_share_shift'
        WHEN c > 0 THEN 'energy_shift' ELSE 'preference_exploration' END AS context FROM (SELECT as_of, count(date) AS n,
        count(*) FILTER (signal = 'urgent_share') AS a, count(*) FILTER (signal = 'open_share') AS b, count(*) FILTER (signal LIKE '%value%') AS c
        FROM (SELECT unnest(['1996-06-30', '1998-03-31', '2001-07-31']) AS as_of) LEFT JOIN pts ON
        CAST(as_of AS DATE) - date BETWEEN 0 AND 59 GROUP BY 1)""",
        "signals",
        sh=SHIFT,
        pts=POINTS,
    ),
)
def _(t):
    rows = [
        TS.recent_context_label(
            points(t), "date", "signal", F.lit(d).cast("date"), "urgent_share", "open_share", "value"
        ).withColumn("as_of", F.lit(d))
        for d in ("1996-06-30", "1998-03-31", "2001-07-31")
    ]
    return K.union_by_name(*rows)


@query(
    "i5_timeline_events",
    sql(
        """SELECT '2-month' AS kind, month AS date, CAST(n AS VARCHAR) AS detail FROM m UNION ALL
        SELECT '1-peak', month, CAST(n AS VARCHAR) FROM m WHERE n >= (SELECT quantile_cont(n, 0.95) FROM m) UNION ALL
        SELECT '3-shift', CAST(year AS VARCHAR), label FROM (SELECT *, share - lag(share) OVER (PARTITION BY label ORDER BY year) AS change FROM y)
        WHERE abs(change) > 0.15 UNION ALL
        SELECT '4-new', CAST(year AS VARCHAR), CAST(item_id AS VARCHAR) FROM rk a WHERE rn <= 5 AND year > (SELECT min(year) FROM rk)
        AND NOT EXISTS (SELECT 1 FROM rk b WHERE b.item_id = a.item_id AND b.year = a.year - 1 AND b.rn <= 10)""",
        "history",
        "baskets",
        m="SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM history GROUP BY 1",
        y=YEARLY,
        rk="""SELECT year(ts) AS year, item_id, row_number() OVER (PARTITION BY year(ts) ORDER BY count(*) DESC, item_id) AS rn
        FROM baskets GROUP BY 1, 2""",
    ),
)
def _(t):
    from encore.operators.activity import category_share
    from encore.plans.base import QUERIES

    months = t.history.groupBy(C.month_period("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    yearly = category_share(t.history.withColumn("year", F.year("ts")), "label", ["year"])
    moves = TS.year_over_year_shift(yearly, "year", "share", ["label"])
    fresh = QUERIES["e16_new_top_k_vs_previous_year"](t)
    text = lambda c: F.col(c).cast("string")
    return timeline_events(
        ("1-peak", peak_periods(months), text("month"), text("n")),
        ("2-month", months, text("month"), text("n")),
        ("3-shift", moves, text("year"), text("label")),
        ("4-new", fresh, text("year"), text("item_id")),
    )


def timeline_events(*parts):
    """One (kind, date, detail) table from several event tables."""
    return K.union_by_name(*[df.select(F.lit(kind).alias("kind"), d.alias("date"), x.alias("detail")) for kind, df, d, x in parts])
