"""Queries of features, latent factors and supervised models (L, H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.operators import latent as L
from encore.operators import models as ML
from encore.operators import sessions as S
from encore.plans.base import query, sql
from encore.plans.recommend import FEATURES, bridge_features
from encore.plans.scalar import BANDS_SQL
from encore.plans.sessions import EFFECTIVE, TRANSITIONS, effective_items, monthly_ratio
from encore.plans.timeseries import rounded
from encore.session import checkpointed

AUDIO = [*FEATURES, "tempo"]


@query(
    "l1_standardise",
    sql(
        "SELECT track_id, "
        + ", ".join(f"round(({c} - (SELECT avg({c}) FROM tracks)) / (SELECT stddev_pop({c}) FROM tracks), 6) AS {c}" for c in AUDIO)
        + " FROM tracks",
        "tracks",
    ),
)
def _(t):
    return rounded(L.standardise(t.tracks.select("track_id", *AUDIO)), *AUDIO)


@query(
    "l2_feature_table",
    sql(
        """SELECT event_id, is_new_s AS is_start, CAST(row_number() OVER (PARTITION BY user_id, sn ORDER BY ts, event_id) AS BIGINT) AS session_position,
        count(*) OVER (PARTITION BY user_id, sn) AS session_plays, round(energy * valence, 6) AS energy_valence,
        round(CASE WHEN hour(ts) BETWEEN 6 AND 12 THEN value ELSE 0 END, 6) AS morning_score,
        coalesce(CAST(label <> lag(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER), 1) AS label_transition,
        count(*) OVER (PARTITION BY track_id) AS track_plays, count(*) OVER (PARTITION BY user_id) AS user_plays FROM (SELECT *, is_new = 1 AS is_new_s,
        sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sn FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w)
        > 1800000000 THEN 1 ELSE 0 END AS is_new FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) JOIN tracks USING (track_id)""",
        "plays",
        "tracks",
    ),
)
def _(t):
    dim = t.tracks.drop("track_name", "artist_name", "genres", "culture")
    out = L.feature_table(t.plays, dim, "ts", "user_id", "track_id", "artist_id", "label", "event_id", ["value"])
    return rounded(
        out.select("event_id", "is_start", "session_position", "session_plays", "energy_valence", "morning_score", "label_transition", "track_plays", "user_plays"),
        "energy_valence",
        "morning_score",
    )


@query("l3_audio_clusters")
def _(t):
    out = L.audio_clusters(t.tracks, AUDIO)
    return out.groupBy("audio_cluster").agg(F.count("*").alias("tracks"), *[F.round(F.avg(c), 6).alias(c) for c in AUDIO])


MATRIX = """SELECT user_id, item_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx,
    ln(1 + sum(quantity)) AS rating FROM kept WHERE item_id IN (SELECT item_id FROM kept GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2"""
KEPT = "SELECT * FROM baskets WHERE user_id IN (SELECT user_id FROM baskets GROUP BY 1 HAVING count(*) >= 10)"


def matrix(t, **given):
    return L.interaction_matrix(t.baskets, "user_id", "item_id", "quantity", 10, 5, **given)


@query(
    "l4_interaction_matrix",
    sql("SELECT user_id, item_id, user_idx, item_idx, round(rating, 6) AS rating FROM m", "baskets", kept=KEPT, m=MATRIX),
)
def _(t):
    return rounded(matrix(t), "rating")


@query(
    "l4_matrix_sparsity",
    sql(
        """SELECT max(user_idx) + 1 AS n_users, max(item_idx) + 1 AS n_items, count(*) AS n_cells,
        round(1 - count(*) / ((max(user_idx) + 1) * (max(item_idx) + 1)), 6) AS sparsity FROM m""",
        "baskets",
        kept=KEPT,
        m=MATRIX,
    ),
)
def _(t):
    return rounded(L.sparsity(matrix(t)), "sparsity")


@query("l5_svd_factors")
def _(t):
    # the spectrum does not depend on how users are named
    return rounded(L.svd_factors(matrix(t, indices=["item_idx"]), "user_id", "item_idx", "rating", wanted=())[2], "singular_value", "explained")


def nmf(t, **given):
    rated = checkpointed(matrix(t))
    users, items, error = L.nmf_factors(rated, "user_idx", "item_idx", "rating", **given)
    return users, items.join(rated.select("item_idx", "item_id").distinct(), "item_idx").drop("item_idx"), error


@query("l6_nmf_factors")
def _(t):
    return rounded(nmf(t)[2], "reconstruction_error")


@query("l7_factor_sweep")
def _(t):
    return rounded(L.factor_sweep(matrix(t), "user_idx", "item_idx", "rating"), "explained", "reconstruction_error")


LOADINGS = """SELECT item_id, 0 AS factor, avg(quantity) AS loading FROM baskets GROUP BY 1 UNION ALL
    SELECT item_id, 1, avg(value) / 100000 FROM baskets GROUP BY 1"""


def measured_loadings(t):
    """Two measured item factors (mean quantity, mean order value), so that the result has an oracle."""
    rows = t.baskets.groupBy("item_id").agg(F.avg("quantity").alias("a"), (F.avg("value") / 100000).alias("b"))
    return rows.selectExpr("item_id", "stack(2, 0, a, 1, b) AS (factor, loading)")


@query(
    "l8_interpret_factors",
    sql(
        " UNION ALL ".join(
            f"""SELECT factor, '{f}' AS feature, round(corr(loading, {f}), 6) AS r, count(*) AS n, round(stddev_pop(loading), 6) AS factor_strength
            FROM ld JOIN tracks ON track_id = item_id GROUP BY 1"""
            for f in FEATURES
        ),
        "baskets",
        "tracks",
        ld=LOADINGS,
    ),
)
def _(t):
    items = t.tracks.withColumnRenamed("track_id", "item_id")
    out = L.interpret_factors(measured_loadings(t), items, "item_id", FEATURES)
    return rounded(out.select("factor", "feature", "r", "n", "factor_strength"), "r", "factor_strength")


@query("l8_factor_sentences")
def _(t):
    items = t.tracks.withColumnRenamed("track_id", "item_id")
    return L.factor_sentences(L.interpret_factors(L.long_factors(nmf(t)[1], "item_id"), items, "item_id", FEATURES, 0.01, 1.1))


@query(
    "l8_measured_sentences",
    sql(
        """SELECT factor, coalesce(string_agg(CASE WHEN r > 0 THEN 'high ' ELSE 'low ' END || feature, ', ' ORDER BY abs(r) DESC, feature) FILTER (place <= 3 AND abs(r) > 0.01),
        'uninterpretable') AS interpretation FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(r) DESC, feature) AS place FROM cr) GROUP BY 1""",
        "baskets",
        "tracks",
        ld=LOADINGS,
        cr=" UNION ALL ".join(f"SELECT factor, '{f}' AS feature, corr(loading, {f}) AS r FROM ld JOIN tracks ON track_id = item_id GROUP BY 1" for f in FEATURES),
    ),
)
def _(t):
    items = t.tracks.withColumnRenamed("track_id", "item_id")
    return L.factor_sentences(L.interpret_factors(measured_loadings(t), items, "item_id", FEATURES, 0.01, 1.1))


@query("l9_factor_stability")
def _(t):
    rows = t.baskets.withColumn("year", F.year("ts"))
    return rounded(L.factor_stability(rows, "user_id", "item_id", "quantity", "year"), "mean_r", "std_r", "min_r", "max_r")


def counted(col):
    return F.concat_ws(",", F.transform(col, lambda r: F.concat(r["artist"].cast("string"), F.lit("="), r["items"].cast("string"))))


def named_plays(t):
    return t.baskets.drop("artist_id").join(t.tracks.select(F.col("track_id").alias("item_id"), "artist_name", "culture"), "item_id")


def described(t, loadings):
    out = L.personalities(loadings, named_plays(t), "item_id", "artist_name", "culture").withColumn("top_artists", counted("top_artists"))
    return rounded(out, "vietnamese_ratio", "western_ratio", "bridge_ratio", "factor_strength", "factor_mean")


def listed(t, loadings):
    top = L.top_items_per_factor(loadings, "item_id")
    names = t.tracks.select(F.col("track_id").alias("item_id"), "artist_name")
    artists = L.factor_artists(top, names, "item_id", "artist_name").select("factor", counted("top_artists").alias("top_artists"))
    named = top.join(names, "item_id").join(artists, "factor")
    return rounded(named.select("factor", "rank", "item_id", "artist_name", "loading", "top_artists"), "loading")


TOP_ITEMS = "SELECT *, row_number() OVER (PARTITION BY factor ORDER BY loading DESC, item_id) AS rank FROM ld QUALIFY rank <= 20"
TOP_ARTISTS = """SELECT factor, string_agg(artist_name || '=' || items, ',' ORDER BY items DESC, artist_name) AS top_artists FROM (SELECT factor, artist_name, count(*) AS items
    FROM tp JOIN tracks ON track_id = item_id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY factor ORDER BY items DESC, artist_name) <= 10) GROUP BY 1"""
MEASURED = {"ld": LOADINGS, "tp": TOP_ITEMS, "ta": TOP_ARTISTS}


@query("l10_personalities")
def _(t):
    return described(t, L.long_factors(nmf(t, k=3)[1], "item_id"))


@query(
    "l10_measured_personalities",
    sql(
        """SELECT factor, round(v, 6) AS vietnamese_ratio, round(w, 6) AS western_ratio, round(b, 6) AS bridge_ratio, top_artists, round(factor_strength, 6) AS factor_strength,
        round(factor_mean, 6) AS factor_mean, CASE WHEN v > 0.7 THEN 'Vietnamese-dominant' WHEN w > 0.7 THEN 'Western-dominant' WHEN v > 0.3 AND w > 0.3 THEN 'Cross-cultural bridge'
        ELSE 'Culturally diverse' END || ' (led by ' || split_part(top_artists, '=', 1) || ')' AS interpretation FROM (SELECT factor, count(*) FILTER (culture = 'vietnamese') / count(*) AS v,
        count(*) FILTER (culture = 'western') / count(*) AS w, count(*) FILTER (culture = 'bridge') / count(*) AS b FROM tp JOIN baskets USING (item_id) JOIN tracks ON track_id = item_id GROUP BY 1)
        JOIN ta USING (factor) JOIN (SELECT factor, stddev_pop(loading) AS factor_strength, avg(loading) AS factor_mean FROM ld GROUP BY 1) USING (factor)""",
        "baskets",
        "tracks",
        **MEASURED,
    ),
)
def _(t):
    return described(t, measured_loadings(t))


@query("h7_top_items_per_factor")
def _(t):
    return listed(t, L.long_factors(nmf(t, k=3)[1], "item_id"))


@query(
    "h7_measured_top_items",
    sql(
        """SELECT factor, CAST(rank AS INTEGER) AS rank, item_id, artist_name, round(loading, 6) AS loading, top_artists FROM tp JOIN tracks ON track_id = item_id JOIN ta USING (factor)""",
        "baskets",
        "tracks",
        **MEASURED,
    ),
)
def _(t):
    return listed(t, measured_loadings(t))


USERS = """SELECT user_id, avg(CASE WHEN culture = 'vietnamese' THEN 0.9 ELSE 0.2 END) AS v, avg(CASE WHEN culture = 'western' THEN 0.9 ELSE 0.2 END) AS w,
    count(*) AS n FROM plays JOIN tracks USING (track_id) GROUP BY 1"""


def user_means(t):
    """Mean scores per user from whole tenths, so that no order of summing moves a mean across a bound or a tie; divided once, as twice rounds twice."""
    rows = t.plays.join(t.tracks.select("track_id", "culture"), "track_id")
    score = lambda c: F.sum(F.when(F.col("culture") == c, 9).otherwise(2)) / (F.count("*") * 10)
    return rows.groupBy("user_id").agg(score("vietnamese").alias("v"), score("western").alias("w"))


@query(
    "l11_assign_personality_rules",
    sql(
        """SELECT user_id, CASE WHEN v > 0.5 AND v > w THEN 'personality_1' WHEN w > 0.5 AND w > v THEN 'personality_2' ELSE 'personality_3' END AS personality FROM u""",
        "plays",
        "tracks",
        u=USERS,
    ),
)
def _(t):
    return L.assign_personality(user_means(t), "v", "w").select("user_id", "personality")


SIMILAR = [
    {"id": "p1", "profile": {"v": 0.93, "w": 0.11}, "strength": 0.2},
    {"id": "p2", "profile": {"v": 0.17, "w": 0.79}, "strength": 0.4},
    {"id": "p3", "profile": {"v": 0.47, "w": 0.53}, "strength": 0.1},
]


@query(
    "l12_assign_personality_similarity",
    sql(
        """SELECT user_id, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'p1' WHEN s2 >= s3 THEN 'p2' ELSE 'p3' END AS personality, round(greatest(s1, s2, s3) + 1e-9, 6) AS similarity FROM (
        SELECT user_id, 0.93 * v + 0.11 * w + CASE WHEN c > 0.3 THEN 0.1 ELSE 0 END AS s1, 0.17 * v + 0.79 * w + CASE WHEN c > 0.3 THEN 0.2 ELSE 0 END AS s2,
        0.47 * v + 0.53 * w + CASE WHEN c > 0.3 THEN 0.05 ELSE 0 END AS s3 FROM u JOIN (SELECT user_id, max(n) / sum(n) AS c FROM (SELECT user_id, label, count(*) AS n
        FROM plays GROUP BY 1, 2) GROUP BY 1) USING (user_id))""",
        "plays",
        "tracks",
        u=USERS,
    ),
)
def _(t):
    by = t.plays.groupBy("user_id", "label").agg(F.count("*").alias("n")).groupBy("user_id").agg((F.max("n") / F.sum("n")).alias("c"))
    out = L.assign_by_similarity(user_means(t).join(by, "user_id"), SIMILAR, ["v", "w"], "c")
    return out.select("user_id", "personality", F.round(F.col("similarity") + 1e-9, 6).alias("similarity"))


def daily_table(t):
    return ML.volume_features(t.history, "ts", F.col("label") == "1-URGENT")


@query("l13_volume_regressor")
def _(t):
    return rounded(ML.expanding_cv(daily_table(t), "date", ML.volume_regressor), "mae", "rmse", "r2")


@query("l14_volume_forecast")
def _(t):
    model = ML.volume_regressor(daily_table(t))
    recent = S.trailing_n_events(t.history, [], "ts", "event_id", 1000)
    last = t.history.agg(F.to_date(F.max("ts")).alias("d"))
    targets = last.select(F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", 7))).alias("date"))
    out = ML.volume_forecast(model, recent, targets, "ts", "label", "date", "1-URGENT")
    return rounded(out, "predicted_plays", "low", "high", "expected_sessions").select(
        F.col("date").cast("string").alias("date"), "predicted_plays", "low", "high", "expected_sessions", F.concat_ws(",", "peak_hours").alias("peak_hours")
    )


@query("l15_ratio_forecaster")
def _(t):
    return rounded(ML.ratio_forecaster(monthly_ratio(t), "month", "ratio"), "predicted")


SF = """SELECT *, count(*) OVER (PARTITION BY user_id, session_no) AS len, row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) - 1 AS pos,
    hour(ts) AS h FROM sess"""


def session_rows(t):
    return ML.session_features(t.plays, "ts", "user_id", "event_id", "artist_id", F.col("label") == "click", gap_minutes=240)


@query(
    "l16_session_features",
    sql(
        f"""SELECT event_id, artist_id, round(h / 24, 6) AS hour, round((isodow(ts) - 1) / 6, 6) AS day, CAST(isodow(ts) >= 6 AS DOUBLE) AS is_weekend,
        round(pos / len, 6) AS position, len::DOUBLE AS session_length, CAST(label = 'click' AS DOUBLE) AS class_flag, {BANDS_SQL} AS band
        FROM long WHERE artist_id IN (SELECT artist_id FROM (SELECT artist_id, row_number() OVER (ORDER BY count(*) DESC, artist_id) AS place, count(*) OVER () AS n
            FROM long GROUP BY 1) WHERE n <= 100 OR place <= 50)""",
        "sess",
        sf=SF,
        long="SELECT * FROM sf WHERE len >= 3",
    ),
)
def _(t):
    rows = session_rows(t)
    band = (
        F.when(F.col("is_morning") == 1, "morning").when(F.col("is_afternoon") == 1, "afternoon").when(F.col("is_evening") == 1, "evening").otherwise("night")
    )
    out = rows.select("event_id", "artist_id", "hour", "day", "is_weekend", "position", "session_length", "class_flag", band.alias("band"))
    return rounded(out, "hour", "day", "position")


@query("l17_session_artist_classifier")
def _(t):
    return rounded(ML.session_artist_classifier(session_rows(t), "artist_id", "event_id")[1], "accuracy", "cv_accuracy", "cv_std")


def moods(t):
    return ML.mood_features(t.plays, "ts", "user_id", "event_id", "artist_id", "label", gap_minutes=240)


@query(
    "l18_mood_features",
    sql(
        """SELECT user_id, session_no, h AS hour, dow AS day_of_week, wk AS is_weekend, n AS session_length, round(span, 6) AS span_hours, classes AS n_classes,
        round(rep, 6) AS artist_repetition, CASE WHEN h >= 6 AND h < 12 THEN CASE WHEN n > 20 THEN 'energetic' ELSE 'calm' END
        WHEN h >= 9 AND h < 17 AND wk = 0 THEN CASE WHEN rep > 0.5 THEN 'focused' ELSE 'background' END
        WHEN h >= 18 AND h < 22 THEN CASE WHEN wk = 1 AND n > 30 THEN 'social' ELSE 'relaxed' END
        ELSE CASE WHEN rep > 0.6 THEN 'contemplative' ELSE 'chill' END END AS mood FROM (SELECT user_id, CAST(session_no AS BIGINT) AS session_no, hour(min(ts)) AS h, isodow(min(ts)) - 1 AS dow,
        CAST(isodow(min(ts)) >= 6 AS INTEGER) AS wk, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS span, count(DISTINCT label) AS classes,
        max(c) / count(*) AS rep FROM (SELECT *, count(*) OVER (PARTITION BY user_id, session_no, artist_id) AS c FROM sess) GROUP BY 1, 2 HAVING count(*) >= 3)""",
        "sess",
    ),
)
def _(t):
    return rounded(moods(t), "span_hours", "artist_repetition")


@query("l19_mood_classifier")
def _(t):
    rows = checkpointed(moods(t))
    prep, model, groups = ML.mood_classifier(rows)
    data = groups.transform(prep.transform(rows))
    scored = model.transform(data)
    return scored.groupBy("mood").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"),
        F.countDistinct("mood_cluster").alias("clusters"),
    )


BRIDGE_FEATURES = ["plays", "artists", "hours", "weekdays", *FEATURES, "is_vietnamese", "transition_score"]


def labelled(t):
    """Tracks with the label of a bridge: a behavioural bridge (K4) or an effective transition item (H4)."""
    from encore.operators.bridges import behavioural_bridges

    known = behavioural_bridges(t.plays, "track_id", "user_id", "label", "ts").select("track_id").unionByName(effective_items(t).select("track_id"))
    marked = known.distinct().withColumn("is_bridge", F.lit(True))
    return checkpointed(bridge_features(t).join(marked, "track_id", "left").withColumn("is_bridge", F.coalesce("is_bridge", F.lit(False))))


BRIDGES = f"""SELECT track_id FROM (SELECT track_id, count(*) AS plays FROM plays WHERE track_id IN (SELECT track_id FROM plays WHERE user_id IN (SELECT user_id FROM plays
    GROUP BY 1 HAVING count(DISTINCT label) > 1) UNION SELECT track_id FROM plays GROUP BY 1 HAVING count(DISTINCT hour(ts)) >= 5)
    GROUP BY 1 ORDER BY plays DESC, track_id LIMIT 50) UNION SELECT track_id FROM ({EFFECTIVE})"""


@query(
    "l20_bridge_labels",
    sql(
        "SELECT track_id, plays, track_id IN (SELECT track_id FROM br) AS is_bridge FROM (SELECT track_id, count(*) AS plays FROM plays GROUP BY 1) JOIN tracks USING (track_id)",
        "plays",
        "tracks",
        tr=TRANSITIONS,
        br=BRIDGES,
    ),
)
def _(t):
    return labelled(t).select("track_id", "plays", "is_bridge")


def forest(rows):
    return ML.bridge_classifier(rows, BRIDGE_FEATURES, "is_bridge", "track_id")


@query("l20_bridge_classifier")
def _(t):
    from pyspark.ml.functions import vector_to_array

    scored = forest(labelled(t))[1].withColumn("p", vector_to_array("probability")[1])
    return rounded(ML.class_metrics(scored, "label", "prediction", "p"), "accuracy", "precision", "recall", "auc")


@query("l21_detect_bridges")
def _(t):
    from encore.operators.bridges import novelty_by_frequency

    known = labelled(t)
    model = forest(known)[0]
    rows = known.join(novelty_by_frequency(t.plays, "track_id").select("track_id", "novelty"), "track_id")
    out = ML.detect_bridges(model, rows.withColumn("label", F.lit(0.0)), "track_id", "mean_centrality", "transition_score", "novelty", 0.5)
    return rounded(out, "bridge_probability", "cultural_span", "transition_effectiveness", "novelty", "confidence")


@query("l22_bridge_logistic")
def _(t):
    rows = t.tracks.withColumn("is_bridge", F.col("culture") == "bridge")
    return rounded(ML.bridge_logistic(rows, FEATURES, "is_bridge"), "accuracy", "base_rate", "lr_chi2", "p_value")


@query(
    "l23_regression_metrics",
    """SELECT l_returnflag, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2
    FROM (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p FROM lineitem) GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))
    out = ML.regression_metrics(rows, "y", "p", ["l_returnflag"])
    return rounded(out, "r2").withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4)})


@query(
    "l23_class_metrics",
    """SELECT n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round((r - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc FROM (
    SELECT count(*) AS n, avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) AS accuracy, count(*) FILTER (y = 1 AND p = 1) / count(*) FILTER (p = 1) AS precision,
    count(*) FILTER (y = 1 AND p = 1) / count(*) FILTER (y = 1) AS recall, (count(*) FILTER (y = 1))::DOUBLE AS pos, sum(rk) FILTER (y = 1) AS r FROM (
    SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM (SELECT CAST(l_extendedprice > 40000 AS INTEGER) AS y,
    CAST(l_quantity > 25 AS INTEGER) AS p, l_quantity AS s FROM lineitem)))""",
)
def _(t):
    rows = t.lineitem.select(
        (F.col("l_extendedprice") > 40000).cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"), F.col("l_quantity").alias("s")
    )
    return rounded(ML.class_metrics(rows, "y", "p", "s"), "accuracy", "precision", "recall", "auc")
