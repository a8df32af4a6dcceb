"""Queries of the bridge operators (K) and recommendation scoring (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.operators import activity as A
from encore.operators import bridges as B
from encore.operators import recommend as M
from encore.operators import sessions as S
from encore.operators.scan import hot_cells
from encore.plans.activity import modal, playlist, PLAYLIST
from encore.plans.base import query, sql
from encore.plans.scalar import BANDS_SQL, six
from encore.plans.sessions import POINTS, SHIFT, TRANSITIONS, after_runs, points
from encore.operators.timeseries import recent_context_label
from encore.plans.timeseries import rounded
from encore.session import checkpointed

FEATURES = ["energy", "valence", "danceability", "acousticness"]

ITEM_STATS = """SELECT item_id, count(*) AS play_count, round(sum(quantity), 2) AS total_minutes, avg(CASE WHEN label = '1-URGENT' AND quantity > 48 THEN 1.0 ELSE 0 END) AS a,
    avg(CASE WHEN label = '5-LOW' AND quantity > 48 THEN 1.0 ELSE 0 END) AS b FROM baskets GROUP BY 1"""
CANDIDATES = """SELECT *, 2 * CAST(play_count > q80 AS INTEGER) + 3 * CAST(a > 0 AND b > 0 AS INTEGER) + CAST(energy BETWEEN 0.4 AND 0.6 AS INTEGER)
    + CAST(valence > 0.7 AS INTEGER) + CAST(acousticness > 0.3 AS INTEGER) + 2 * CAST(play_count > q95 AS INTEGER) AS bridge_score,
    concat_ws(',', CASE WHEN play_count > q80 THEN 'high_replay_value' END, CASE WHEN a > 0 AND b > 0 THEN 'cross_cultural_artist' END,
    CASE WHEN energy BETWEEN 0.4 AND 0.6 THEN 'moderate_energy' END, CASE WHEN valence > 0.7 THEN 'high_valence' END,
    CASE WHEN acousticness > 0.3 THEN 'acoustic_content' END, CASE WHEN play_count > q95 THEN 'extremely_popular' END) AS reasons
    FROM st JOIN tracks ON track_id = item_id, (SELECT quantile_cont(play_count, 0.8) AS q80, quantile_cont(play_count, 0.95) AS q95 FROM st)"""
CAND = {"st": ITEM_STATS, "cand": f"SELECT * FROM ({CANDIDATES}) WHERE bridge_score >= 3"}


def item_stats(t):
    heavy = F.col("quantity") > 48
    stats = t.baskets.groupBy("item_id").agg(
        F.count("*").alias("play_count"),
        F.round(F.sum("quantity"), 2).alias("total_minutes"),
        F.avg(((F.col("label") == "1-URGENT") & heavy).cast("double")).alias("a"),
        F.avg(((F.col("label") == "5-LOW") & heavy).cast("double")).alias("b"),
    )
    return stats.join(t.tracks.withColumnRenamed("track_id", "item_id"), "item_id")


def candidates(t):
    return B.bridge_candidates(item_stats(t), "play_count", "a", "b", "energy", "valence", "acousticness")


@query(
    "k1_bridge_candidates",
    sql("SELECT item_id, play_count, total_minutes, bridge_score, reasons FROM cand", "baskets", "tracks", **CAND),
)
def _(t):
    return candidates(t).select(
        "item_id", "play_count", "total_minutes", "bridge_score", F.concat_ws(",", "bridge_reasons").alias("reasons")
    )


@query(
    "k2_gateway_items",
    sql(
        """SELECT track_id, count(*) AS total_plays, count(*) FILTER (moved) AS transitions, round(count(*) FILTER (moved) / count(*), 6)
        AS transition_rate, (SELECT string_agg(m || '=' || n, ',' ORDER BY m) FROM (SELECT label || '_to_' || nx AS m, count(*) AS n FROM nxt b
        WHERE b.moved AND b.track_id = a.track_id GROUP BY 1)) AS moves FROM nxt a GROUP BY 1
        HAVING count(*) FILTER (moved) >= 3 AND count(*) FILTER (moved) / count(*) > 0.5 ORDER BY transition_rate DESC, track_id LIMIT 10""",
        "plays",
        nxt="""SELECT track_id, label, nx, coalesce(label <> 'error' AND nx <> 'error' AND label <> nx, false) AS moved FROM (SELECT *,
        lead(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM plays)""",
    ),
)
def _(t):
    nxt = S.next_label(t.plays, ["user_id"], ["ts", "event_id"], "label", hot_cells())
    out = B.gateway_items(nxt, "track_id", "label", "next_label", unknown="error")
    text = F.concat_ws(",", F.transform(F.map_entries("moves"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return rounded(out.withColumn("moves", text), "transition_rate")


@query(
    "k3_transition_patterns",
    sql(
        """SELECT 'direction' AS kind, from_label || '>' || to_label AS key, count(*) AS n, round(avg(strength), 6) AS strength FROM tr GROUP BY 2
        UNION ALL SELECT 'band', band, count(*), round(avg(strength), 6) FROM tr GROUP BY 2""",
        "plays",
        tr=TRANSITIONS,
    ),
)
def _(t):
    return rounded(B.transition_patterns(after_runs(t)), "strength")


@query(
    "k4_behavioural_bridges",
    sql(
        """SELECT track_id, count(*) AS plays FROM plays WHERE track_id IN (SELECT track_id FROM plays WHERE user_id IN (SELECT user_id FROM plays
        GROUP BY 1 HAVING count(DISTINCT label) > 1) UNION SELECT track_id FROM plays GROUP BY 1 HAVING count(DISTINCT hour(ts)) >= 5)
        GROUP BY 1 ORDER BY plays DESC, track_id LIMIT 50""",
        "plays",
    ),
)
def _(t):
    return B.behavioural_bridges(t.plays, "track_id", "user_id", "label", "ts")


PROFILE_ROWS = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, avg({f}) FILTER (culture = 'bridge') AS br, avg({f}) FILTER (culture = 'vietnamese') AS a,
    avg({f}) FILTER (culture = 'western') AS b FROM tracks"""
    for f in FEATURES
)
CENTRAL = "CASE WHEN abs(a - b) > 0 THEN 1 - abs(br - (a + b) / 2) / (abs(a - b) / 2) ELSE 1 END"


def profiles(t):
    c = F.col("culture")
    return B.class_audio_profiles(t.tracks, FEATURES, c == "bridge", c == "vietnamese", c == "western")


@query(
    "k5_class_audio_profiles",
    sql(
        f"""SELECT feature, round(br, 6) AS bridge_mean, round(a, 6) AS a_mean, round(b, 6) AS b_mean, round(abs(a - b), 6) AS span,
        round({CENTRAL}, 4) AS centrality FROM pr""",
        "tracks",
        pr=PROFILE_ROWS,
    ),
)
def _(t):
    return rounded(profiles(t), "bridge_mean", "a_mean", "b_mean", "span").withColumn("centrality", F.round("centrality", 4))


def bridge_features(t):
    return B.track_bridge_features(t.plays, t.tracks, "track_id", "user_id", "ts", after_runs(t), FEATURES, profiles(t))


@query(
    "k6_track_bridge_features",
    sql(
        f"""SELECT track_id, plays, artists, hours, weekdays, round(energy, 6) AS energy, round(valence, 6) AS valence,
        round(danceability, 6) AS danceability, round(acousticness, 6) AS acousticness, CAST(culture = 'vietnamese' AS INTEGER) AS is_vietnamese,
        CAST(culture <> 'vietnamese' AS INTEGER) AS is_western, round(coalesce(s, 0), 6) AS transition_score,
        round((SELECT avg({CENTRAL}) FROM pr), 4) AS mean_centrality FROM (SELECT track_id, count(*) AS plays, count(DISTINCT user_id) AS artists,
        count(DISTINCT hour(ts)) AS hours, count(DISTINCT isodow(ts)) AS weekdays FROM plays GROUP BY 1) JOIN tracks USING (track_id) LEFT JOIN
        (SELECT track_id, avg(strength) AS s FROM tr GROUP BY 1 HAVING count(*) >= 2) USING (track_id)""",
        "plays",
        "tracks",
        tr=TRANSITIONS,
        pr=PROFILE_ROWS,
    ),
)
def _(t):
    out = rounded(bridge_features(t), *FEATURES, "transition_score")
    return out.withColumn("mean_centrality", F.round("mean_centrality", 4))


@query(
    "k7_novelty_by_frequency",
    "SELECT l_partkey, count(*) AS plays, round(1 - least(count(*) * 100 / (SELECT count(*) FROM lineitem), 1), 6) AS novelty FROM lineitem GROUP BY 1",
)
def _(t):
    return rounded(B.novelty_by_frequency(t.lineitem, "l_partkey"), "novelty")


LOOKUP = """SELECT lower(track_name || '_' || artist_name) AS key, max(energy) * 8 AS score FROM tracks WHERE energy > 0.6 GROUP BY 1"""
BRIDGE = """SELECT t.*, coalesce(score / 10, least(CASE WHEN energy BETWEEN 0.4 AND 0.7 THEN 0.3 ELSE 0 END + CASE WHEN valence > 0.6 THEN 0.3 ELSE 0 END
    + CASE WHEN acousticness > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN culture IN ('bridge', 'other') THEN 0.2 ELSE 0 END, 1)) AS bridge_score
    FROM tracks t LEFT JOIN lk ON key = lower(track_name || '_' || artist_name)"""


def scored_bridges(t):
    key = F.lower(F.concat("track_name", F.lit("_"), "artist_name"))
    lookup = t.tracks.filter("energy > 0.6").groupBy(key.alias("key")).agg((F.max("energy") * 8).alias("score"))
    return B.bridge_score(t.tracks, lookup)


@query(
    "k8_bridge_score",
    sql("SELECT track_id, round(bridge_score, 6) AS bridge_score FROM br", "tracks", lk=LOOKUP, br=BRIDGE),
)
def _(t):
    return scored_bridges(t).select("track_id", *six(("bridge_score", F.col("bridge_score"))))


@query(
    "k9_bridges_between",
    sql(
        """SELECT item_id, bridge_score, reasons FROM (SELECT * FROM cand ORDER BY bridge_score DESC, item_id LIMIT 20)
        WHERE contains(reasons, 'cross_cultural_artist') OR contains(reasons, 'high_valence') ORDER BY bridge_score DESC, item_id LIMIT 5""",
        "baskets",
        "tracks",
        **CAND,
    ),
)
def _(t):
    out = B.bridges_between(candidates(t), "item_id", "vietnamese", "western")
    return out.select("item_id", "bridge_score", F.concat_ws(",", "bridge_reasons").alias("reasons"))


@query(
    "k10_extract_bridges",
    sql(
        """SELECT track_name, artist_name, CAST(bridge_score AS DOUBLE) AS bridge_score, culture AS cultural_from, 'unknown' AS cultural_to,
        replace(lower(track_name || '_' || artist_name), ' ', '_') AS lookup_key FROM cand""",
        "baskets",
        "tracks",
        **CAND,
    ),
)
def _(t):
    rows = F.array(F.struct("track_name", "artist_name", "bridge_score", F.col("culture").alias("from_culture")))
    results = candidates(t).select(F.to_json(F.struct(rows.alias("bridge_candidates"))).alias("report"))
    return B.extract_bridges(results, "report")


# ---- M -------------------------------------------------------------------

PERSONAS = [
    {"id": "p1", "text": "Vietnamese indie listener", "artists": [("brand#1", 80), ("brand#23", 140)], "vietnamese": 0.8, "western": 0.1},
    {"id": "p2", "text": "Western pop listener", "artists": [("brand#24", 60)], "vietnamese": 0.2, "western": 0.7},
    {"id": "p3", "text": "Mixed taste", "artists": [("brand#5", 30)], "vietnamese": 0.4, "western": 0.4},
]
IDS = [p["id"] for p in PERSONAS]


@query(
    "m1_personality_preferences",
    "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'vi') THEN 'x' ELSE 'y' END AS tag, "
    "CASE role WHEN 'user' THEN 0.5 WHEN 'assistant' THEN 0.7 ELSE 0.6 END::DOUBLE AS pref_energy, "
    "CASE role WHEN 'user' THEN 0.4 WHEN 'assistant' THEN 0.6 ELSE 0.5 END::DOUBLE AS pref_valence, "
    "CASE role WHEN 'user' THEN 0.1 WHEN 'assistant' THEN 0.1 ELSE 0.15 END::DOUBLE AS pref_speechiness FROM conversations",
)
def _(t):
    text = F.when(F.col("role") == "user", "Prefers Vietnamese music").when(F.col("role") == "assistant", "WESTERN hits").otherwise(F.col("role"))
    out = M.personality_preferences(t.conversations.withColumn("interpretation", text), "interpretation")
    tag = F.when(F.lower("text").contains("vi"), "x").otherwise("y").alias("tag")
    return out.select("conv_id", "turn", tag, "pref_energy", "pref_valence", "pref_speechiness")


def _affinity_sql(artists) -> str:
    low = "lower(artist_name)"
    whens = " ".join(f"WHEN contains({low}, '{n}') OR contains('{n}', {low}) THEN least({c} / 100.0, 1)" for n, c in artists)
    return f"CASE {whens} ELSE 0 END"


def persona_sql(p) -> str:
    prefs = M.preset_of(p["text"])
    audio = " + ".join(f"0.4 * (1 - abs({prefs[f]} - {f}))" for f in FEATURES)
    fit = f"CASE culture WHEN 'vietnamese' THEN {p['vietnamese']} WHEN 'western' THEN {p['western']} WHEN 'bridge' THEN 0.5 ELSE 0 END"
    return f"({audio} + 0.4 * {_affinity_sql(p['artists'])} + 0.2 * {fit}) / 2.2"


WIDE = "SELECT track_id, culture, energy, valence, danceability, acousticness, " + ", ".join(
    f"CAST({persona_sql(p)} AS DOUBLE) AS s_{p['id']}" for p in PERSONAS
) + " FROM tracks"


def scores(t):
    return M.personality_scores(t.tracks, PERSONAS, FEATURES)


def wide(t):
    return M.wide_scores(scores(t), ["track_id"], IDS)


@query(
    "m2_personality_score",
    sql(
        " UNION ALL ".join(f"SELECT track_id, '{i}' AS personality, round(s_{i}, 6) AS score FROM ws" for i in IDS), "tracks", ws=WIDE
    ),
)
def _(t):
    return scores(t).select("track_id", "personality", F.round("personality_score", 6).alias("score"))


@query(
    "m3_temporal_weight",
    sql(
        """SELECT event_id, round(exp(-date_diff('day', ts, TIMESTAMP '2001-08-01') / 180.0) * pow(0.7, coalesce(n, 0)), 9) AS temporal_weight
        FROM history LEFT JOIN (SELECT d.date AS day, count(*) AS n FROM daily d JOIN pts p ON abs(d.date - p.date) < 30 AND
        DATE '2001-08-01' - p.date < 90 GROUP BY 1) ON day = CAST(ts AS DATE)""",
        "history",
        "signals",
        sh=SHIFT,
        pts=POINTS,
    ),
)
def _(t):
    cps = points(t).select(F.col("date").alias("cp"))
    out = M.temporal_weight(t.history, cps, "ts", "cp", F.lit("2001-08-01").cast("date"))
    return out.select("event_id", F.round("temporal_weight", 9).alias("temporal_weight"))


PROFILES = (
    "SELECT user_id, plays, "
    + ", ".join(f"w_{i} / ({' + '.join(f'w_{j}' for j in IDS)}) AS w_{i}" for i in IDS)
    + ", pref_energy, share_vietnamese, share_western, share_chinese, share_other FROM (SELECT user_id, count(*) AS plays, "
    + ", ".join(f"avg(s_{i}) AS w_{i}" for i in IDS)
    + """, avg(energy) AS pref_energy, CASE WHEN count(*) FILTER (culture = 'vietnamese') > 0 THEN count(*) FILTER (culture = 'vietnamese') / count(*) ELSE 0.4 END
    AS share_vietnamese, CASE WHEN count(*) FILTER (culture = 'western') > 0 THEN count(*) FILTER (culture = 'western') / count(*) ELSE 0.3 END AS share_western,
    0.1 AS share_chinese, CASE WHEN count(*) FILTER (culture = 'other') > 0 THEN count(*) FILTER (culture = 'other') / count(*) ELSE 0.2 END AS share_other
    FROM plays JOIN ws USING (track_id) GROUP BY 1)"""
)


def user_profiles(t, users=None):
    return M.user_profiles(t.plays, wide(t), t.tracks, "user_id", "track_id", IDS, FEATURES, users)


@query(
    "m4_user_profile",
    sql(
        """SELECT c_custkey AS user_id, coalesce(plays, 0) AS plays, round(coalesce(w_p1, 0.4), 6) AS w_p1, round(coalesce(w_p2, 0.3), 6) AS w_p2,
        round(coalesce(w_p3, 0.3), 6) AS w_p3, round(coalesce(pref_energy, 0.5) + 1e-9, 6) AS pref_energy, round(coalesce(share_vietnamese, 0.5), 6)
        AS share_vietnamese, round(coalesce(share_other, 0), 6) AS share_other, context FROM customer LEFT JOIN pf ON c_custkey = user_id, (SELECT CASE WHEN count(*) = 0 THEN 'stable'
        WHEN count(*) FILTER (signal = 'urgent_share') > 0 THEN 'urgent_share_shift' WHEN count(*) FILTER (signal = 'open_share') > 0 THEN 'open_share_shift'
        WHEN count(*) FILTER (signal LIKE '%value%') > 0 THEN 'energy_shift' ELSE 'preference_exploration' END AS context FROM pts
        WHERE (SELECT max(date) FROM daily) - date BETWEEN 0 AND 59)""",
        "plays",
        "tracks",
        "signals",
        sh=SHIFT,
        pts=POINTS,
        ws=WIDE,
        pf=PROFILES,
    ),
)
def _(t):
    out = user_profiles(t, t.customer.select(F.col("c_custkey").alias("user_id")))
    cols = ["w_p1", "w_p2", "w_p3", "pref_energy", "share_vietnamese", "share_other"]
    out = out.withColumn("pref_energy", F.col("pref_energy") + 1e-9)
    now = t.daily.select(F.max("date")).scalar()
    context = recent_context_label(points(t), "date", "signal", now, "urgent_share", "open_share", "value").select("context").scalar()
    return rounded(out.select("user_id", "plays", *cols), *cols).withColumn("context", context)


RECS = {"ws": WIDE, "pf": PROFILES, "lk": LOOKUP, "br": BRIDGE}


UNSEEN_SCORES = """SELECT user_id, track_id, 0.6 * (w_p1 * s_p1 + w_p2 * s_p2 + w_p3 * s_p3) + 0.2 * bridge_score + 0.16 AS score
    FROM (SELECT user_id, track_id FROM (SELECT DISTINCT user_id FROM plays), ws) x JOIN ws USING (track_id) JOIN br USING (track_id) JOIN pf USING (user_id)
    WHERE NOT EXISTS (SELECT 1 FROM plays p WHERE p.user_id = x.user_id AND p.track_id = x.track_id)"""


def best_unseen(t):
    return M.recommend_unseen(t.plays, t.plays, user_profiles(t), wide(t), scored_bridges(t), "user_id", "track_id", IDS)


@query(
    "m5_recommend",
    sql(
        """SELECT user_id, track_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
        FROM us QUALIFY rank <= 10""",
        "plays",
        "tracks",
        **RECS,
        us=UNSEEN_SCORES,
    ),
)
def _(t):
    return rounded(best_unseen(t), "score").select("user_id", "track_id", "score", "rank")


CTX = f"""SELECT event_id, {BANDS_SQL} AS band, h AS hour, isodow(ts) < 6 AND h >= 9 AND h < 17 AS is_work, isodow(ts) >= 6 AS is_weekend, label, track_id,
    artist_id, user_id FROM (SELECT *, hour(ts) AS h FROM plays)"""
SHARES = {
    c: f"SELECT {c}, avg(CASE WHEN label = 'click' THEN 1.0 ELSE 0 END) AS click, avg(CASE WHEN label = 'view' THEN 1.0 ELSE 0 END) AS view FROM ctx GROUP BY 1"
    for c in ("band", "is_work", "is_weekend")
}
PREFS = """SELECT ctx.*, 0.4 * b.click + 0.3 * w.click + 0.3 * e.click AS pref_click, 0.4 * b.view + 0.3 * w.view + 0.3 * e.view AS pref_view
    FROM ctx JOIN sb b USING (band) JOIN sw w USING (is_work) JOIN se e USING (is_weekend)"""
CONTEXT = {"ctx": CTX, "sb": SHARES["band"], "sw": SHARES["is_work"], "se": SHARES["is_weekend"], "prefs": PREFS}


def contexts(t):
    return M.contexts_of(t.plays, "ts").select("event_id", "hour", "band", "is_work", "is_weekend", "label", "track_id", "artist_id", "user_id")


def with_prefs(t):
    return M.context_preferences(contexts(t), t.plays, "label", ["click", "view"], "ts")


@query(
    "m6_context_preferences",
    sql("SELECT event_id, round(pref_click, 6) AS pref_click, round(pref_view, 6) AS pref_view FROM prefs", "plays", **CONTEXT),
)
def _(t):
    return rounded(with_prefs(t), "pref_click", "pref_view").select("event_id", "pref_click", "pref_view")


ARTIST = {
    "top": "SELECT artist_id FROM plays GROUP BY 1 ORDER BY count(*) DESC, artist_id LIMIT 50",
    "mb": modal("ctx", "artist_id", "band", "preferred_band"),
    "ap": """SELECT artist_id, preferred_band, avg(CASE WHEN is_weekend THEN 1.0 ELSE 0 END) AS wk, avg(CASE WHEN is_work THEN 1.0 ELSE 0 END) AS wo
        FROM ctx JOIN top USING (artist_id) JOIN mb USING (artist_id) GROUP BY 1, 2 HAVING count(*) > 10""",
    "cs": """SELECT prefs.*, CASE WHEN preferred_band IS NULL THEN 0.5 ELSE 0.4 * CASE WHEN preferred_band = band THEN 1 ELSE 0.5 END
        + 0.3 * (1 - abs(wk - CAST(is_weekend AS INTEGER))) + 0.3 * (1 - abs(wo - CAST(is_work AS INTEGER))) END AS context_score
        FROM prefs LEFT JOIN ap USING (artist_id)""",
}


def artist_profile(t):
    return A.artist_temporal_profile(t.plays, "artist_id", "ts", "label", 50)


@query(
    "m7_context_score",
    sql("SELECT event_id, round(context_score, 6) AS context_score FROM cs", "plays", **CONTEXT, **ARTIST),
)
def _(t):
    return rounded(M.context_score(contexts(t), artist_profile(t), "artist_id"), "context_score").select("event_id", "context_score")


HOURLY = "SELECT hour(ts) AS hour, count(*) AS plays, count(*) / max(count(*)) OVER () AS appropriateness FROM plays GROUP BY 1"


@query("m8_time_appropriateness", sql(f"SELECT hour, plays, round(appropriateness, 6) AS appropriateness FROM ({HOURLY})", "plays"))
def _(t):
    return rounded(M.time_appropriateness(t.plays, "ts"), "appropriateness")


CULTURES = ["vietnamese", "western", "bridge"]
CULTURE_SHARES = {
    c: f"SELECT {c}, " + ", ".join(f"avg(CASE WHEN culture = '{k}' THEN 1.0 ELSE 0 END) AS {k}" for k in CULTURES) + " FROM ctx JOIN tracks USING (track_id) GROUP BY 1"
    for c in ("band", "is_work", "is_weekend")
}
LATEST = f"""SELECT lp.*, {', '.join(f'0.4 * coalesce(b.{k}, 0.5) + 0.3 * coalesce(w.{k}, 0.5) + 0.3 * coalesce(e.{k}, 0.5) AS pref_{k}' for k in CULTURES)} FROM (
    SELECT user_id, label, h AS hour, {BANDS_SQL} AS band, isodow(ts) < 6 AND h >= 9 AND h < 17 AS is_work, isodow(ts) >= 6 AS is_weekend
    FROM (SELECT *, hour(ts) AS h FROM plays) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) lp
    LEFT JOIN cb b USING (band) LEFT JOIN cw w USING (is_work) LEFT JOIN ce e USING (is_weekend)"""
CONTEXTUAL = """SELECT *, 0.4 * context_score + 0.3 * appropriateness + 0.3 * fit AS score, CASE WHEN r = '' THEN 'Contextually appropriate' ELSE r END AS reason FROM (
    SELECT *, concat_ws('; ', CASE band WHEN 'morning' THEN 'Good morning energy' WHEN 'evening' THEN 'Perfect for evening relaxation'
    WHEN 'night' THEN 'Suitable for late-night listening' END, CASE WHEN is_weekend THEN 'Weekend vibe' WHEN is_work THEN 'Work-friendly choice' END,
    CASE WHEN fit > 0.6 THEN 'Matches current preference' END) AS r FROM (SELECT lt.*, track_id, CASE culture WHEN 'vietnamese' THEN pref_vietnamese WHEN 'western' THEN pref_western
    WHEN 'bridge' THEN pref_bridge ELSE 0.5 END AS fit, CASE WHEN preferred_band IS NULL THEN 0.5 ELSE 0.4 * CASE WHEN preferred_band = band THEN 1 ELSE 0.5 END
    + 0.3 * (1 - abs(wk - CAST(is_weekend AS INTEGER))) + 0.3 * (1 - abs(wo - CAST(is_work AS INTEGER))) END AS context_score, appropriateness
    FROM lt JOIN tracks ON NOT EXISTS (SELECT 1 FROM plays p WHERE p.user_id = lt.user_id AND p.track_id = tracks.track_id)
    LEFT JOIN ap ON ap.artist_id = track_id // 5 JOIN hr USING (hour)))"""
CATALOGUE = {"cb": CULTURE_SHARES["band"], "cw": CULTURE_SHARES["is_work"], "ce": CULTURE_SHARES["is_weekend"], "lt": LATEST, "hr": HOURLY, "cx": CONTEXTUAL}


def catalogue(t):
    """Tracks with the artist of the play log: five tracks per artist."""
    return t.tracks.withColumn("artist_id", F.floor(F.col("track_id") / 5).cast("int"))


def latest(t):
    """The context of each listener's latest play with the class preferences of contexts like it."""
    heard = t.plays.join(t.tracks.select("track_id", "culture"), "track_id")
    return M.context_preferences(M.latest_context(t.plays, "user_id", "ts", "event_id", "label"), heard, "culture", CULTURES, "ts")


@query(
    "m9_contextual_recommend",
    sql(
        """SELECT user_id, track_id, round(score, 6) AS score, reason, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
        FROM cx QUALIFY rank <= 10""",
        "plays",
        "tracks",
        **CONTEXT,
        **ARTIST,
        **CATALOGUE,
    ),
)
def _(t):
    hourly = M.time_appropriateness(t.plays, "ts")
    out = M.contextual_unseen(latest(t), t.plays, catalogue(t), artist_profile(t), hourly, "user_id", "track_id", "artist_id", "culture", CULTURES)
    return rounded(out, "score").select("user_id", "track_id", "score", "reason", "rank")


MOODS = {"click": "energetic", "error": "contemplative", "purchase": "social", "signup": "focused", "view": "unheard"}


def mood_col():
    out = F.lit(None).cast("string")
    for k, v in MOODS.items():
        out = F.when(F.col("label") == k, v).otherwise(out)
    return out


@query(
    "m10_mood_fit",
    sql(
        """SELECT event_id, CASE label WHEN 'click' THEN 0.8 WHEN 'error' THEN 0.4 WHEN 'purchase' THEN 0.9 WHEN 'signup' THEN 0.7 ELSE 0.5 END::DOUBLE AS mood_fit
        FROM plays""",
        "plays",
    ),
)
def _(t):
    return t.plays.select("event_id", M.mood_fit(mood_col()).alias("mood_fit"))


ENSEMBLE = """SELECT *, 0.4 * base + 0.2 * te + 0.2 * mo + 0.2 * bs AS final, greatest(base, te, mo, bs) AS top, (base + te + mo + bs) / 4 AS m FROM (
    SELECT u.user_id, u.track_id, u.score AS base, u.bridge_score AS bs, cx.score AS te,
    CASE label WHEN 'click' THEN 0.8 WHEN 'error' THEN 0.4 WHEN 'purchase' THEN 0.9 WHEN 'signup' THEN 0.7 ELSE 0.5 END AS mo FROM
    (SELECT us.*, bridge_score FROM us JOIN br USING (track_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) <= 10) u
    JOIN cx USING (user_id, track_id))"""


@query(
    "m11_ensemble_recommend",
    sql(
        """SELECT user_id, track_id, round(final, 6) AS final_score, CASE WHEN top <= 0.6 THEN 'hybrid' WHEN base = top THEN 'personality'
        WHEN te = top THEN 'temporal' WHEN mo = top THEN 'mood' ELSE 'bridge' END AS recommendation_type,
        round(1 - 2 * least(((base - m) ** 2 + (te - m) ** 2 + (mo - m) ** 2 + (bs - m) ** 2) / 4, 0.5), 6) AS confidence,
        CASE WHEN bs > 0.7 THEN 'High' WHEN bs > 0.5 THEN 'Moderate' ELSE 'Low' END AS bridge_potential FROM en""",
        "plays",
        "tracks",
        **RECS,
        **CONTEXT,
        **ARTIST,
        **CATALOGUE,
        us=UNSEEN_SCORES,
        en=ENSEMBLE,
    ),
)
def _(t):
    keys = ["user_id", "track_id"]
    base = checkpointed(best_unseen(t).select(*keys, F.col("score").alias("base_score"), "bridge_score"))
    contexts = checkpointed(latest(t))
    pairs = base.select(*keys).join(catalogue(t).select("track_id", "artist_id", "culture"), "track_id").join(contexts, "user_id")
    scored = M.contextual_scores(pairs, artist_profile(t), M.time_appropriateness(t.plays, "ts"), "artist_id", "culture", CULTURES)
    mood = pairs.select(*keys, M.mood_fit(mood_col()).alias("mood_score"))
    out = M.ensemble(base, keys, {"temporal": scored.select(*keys, F.col("score").alias("temporal_score")), "mood": mood})
    return rounded(out, "final_score", "confidence").select(*keys, "final_score", "recommendation_type", "confidence", "bridge_potential")


RECENT = "SELECT * FROM plays ORDER BY ts DESC, event_id DESC LIMIT 1000"


@query(
    "m12_system_insights",
    sql(
        """SELECT 'daily_average' AS kind, '-' AS key, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS value FROM r UNION ALL
        SELECT 'weekend_share', '-', round(avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0 END), 6) FROM r UNION ALL
        SELECT 'top_artist', CAST(artist_id AS VARCHAR), n FROM (SELECT artist_id, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, artist_id LIMIT 5)
        UNION ALL SELECT 'class_mix', label, round(count(*) / (SELECT count(*) FROM r), 6) FROM r GROUP BY 2 UNION ALL
        SELECT 'peak_hour', CAST(h AS VARCHAR), n FROM (SELECT hour(ts) AS h, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, h LIMIT 1) UNION ALL
        SELECT 'peak_day', CAST(d AS VARCHAR), n FROM (SELECT isodow(ts) - 1 AS d, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, d LIMIT 1) UNION ALL
        SELECT 'bridge', CAST(item_id AS VARCHAR), bridge_score FROM (SELECT * FROM cand ORDER BY bridge_score DESC, item_id LIMIT 5)""",
        "plays",
        "baskets",
        "tracks",
        **CAND,
        r=RECENT,
    ),
)
def _(t):
    recent = S.trailing_n_events(t.plays, [], "ts", "event_id", 1000)
    return rounded(M.system_insights(recent, "ts", "artist_id", "label", bridges=candidates(t), item="item_id"), "value")


@query("m12_system_forecasts")
def _(t):
    """The forecasts of the report: plays of the next seven days and the class ratio of the next six months."""
    from encore.plans.base import QUERIES

    plays = QUERIES["l14_volume_forecast"](t).select(F.lit("plays").alias("kind"), F.col("date").alias("key"), F.col("predicted_plays").alias("value"))
    ratio = QUERIES["l15_ratio_forecaster"](t).select(F.lit("class_ratio").alias("kind"), F.col("months_ahead").cast("string").alias("key"), F.col("predicted").alias("value"))
    return plays.unionByName(ratio)


@query(
    "m12_context_advice",
    sql(
        """SELECT event_id, CASE WHEN hour BETWEEN 6 AND 8 THEN 'Great time for energetic morning music' WHEN hour BETWEEN 9 AND 11
        THEN 'Good for focused work background music' WHEN hour BETWEEN 12 AND 13 THEN 'Perfect lunch break listening time' WHEN hour BETWEEN 14 AND 16
        THEN 'Ideal for afternoon productivity music' WHEN hour BETWEEN 17 AND 19 THEN 'Excellent evening relaxation time' WHEN hour BETWEEN 20 AND 22
        THEN 'Prime time for music exploration' ELSE 'Late night chill music recommended' END AS time_advice, CASE WHEN is_work
        THEN 'Short sessions (3-5 tracks) for work focus' WHEN is_weekend THEN 'Long sessions (20+ tracks) for weekend exploration' WHEN band = 'evening'
        THEN 'Medium sessions (10-15 tracks) for evening relaxation' ELSE 'Flexible sessions (5-10 tracks) for general listening' END AS session_advice FROM ctx""",
        "plays",
        ctx=CTX,
    ),
)
def _(t):
    return M.advice(contexts(t)).select("event_id", "time_advice", "session_advice")


@query(
    "m13_mood_extremes",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{f}' AS feature, (SELECT culture FROM pr ORDER BY {f} DESC, culture LIMIT 1) AS highest,
            (SELECT culture FROM pr ORDER BY {f}, culture LIMIT 1) AS lowest"""
            for f in ("valence", "energy")
        ),
        pl=PLAYLIST,
        pr="SELECT culture, avg(valence) AS valence, avg(energy) AS energy FROM pl GROUP BY 1",
    ),
)
def _(t):
    return M.mood_extremes(playlist(t), "culture", ["valence", "energy"])
