"""Queries of the scalar functions (B) and the rule classifiers (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.functions import rules as R
from encore.functions import vocab
from encore.plans.base import query, sql

TS = "CAST(ts AS TIMESTAMP)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def n_of(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(w)}) AS INTEGER)" for w in words) + ")"


def in_list(col: str, words) -> str:
    return f"{col} IN (" + ", ".join(q(w) for w in words) + ")"


def first_match_sql(col: str, rules, otherwise="Other", missing="Unknown") -> str:
    whens = " ".join(f"WHEN {any_of(f'lower({col})', words)} THEN {q(label)}" for words, label in rules)
    return f"CASE WHEN {col} IS NULL THEN {q(missing)} {whens} ELSE {q(otherwise)} END"


def six(*cols):
    return [F.round(c, 6).alias(n) for n, c in cols]


@query(
    "b1_calendar_parts",
    sql(
        """SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
        month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, dayofyear(ts) AS day_of_year,
        dayname(ts) AS day_name, monthname(ts) AS month_name FROM plays""",
        "plays",
    ),
)
def _(t):
    parts = C.calendar_parts("ts")
    parts["date"] = parts["date"].cast("string")
    return t.plays.select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("b2_month_period", sql("SELECT event_id, strftime(ts, '%Y-%m') AS month FROM history", "history"))
def _(t):
    return t.history.select("event_id", C.month_period("ts").alias("month"))


BINS_SQL = """CASE WHEN h <= 6 THEN 'night' WHEN h <= 12 THEN 'morning' WHEN h <= 18 THEN 'afternoon' ELSE 'evening' END"""
BANDS_SQL = """CASE WHEN h >= 6 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 18 THEN 'afternoon'
    WHEN h >= 18 AND h < 22 THEN 'evening' ELSE 'night' END"""


@query(
    "b3_time_of_day_bins",
    sql(f"SELECT event_id, {BINS_SQL} AS time_of_day FROM (SELECT event_id, hour(ts) AS h FROM plays)", "plays"),
)
def _(t):
    return t.plays.select("event_id", C.time_of_day_bins(F.hour("ts")).alias("time_of_day"))


@query(
    "b4_time_of_day_bands",
    sql(
        f"""SELECT event_id, band, CAST(band = 'morning' AS INTEGER) AS is_morning,
        CAST(band = 'afternoon' AS INTEGER) AS is_afternoon, CAST(band = 'evening' AS INTEGER) AS is_evening,
        CAST(band = 'night' AS INTEGER) AS is_night
        FROM (SELECT event_id, {BANDS_SQL} AS band FROM (SELECT event_id, hour(ts) AS h FROM plays))""",
        "plays",
    ),
)
def _(t):
    flags = C.band_flags(F.hour("ts"))
    return t.plays.select(
        "event_id", C.time_of_day_bands(F.hour("ts")).alias("band"), *[c.alias(n) for n, c in flags.items()]
    )


@query("b5_weekend_flag", sql("SELECT event_id, isodow(ts) >= 6 AS is_weekend FROM plays", "plays"))
def _(t):
    return t.plays.select("event_id", C.weekend_flag("ts").alias("is_weekend"))


@query(
    "b6_work_hours_flag",
    sql("SELECT event_id, isodow(ts) < 6 AND hour(ts) >= 9 AND hour(ts) < 17 AS is_work FROM plays", "plays"),
)
def _(t):
    return t.plays.select("event_id", C.work_hours_flag("ts").alias("is_work"))


SEASON_SQL = """CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
    WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END"""


@query("b7_season", sql(f"SELECT event_id, {SEASON_SQL} AS season FROM history", "history"))
def _(t):
    return t.history.select("event_id", C.season(F.month("ts")).alias("season"))


@query(
    "b8_cyclical_encoding",
    sql(
        "SELECT event_id, "
        + ", ".join(
            f"round({fn}(2 * pi() * {x} / {p}), 6) AS {n}_{fn}"
            for n, x, p in [("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)]
            for fn in ("sin", "cos")
        )
        + " FROM plays",
        "plays",
    ),
)
def _(t):
    cols = []
    for name, x, period in [("hour", F.hour("ts"), 24), ("dow", F.weekday("ts"), 7), ("month", F.month("ts"), 12)]:
        s, c = C.cyclical(x, period)
        cols += [(f"{name}_sin", s), (f"{name}_cos", c)]
    return t.plays.select("event_id", *six(*cols))


@query(
    "b9_unit_conversion",
    sql("SELECT event_id, round(ms_played / 60000.0, 6) AS minutes, round(ms_played / 3600000.0, 6) AS hours FROM plays", "plays"),
)
def _(t):
    return t.plays.select("event_id", *six(("minutes", C.to_minutes("ms_played")), ("hours", C.to_hours("ms_played"))))


def with_names(t):
    """Conversations as rows with a nullable track name and episode name."""
    return t.conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("role") != "system", F.col("text")).alias("track_name"),
        F.when(F.col("role") != "assistant", F.col("role")).alias("artist_name"),
        F.when(F.col("role") == "system", F.col("text")).alias("episode_name"),
    )


@query(
    "b10_content_flags",
    """SELECT conv_id, turn, role = 'user' AS is_music, role = 'system' AS is_podcast FROM conversations""",
)
def _(t):
    return with_names(t).select(
        "conv_id",
        "turn",
        (F.col("track_name").isNotNull() & F.col("artist_name").isNotNull()).alias("is_music"),
        F.col("episode_name").isNotNull().alias("is_podcast"),
    )


@query(
    "b11_skip_flag",
    sql(
        """SELECT event_id, ms_played < 30000 OR coalesce(CASE WHEN label = 'error' THEN true
        WHEN label = 'view' THEN false END, false) AS likely_skipped FROM plays""",
        "plays",
    ),
)
def _(t):
    skipped = F.when(F.col("label") == "error", True).when(F.col("label") == "view", False)
    return t.plays.select("event_id", C.skip_flag("ms_played", skipped).alias("likely_skipped"))


@query(
    "b12_platform_category",
    f"SELECT page_id, {first_match_sql('url', vocab.PLATFORM_RULES)} AS by_url, "
    f"{first_match_sql('html', vocab.PLATFORM_RULES)} AS by_html FROM pages",
)
def _(t):
    return t.pages.select(
        "page_id", C.platform_category("url").alias("by_url"), C.platform_category("html").alias("by_html")
    )


LOC_SRC_SQL = """SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'VN' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'XX' END
    AS country, CASE WHEN c_nationkey < 22 THEN CAST(c_nationkey * 7 AS VARCHAR) || '.' || CAST(c_custkey AS VARCHAR) END AS ip
    FROM customer"""


def located_customers(t):
    n = F.col("c_nationkey")
    return t.customer.select(
        "c_custkey",
        F.when(n % 5 == 0, "VN").when(n % 5 == 1, "US").when(n % 5 == 2, "DE").when(n % 5 == 3, "XX").alias("country"),
        F.when(n < 22, F.concat((n * 7).cast("string"), F.lit("."), F.col("c_custkey").cast("string"))).alias("ip"),
    )


@query(
    "b13_location_category",
    sql(
        "SELECT c_custkey, CASE WHEN "
        + in_list("country", vocab.VN_COUNTRIES)
        + " THEN 'Vietnam' WHEN "
        + in_list("country", vocab.WESTERN_COUNTRIES)
        + " THEN 'Western' WHEN ip IS NULL THEN 'Unknown' WHEN "
        + " OR ".join(f"starts_with(ip, {q(p)})" for p in vocab.VN_IP_PREFIXES)
        + " THEN 'Vietnam' ELSE 'Other' END AS location FROM src",
        src=LOC_SRC_SQL,
    ),
)
def _(t):
    return located_customers(t).select("c_custkey", C.location_category("country", "ip").alias("location"))


@query(
    "b14_reason_category",
    f"SELECT doc_id, {first_match_sql('text', [(['tion', 'ch'], 'Playlist'), (['qu'], 'Album'), (['the'], 'Search')])} AS by_text,"
    f" {first_match_sql('source', vocab.REASON_RULES)} AS by_source FROM documents",
)
def _(t):
    rules = [(["tion", "ch"], "Playlist"), (["qu"], "Album"), (["the"], "Search")]
    return t.documents.select(
        "doc_id", C.first_matching_label("text", rules).alias("by_text"), C.reason_category("source").alias("by_source")
    )


@query(
    "b15_uri_tail",
    "SELECT page_id, list_extract(string_split(url, ':'), -1) AS tail FROM pages",
)
def _(t):
    return t.pages.select("page_id", C.uri_tail("url").alias("tail"))


@query(
    "b16_composite_key",
    """SELECT p_partkey, p_name || '_' || p_brand AS plain_key,
    replace(lower(p_name || '_' || p_brand), ' ', '_') AS lookup_key FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        C.composite_key("p_name", "p_brand").alias("plain_key"),
        C.composite_key("p_name", "p_brand", normal=True).alias("lookup_key"),
    )


TEMPO_SQL = """CASE WHEN tempo >= 0 AND tempo <= 90 THEN 'slow' WHEN tempo > 90 AND tempo <= 120 THEN 'moderate'
    WHEN tempo > 120 AND tempo <= 140 THEN 'fast' WHEN tempo > 140 AND tempo <= 200 THEN 'very_fast' END"""


@query("b17_tempo_category", sql(f"SELECT track_id, {TEMPO_SQL} AS tempo_category FROM tracks", "tracks"))
def _(t):
    return t.tracks.select("track_id", C.tempo_category("tempo").alias("tempo_category"))


@query(
    "b18_product_features",
    sql(
        """SELECT track_id, round(energy * valence, 6) AS energy_valence,
        round(danceability * energy, 6) AS dance_energy FROM tracks""",
        "tracks",
    ),
)
def _(t):
    return t.tracks.select(
        "track_id",
        *six(
            ("energy_valence", F.col("energy") * F.col("valence")),
            ("dance_energy", F.col("danceability") * F.col("energy")),
        ),
    )


@query(
    "b19_conditional_interactions",
    sql(
        """SELECT event_id, round(CASE WHEN hour(ts) BETWEEN 6 AND 12 THEN energy ELSE 0 END, 6) AS morning_score,
        round(CASE WHEN hour(ts) BETWEEN 18 AND 24 THEN valence ELSE 0 END, 6) AS evening_score,
        round(CASE WHEN energy > 0.7 THEN valence ELSE 0 END, 6) AS high_energy_score,
        round(CASE WHEN energy < 0.3 THEN valence ELSE 0 END, 6) AS low_energy_score,
        round(acousticness * danceability, 6) AS diverse_confident
        FROM plays JOIN tracks USING (track_id)""",
        "plays",
        "tracks",
    ),
)
def _(t):
    hour, energy = F.hour("ts"), F.col("energy")
    return t.plays.join(t.tracks, "track_id").select(
        "event_id",
        *six(
            ("morning_score", C.when_score(hour.between(6, 12), "energy")),
            ("evening_score", C.when_score(hour.between(18, 24), "valence")),
            ("high_energy_score", C.when_score(energy > 0.7, "valence")),
            ("low_energy_score", C.when_score(energy < 0.3, "valence")),
            ("diverse_confident", F.col("acousticness") * F.col("danceability")),
        ),
    )


@query(
    "b20_completion_rate",
    sql("SELECT event_id, round(least(greatest(ms_played / 210000.0, 0), 1), 6) AS completion FROM plays", "plays"),
)
def _(t):
    return t.plays.select("event_id", *six(("completion", C.completion_rate("ms_played"))))


@query(
    "b21_implicit_rating",
    sql(
        """SELECT user_id, track_id, round(ln(1 + sum(ms_played) / 60000.0), 6) AS rating_minutes,
        round(ln(1 + count(*)), 6) AS rating_count, 1.0::DOUBLE AS rating_unit FROM plays GROUP BY ALL""",
        "plays",
    ),
)
def _(t):
    g = t.plays.groupBy("user_id", "track_id").agg(
        F.sum("ms_played").alias("ms"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        "user_id",
        "track_id",
        *six(("rating_minutes", C.implicit_rating(C.to_minutes("ms"))), ("rating_count", C.implicit_rating("n"))),
        C.implicit_rating().alias("rating_unit"),
    )


@query(
    "b22_parse_list_string",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_type ELSE p_name || '|' || p_brand END AS genres,
    CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 2 END AS n FROM part""",
)
def _(t):
    listed = F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_brand"), F.lit("']"))
    text = F.when(F.col("p_size") % 3 == 1, F.col("p_type")).when(F.col("p_size") % 3 == 2, listed)
    arr = C.parse_list(text)
    return t.part.select("p_partkey", F.concat_ws("|", arr).alias("genres"), F.size(arr).alias("n"))


@query(
    "b23_split_trim_lower",
    """SELECT doc_id, len(parts) AS n, array_to_string(parts, '|') AS parts FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS parts
    FROM documents)""",
)
def _(t):
    parts = C.split_clean("text")
    return t.documents.select("doc_id", F.size(parts).alias("n"), F.concat_ws("|", parts).alias("parts"))


NAMES_SQL = """SELECT doc_id, CASE CAST(substr(source, 4) AS INTEGER) WHEN 0 THEN 'vpop' WHEN 1 THEN 'us-uk' WHEN 2 THEN 'gleeful'
    WHEN 3 THEN 'heartbreaking' WHEN 4 THEN 'dreamy' WHEN 5 THEN 'on_repeat' WHEN 6 THEN 'best_songs' ELSE source END AS playlist
    FROM documents"""


def playlist_name(col: str):
    names = ["vpop", "us-uk", "gleeful", "heartbreaking", "dreamy", "on_repeat", "best_songs"]
    out = F.col(col)
    for i, name in enumerate(names):
        out = F.when(F.col(col) == f"src{i}", name).otherwise(out)
    return out


@query(
    "b24_name_to_category",
    sql(
        "SELECT doc_id, CASE "
        + " ".join(f"WHEN {in_list('playlist', names)} THEN {q(c)}" for c, names in vocab.PLAYLIST_CATEGORIES.items())
        + " ELSE 'other' END AS category FROM named",
        named=NAMES_SQL,
    ),
)
def _(t):
    return t.documents.select(
        "doc_id", C.name_to_category(playlist_name("source"), vocab.PLAYLIST_CATEGORIES, "other").alias("category")
    )


@query(
    "b25_label_by_thresholds",
    sql(
        """SELECT track_id, CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium'
        WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect_d,
        CASE WHEN abs(d) >= 0.5 THEN 'large' WHEN abs(d) >= 0.3 THEN 'medium'
        WHEN abs(d) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect_r,
        CASE WHEN d > 0.7 THEN 'large' WHEN d > 0.5 THEN 'medium' WHEN d > 0.25 THEN 'small' ELSE 'negligible' END AS quality
        FROM (SELECT track_id, energy - valence AS d FROM tracks)""",
        "tracks",
    ),
)
def _(t):
    d = F.col("energy") - F.col("valence")
    return t.tracks.select(
        "track_id",
        C.effect_size_label(d).alias("effect_d"),
        C.effect_size_label(d, "correlation").alias("effect_r"),
        C.silhouette_label(d).alias("quality"),
    )


# ---- C: rule classifiers -------------------------------------------------

NAME_SQL = (
    "CASE WHEN {c} IS NULL THEN 'unknown' WHEN "
    + any_of("lower({c})", vocab.VI_INDICATORS)
    + f" OR regexp_matches(lower({{c}}), '[{vocab.VI_LETTERS}]') THEN 'vietnamese' ELSE 'western' END"
)


@query("c1_classify_by_name", f"SELECT conv_id, turn, {NAME_SQL.format(c='text')} AS culture FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", R.classify_by_name("text").alias("culture"))


def hits_sql(col: str) -> str:
    groups = [vocab.VI_A, vocab.VI_E, vocab.VI_I, vocab.VI_O, vocab.VI_U, vocab.VI_Y, vocab.VI_D]
    pats = [f"[{g}]" for g in groups]
    edge = r"[^\p{L}\p{N}_]"
    pats += [f"(^|{edge})({'|'.join(names)})({edge}|$)" for names in (vocab.VI_FAMILY_NAMES, vocab.VI_KNOWN_NAMES)]
    total = " + ".join(f"CAST(regexp_matches(lower({col}), {q(p)}) AS INTEGER)" for p in pats)
    return f"coalesce(({total}) / 9.0, 0)"


@query("c2_pattern_hit_score", f"SELECT doc_id, round({hits_sql('text')}, 6) AS score FROM documents")
def _(t):
    return t.documents.select("doc_id", *six(("score", R.pattern_hit_score("text"))))


VOCABS = (["small", "blue"], ["ring", "widget", "gear"], ["hot", "gizmo"])


def share_sql(words) -> str:
    g = "string_split(p_name, ' ')"
    return f"len(list_filter({g}, lambda g: {any_of('lower(g)', words)})) / len({g})"


def words_of(col: str):
    return F.split(F.col(col), " ")


@query(
    "c3_genre_share_scores",
    "SELECT p_partkey, "
    + ", ".join(f"round({share_sql(v)}, 6) AS share_{i}" for i, v in enumerate(VOCABS))
    + " FROM part",
)
def _(t):
    return t.part.select(
        "p_partkey", *six(*[(f"share_{i}", R.genre_share(words_of("p_name"), v)) for i, v in enumerate(VOCABS)])
    )


MARKETS = [["VN", "SG", "TH", "US"], ["VN", "US", "GB"], ["US", "DE", "FR", "CA"], ["ID", "PH", "MY"], []]
HOME = [1.1, 0.8, 0.0, 0.3, 0.0]
WEST = [0.1, 0.2, 0.4, 0.0, 0.0]


def markets_of(key: str):
    out = F.array().cast("array<string>")
    for i, codes in enumerate(MARKETS):
        if codes:
            out = F.when(F.col(key) % 5 == i, F.array(*[F.lit(c) for c in codes])).otherwise(out)
    return out


def pick_sql(key: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {key} % 5 = {i} THEN CAST({v} AS DOUBLE)" for i, v in enumerate(values)) + " END"


@query(
    "c4_market_scores",
    f"SELECT s_suppkey, {pick_sql('s_nationkey', HOME)} AS home_score, {pick_sql('s_nationkey', WEST)} AS west_score FROM supplier",
)
def _(t):
    home, west = R.market_scores(markets_of("s_nationkey"))
    return t.supplier.select("s_suppkey", *six(("home_score", home), ("west_score", west)))


def weighted_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN total > 0 THEN v0 / total ELSE v0 END AS v, CASE WHEN total > 0 THEN w0 / total ELSE w0 END AS w,
    CASE WHEN total > 0 THEN b0 / total ELSE b0 END AS b FROM (SELECT *, v0 + w0 + b0 AS total FROM (
    SELECT *, 0.4 * gb + 0.5 * least(v0, w0) AS b0 FROM (
    SELECT *, 0.3 * ling + 0.4 * gv + 0.3 * mv AS v0, 0.4 * gw + 0.3 * mw AS w0 FROM ({src}))))"""


C5_SRC = f"""SELECT p_partkey, ({hits_sql('p_brand')} + {hits_sql('p_name')}) / 2 AS ling, {share_sql(VOCABS[0])} AS gv,
    {share_sql(VOCABS[1])} AS gw, {share_sql(VOCABS[2])} AS gb, {pick_sql('p_size', HOME)} AS mv,
    {pick_sql('p_size', WEST)} AS mw FROM part"""
C5_COLS = """round(v, 6) AS vietnamese_score, round(w, 6) AS western_score, round(b, 6) AS bridge_score,
    CASE WHEN v >= w AND v >= b THEN 'vietnamese' WHEN w >= b THEN 'western' ELSE 'bridge' END AS dominant_culture,
    round(greatest(v, w, b), 6) AS confidence"""


def unpack(df, keys, struct):
    """The fields of one struct column beside the keys, doubles rounded."""
    df = df.select(*keys, struct.alias("s")).select(*keys, "s.*")
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def scored_parts(t):
    keep = ["p_partkey", "vietnamese_score", "western_score", "bridge_score", "dominant_culture", "confidence"]
    return R.add_culture_scores(
        t.part, "p_brand", "p_name", words_of("p_name"), markets_of("p_size"), VOCABS
    ).select(*keep)


@query("c5_weighted_culture_scores", sql(f"SELECT p_partkey, {C5_COLS} FROM scored", scored=weighted_sql(C5_SRC)))
def _(t):
    names = ["vietnamese_score", "western_score", "bridge_score", "confidence"]
    return scored_parts(t).select("p_partkey", "dominant_culture", *six(*[(n, F.col(n)) for n in names]))


@query(
    "c6_categorize_dataset",
    sql(
        """SELECT event_id, culture, culture = 'vietnamese' AND confidence >= 0.6 AS is_vietnamese,
        culture = 'western' AND confidence >= 0.6 AS is_western, culture = 'bridge' AND confidence >= 0.6 AS is_bridge
        FROM plays LEFT JOIN (SELECT p_partkey, CASE WHEN v >= w AND v >= b THEN 'vietnamese' WHEN w >= b THEN 'western'
        ELSE 'bridge' END AS culture, greatest(v, w, b) AS confidence FROM scored) ON p_partkey = track_id""",
        "plays",
        scored=weighted_sql(C5_SRC),
    ),
)
def _(t):
    from encore.operators.joins import categorize

    dim = scored_parts(t).withColumn("track_id", F.col("p_partkey").cast("int"))
    return categorize(t.plays, dim, "track_id").select(
        "event_id", F.col("dominant_culture").alias("culture"), "is_vietnamese", "is_western", "is_bridge"
    )


def re_alt(words) -> str:
    return "(?i)(" + "|".join(words) + ")"


C7_V = f"coalesce(regexp_matches(text, {q(re_alt(vocab.VI_PATTERN_ARTISTS))}) OR regexp_matches(text, '(?i)[{vocab.VI_LETTERS}]'), false)"
C7_W = (
    f"coalesce(regexp_matches(text, {q(re_alt(vocab.WESTERN_PATTERN_ARTISTS))}) OR "
    f"(regexp_matches(text, {q(chr(94) + '[a-zA-Z0-9' + chr(92) + 's&.' + chr(92) + '-' + chr(39) + ']+$')}) AND NOT v), false)"
)


@query(
    "c7_regex_culture_flags",
    sql(
        """SELECT conv_id, turn, CAST(v AS DOUBLE) AS vietnamese_score, CAST(w AS DOUBLE) AS western_score,
        CASE WHEN v AND w THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS bridge_score,
        CASE WHEN v AND w THEN 'bridge' WHEN w THEN 'western' WHEN v THEN 'vietnamese' ELSE 'unknown' END AS dominant_culture,
        CASE WHEN v OR w THEN 1::DOUBLE ELSE 0.1::DOUBLE END AS cultural_confidence FROM b""",
        a=f"SELECT *, {C7_V} AS v FROM conversations",
        b=f"SELECT *, {C7_W} AS w FROM a",
    ),
)
def _(t):
    return unpack(t.conversations, ["conv_id", "turn"], R.regex_flags("text"))


def label_sql(bound) -> str:
    return f"""CASE WHEN v > {bound} THEN 'vietnamese' WHEN w > {bound} THEN 'western' WHEN c > {bound} THEN 'chinese'
    ELSE 'mixed' END AS classification"""


@query(
    "c8_keyword_vote_scores",
    sql(
        f"""SELECT conv_id, turn, round(v, 6) AS vietnamese_score, round(w, 6) AS western_score,
        round(c, 6) AS chinese_score, {label_sql('0.45::DOUBLE')} FROM (SELECT conv_id, turn, v / (v + w + c) AS v, w / (v + w + c) AS w,
        c / (v + w + c) AS c FROM vote)""",
        hit=f"""SELECT conv_id, turn, lower(text) AS t, {any_of('lower(text)', vocab.VI_VOTE_ARTISTS)} AS iv,
        {any_of('lower(text)', vocab.WESTERN_VOTE_ARTISTS)} AS iw, regexp_matches(lower(text), '{R.CJK}') AS ic FROM conversations""",
        vote=f"""SELECT conv_id, turn, CAST(CASE WHEN iv THEN 0.8 WHEN iw OR ic THEN 0.0
        ELSE least(0.6, {n_of('t', vocab.VI_WORDS)} * 0.2) END AS DOUBLE) + 0.2::DOUBLE AS v,
        CAST(CASE WHEN iv THEN 0.0 WHEN iw THEN 0.8 WHEN ic THEN 0.0
        ELSE least(0.6, {n_of('t', vocab.EN_WORDS)} * 0.1) END AS DOUBLE) + 0.2::DOUBLE AS w,
        CAST(CASE WHEN ic AND NOT iv AND NOT iw THEN 0.8 ELSE 0.0 END AS DOUBLE) + 0.1::DOUBLE AS c FROM hit""",
    ),
)
def _(t):
    return unpack(t.conversations, ["conv_id", "turn"], R.keyword_votes("text", "text"))


def capped_sql(hit: str, extra: str) -> str:
    return f"least(1.0::DOUBLE, CAST(CASE WHEN {hit} THEN 0.7 ELSE 0 END AS DOUBLE) + CAST(least(0.3, {extra}) AS DOUBLE))"


@query(
    "c9_keyword_vote_scores_capped",
    sql(
        f"""SELECT conv_id, turn, round(v, 6) AS vietnamese_score, round(w, 6) AS western_score,
        round(c, 6) AS chinese_score, {label_sql('0.4::DOUBLE')} FROM (SELECT conv_id, turn,
        CASE WHEN s > 0 THEN v / s ELSE 0.33::DOUBLE END AS v, CASE WHEN s > 0 THEN w / s ELSE 0.33::DOUBLE END AS w,
        CASE WHEN s > 0 THEN c / s ELSE 0.33::DOUBLE END AS c FROM (SELECT *, v + w + c AS s FROM vote))""",
        vote="SELECT conv_id, turn, "
        + capped_sql(any_of("lower(role)", vocab.VI_CAPPED_ARTISTS), n_of("lower(text)", vocab.VI_CAPPED_WORDS) + " * 0.1")
        + " AS v, "
        + capped_sql(any_of("lower(role)", vocab.WESTERN_CAPPED_ARTISTS), n_of("lower(text)", vocab.EN_CAPPED_WORDS) + " * 0.05")
        + " AS w, "
        + capped_sql(
            f"regexp_matches(role, '{R.CJK}') OR {any_of('role', vocab.CHINESE_ARTISTS)}",
            "length(regexp_replace(text, '[^一-鿿]', '', 'g')) * 0.1",
        )
        + " AS c FROM conversations",
    ),
)
def _(t):
    return unpack(t.conversations, ["conv_id", "turn"], R.keyword_votes_capped("role", "text"))


GENRE_VOTE_SQL = """CASE WHEN {c} IS NULL THEN 'unknown' WHEN v > greatest(w, c) THEN 'vietnamese'
    WHEN w > greatest(v, c) THEN 'western' WHEN c > 0 THEN 'chinese' ELSE 'other' END"""


@query(
    "c10_genre_string_vote",
    f"""SELECT doc_id, {GENRE_VOTE_SQL.format(c='text')} AS culture FROM (SELECT doc_id, text,
    {n_of('lower(text)', vocab.VI_GENRE_PATTERNS)} AS v, {n_of('lower(text)', vocab.WESTERN_GENRE_PATTERNS)} AS w,
    {n_of('lower(text)', vocab.CHINESE_GENRE_PATTERNS)} AS c FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", R.genre_string_vote("text").alias("culture"))


@query(
    "c11_genre_string_first_match",
    f"SELECT doc_id, {first_match_sql('text', vocab.FIRST_MATCH_RULES, 'other', 'unknown')} AS culture FROM documents",
)
def _(t):
    return t.documents.select(
        "doc_id", C.first_matching_label("text", vocab.FIRST_MATCH_RULES, "other", "unknown").alias("culture")
    )


@query(
    "c12_artist_hint_buckets",
    f"""SELECT artist, plays, CASE WHEN {any_of('artist', vocab.HINT_ARTISTS)} OR regexp_matches(artist, '[{vocab.VI_LETTERS}]')
    THEN 'vietnamese' WHEN regexp_full_match(artist, '[\\x00-\\x7F]*') THEN 'western' ELSE 'unknown' END AS hint
    FROM (SELECT artist, count(*) AS plays FROM (SELECT unnest(string_split(text, ' ')) AS artist FROM documents)
    GROUP BY artist ORDER BY plays DESC, artist LIMIT 50)""",
)
def _(t):
    from encore.operators.ranking import top_k

    names = t.documents.select(F.explode(F.split("text", " ")).alias("artist"))
    return top_k(names, "artist", 50).select("artist", "plays", R.artist_hint("artist").alias("hint"))
