"""Queries of the join operators (E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.operators import joins as J
from encore.operators import ranking as K
from encore.plans.base import query, sql
from encore.plans.scalar import six


@query(
    "e1_attach_features",
    sql(
        """SELECT event_id, p.track_id, round(energy, 6) AS energy, round(coalesce(valence, -1), 6) AS valence,
        f.label AS label_dim FROM plays p LEFT JOIN feats f ON p.track_id = f.track_id""",
        "plays",
        "tracks",
        feats="SELECT track_id, energy, valence, genres AS label FROM tracks WHERE energy > 0.1",
    ),
)
def _(t):
    dim = t.tracks.filter("energy > 0.1").select("track_id", "energy", "valence", F.col("genres").alias("label"))
    out = J.attach_features(t.plays, dim, "track_id")
    return out.select(
        "event_id",
        "track_id",
        "label_dim",
        *six(("energy", F.col("energy")), ("valence", F.coalesce("valence", F.lit(-1.0)))),
    )


@query(
    "e2_attach_genres",
    """SELECT l_orderkey, l_linenumber, coalesce(array_to_string(string_split(p_name, ' '), '|'), '') AS genres
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def _(t):
    genres = t.part.select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("genres"))
    out = J.attach_features(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), genres, "l_partkey")
    return out.select("l_orderkey", "l_linenumber", F.coalesce(F.concat_ws("|", "genres"), F.lit("")).alias("genres"))


@query(
    "e3_attach_group_stats",
    sql(
        """SELECT event_id, n_tracks, n_plays, round(mean_value + 1e-9, 6) AS mean_value FROM plays JOIN (SELECT user_id,
        count(DISTINCT track_id) AS n_tracks, count(*) AS n_plays, avg(value) AS mean_value FROM plays GROUP BY 1) USING (user_id)""",
        "plays",
    ),
)
def _(t):
    aggs = [
        F.countDistinct("track_id").alias("n_tracks"),
        F.count(F.lit(1)).alias("n_plays"),
        F.round(F.avg("value") + 1e-9, 6).alias("mean_value"),
    ]
    return J.attach_group_stats(t.plays, ["user_id"], aggs).select("event_id", "n_tracks", "n_plays", "mean_value")


@query(
    "e4_attach_new_columns_only",
    sql(
        """SELECT event_id, label, user_id, segment FROM history LEFT JOIN (SELECT c_custkey, c_mktsegment AS segment
        FROM customer) ON c_custkey = user_id""",
        "history",
    ),
)
def _(t):
    dim = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("segment")
    )
    return J.attach_new_columns_only(t.history, dim, "user_id").select("event_id", "label", "user_id", "segment")


@query(
    "e5_inner_feature_join",
    sql(
        """SELECT k.track_id, k.plays, round(energy, 6) AS energy, round(valence, 6) AS valence FROM tracks JOIN (
        SELECT track_id, count(*) AS plays FROM plays GROUP BY 1 HAVING count(DISTINCT label) = 5) k USING (track_id)""",
        "plays",
        "tracks",
    ),
)
def _(t):
    wide = t.plays.groupBy("track_id").agg(F.count(F.lit(1)).alias("plays"), F.countDistinct("label").alias("n"))
    bridges = wide.filter("n = 5").select("track_id", "plays")
    return bridges.join(t.tracks, "track_id").select(
        "track_id", "plays", *six(("energy", F.col("energy")), ("valence", F.col("valence")))
    )


@query(
    "e6_membership_semijoin",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)",
)
def _(t):
    keys = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return J.membership(t.lineitem, keys, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query(
    "e7_unseen_candidates",
    """SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-09-01'
    AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01')""",
)
def _(t):
    later = t.lineitem.filter("l_shipdate >= TIMESTAMP_NTZ '2001-09-01'").select("l_partkey")
    early = t.lineitem.filter("l_shipdate < TIMESTAMP_NTZ '1995-06-01'").select("l_partkey")
    return J.unseen(later, early, ["l_partkey"])


SHIFTS = """SELECT date, urgent_share FROM daily WHERE urgent_share > (SELECT avg(urgent_share) + 2.5 * stddev_pop(urgent_share) FROM daily)"""


def shifts(t):
    stats = t.daily
    bound = stats.select(F.avg("urgent_share") + 2.5 * F.stddev_pop("urgent_share")).scalar()
    return t.daily.filter(F.col("urgent_share") > bound)


@query(
    "e8_events_near_change_points",
    sql(
        """SELECT strftime(s.date, '%Y-%m-%d') AS change_date, o_orderkey AS event_id,
        CAST(CAST(o_orderdate AS DATE) - s.date AS BIGINT) AS day_diff
        FROM shifts s JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN s.date - 7 AND s.date + 7 WHERE o_totalprice > 480000""",
        "daily",
        shifts=SHIFTS,
    ),
)
def _(t):
    points = shifts(t).select(F.col("date").alias("change_date"))
    life = t.history.filter("value > 480000").select(F.to_date("ts").alias("event_date"), "event_id")
    out = J.within_days(points, life, "change_date", "event_date", 7)
    return out.select(F.col("change_date").cast("string").alias("change_date"), "event_id", "day_diff")


BEFORE_AFTER_SQL = """SELECT s.date AS shift_date, count(*) FILTER (d.date < s.date) AS n_before,
    count(*) FILTER (d.date > s.date) AS n_after, avg(d.avg_value) FILTER (d.date < s.date) AS value_before,
    avg(d.avg_value) FILTER (d.date > s.date) AS value_after, avg(d.urgent_share) FILTER (d.date < s.date) AS urgent_before,
    avg(d.urgent_share) FILTER (d.date > s.date) AS urgent_after
    FROM shifts s JOIN daily d ON d.date BETWEEN s.date - 14 AND s.date + 14 GROUP BY 1"""


@query(
    "e9_context_before_after",
    sql(
        """SELECT strftime(shift_date, '%Y-%m-%d') AS shift_date, round(value_before, 4) AS value_before,
        round(value_after, 4) AS value_after, round(CASE WHEN value_before <> 0 THEN (value_after - value_before) / value_before * 100
        ELSE 0 END, 6) AS value_pct, round(CASE WHEN urgent_before <> 0 THEN (urgent_after - urgent_before) / urgent_before * 100
        ELSE 0 END, 6) AS urgent_pct FROM ctx WHERE n_before > 0 AND n_after > 0""",
        "daily",
        shifts=SHIFTS,
        ctx=BEFORE_AFTER_SQL,
    ),
)
def _(t):
    points = shifts(t).select(F.col("date").alias("shift_date"))
    out = J.context_before_after(t.daily, points, "date", "shift_date", ["avg_value", "urgent_share"])
    return out.select(
        F.col("shift_date").cast("string").alias("shift_date"),
        F.round("avg_value_before", 4).alias("value_before"),
        F.round("avg_value_after", 4).alias("value_after"),
        F.round("avg_value_pct", 6).alias("value_pct"),
        F.round("urgent_share_pct", 6).alias("urgent_pct"),
    )


@query(
    "e10_recency_penalty_join",
    sql(
        """SELECT event_id, coalesce(n, 0) AS nearby FROM history LEFT JOIN (SELECT o.date AS d, count(*) AS n FROM
        (SELECT DISTINCT date FROM daily) o JOIN recent s ON abs(o.date - s.date) < 30 GROUP BY 1) ON d = CAST(ts AS DATE)""",
        "history",
        "daily",
        recent=f"SELECT date FROM ({SHIFTS}) WHERE DATE '2001-08-01' - date < 900",
    ),
)
def _(t):
    recent = shifts(t).filter(F.datediff(F.lit("2001-08-01").cast("date"), "date") < 900).select(F.col("date").alias("cp"))
    plays = t.history.select("event_id", F.to_date("ts").alias("play_date"))
    return J.nearby_count(plays, recent, "play_date", "cp", 30).select("event_id", "nearby")


PROFILES = [
    {"personality": "calm", "energy": 0.3, "valence": 0.4},
    {"personality": "lively", "energy": 0.8, "valence": 0.7},
    {"personality": "mixed", "energy": 0.5, "valence": 0.5},
]


@query(
    "e11_score_cross_join",
    sql(
        """SELECT track_id, personality, round(0.4 * (1 - abs(pe - energy)) + 0.4 * (1 - abs(pv - valence)), 6) AS score
        FROM tracks, (VALUES ('calm', 0.3, 0.4), ('lively', 0.8, 0.7), ('mixed', 0.5, 0.5)) p(personality, pe, pv)""",
        "tracks",
    ),
)
def _(t):
    out = J.score_each(t.tracks, PROFILES)
    p = F.col("profile")
    fit = 0.4 * (1 - F.abs(p["energy"] - F.col("energy"))) + 0.4 * (1 - F.abs(p["valence"] - F.col("valence")))
    return out.select("track_id", p["personality"].alias("personality"), *six(("score", fit)))


MONTHS_A = "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS plays FROM history GROUP BY 1"
MONTHS_B = "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS added FROM lineitem GROUP BY 1"


def two_months(t):
    a = t.history.groupBy(C.month_period("ts").alias("month")).agg(F.count(F.lit(1)).alias("plays"))
    b = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("added"))
    return a, b


@query(
    "e12_month_align_outer",
    sql(
        "SELECT month, coalesce(plays, 0) AS plays, coalesce(added, 0) AS added FROM a FULL JOIN b USING (month)",
        "history",
        a=MONTHS_A,
        b=MONTHS_B,
    ),
)
def _(t):
    return J.align_outer(*two_months(t), "month")


@query(
    "e12_month_align_inner",
    sql("SELECT month, plays, added FROM a JOIN b USING (month)", "history", a=MONTHS_A, b=MONTHS_B),
)
def _(t):
    a, b = two_months(t)
    return a.join(b, "month")


@query(
    "e13_consecutive_period_pairs",
    sql(
        """SELECT a.p AS period, a.item_id, a.x, b.x AS y FROM m a JOIN m b ON a.item_id = b.item_id AND a.p + 1 = b.p""",
        "baskets",
        m="SELECT year(ts) * 12 + month(ts) AS p, item_id, sum(quantity) AS x FROM baskets GROUP BY ALL",
    ),
)
def _(t):
    period = (F.year("ts") * 12 + F.month("ts")).alias("p")
    monthly = t.baskets.groupBy(period, "item_id").agg(F.sum("quantity").alias("x"))
    return J.consecutive_pairs(monthly, "item_id", "p", "x")


BRIDGE_SQL = """SELECT lower(p_name || '_' || p_brand) AS key, max(p_size) AS score FROM part WHERE p_size > 30 GROUP BY 1"""


@query(
    "e14_bridge_lookup",
    sql(
        """SELECT p_partkey, round(coalesce(score / 10.0, p_size / 100.0), 6) AS bridge_score FROM part
        LEFT JOIN bridges ON key = lower(p_name || '_' || p_brand)""",
        bridges=BRIDGE_SQL,
    ),
)
def _(t):
    key = F.lower(C.composite_key("p_name", "p_brand"))
    bridges = t.part.filter("p_size > 30").groupBy(key.alias("key")).agg(F.max("p_size").alias("score"))
    out = t.part.withColumn("key", key).join(bridges, "key", "left")
    return out.select("p_partkey", *six(("bridge_score", F.coalesce(F.col("score") / 10, F.col("p_size") / 100))))


@query(
    "e15_pairwise_distance",
    sql(
        """SELECT a.brand, round(sum(sqrt((a.energy - b.energy) ** 2 + (a.valence - b.valence) ** 2)) / count(*), 6) AS distance
        FROM top a JOIN top b ON a.brand = b.brand AND a.rn < b.rn GROUP BY 1""",
        "tracks",
        top="""SELECT artist_name AS brand, energy, valence, row_number() OVER (PARTITION BY artist_name ORDER BY energy DESC, track_id)
        AS rn FROM tracks QUALIFY rn <= 10""",
    ),
)
def _(t):
    top = K.top_k_per_group(t.tracks, ["artist_name"], [F.desc("energy"), F.col("track_id")], 10)
    lists = top.groupBy(F.col("artist_name").alias("brand")).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.array("energy", "valence").alias("v")))).alias("rows")
    )
    return lists.select("brand", *six(("distance", J.mean_pairwise_distance(F.transform("rows", lambda r: r["v"])))))


@query(
    "e16_new_top_k_vs_previous_year",
    sql(
        """SELECT year, item_id, rn AS rank FROM ranked a WHERE rn <= 5 AND year > (SELECT min(year) FROM ranked) AND NOT EXISTS (SELECT 1 FROM ranked b
        WHERE b.item_id = a.item_id AND b.year = a.year - 1 AND b.rn <= 10)""",
        "baskets",
        ranked="""SELECT year(ts) AS year, item_id, row_number() OVER (PARTITION BY year(ts) ORDER BY count(*) DESC, item_id) AS rn
        FROM baskets GROUP BY 1, 2""",
    ),
)
def _(t):
    counts = t.baskets.groupBy(F.year("ts").alias("year"), "item_id").agg(F.count(F.lit(1)).alias("n"))
    top10 = K.top_k_per_group(counts, ["year"], [F.desc("n"), F.col("item_id")], 10)
    first = top10.select(F.min("year")).scalar()
    previous = top10.select((F.col("year") + 1).alias("year"), "item_id")
    return top10.filter((F.col("rank") <= 5) & (F.col("year") > first)).join(previous, ["year", "item_id"], "left_anti").select("year", "item_id", "rank")


TOP_ARTISTS = [{"name": "ring", "plays": 90}, {"name": "RED", "plays": 150}, {"name": "widget", "plays": 20}]


@query(
    "e17_first_n_items_match",
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 90 WHEN contains(lower(p_name), 'red') THEN 150
    WHEN contains(lower(p_name), 'widget') THEN 20 ELSE 0 END AS plays FROM part""",
)
def _(t):
    names = F.array(*[F.struct(F.lit(a["name"]).alias("name"), F.lit(a["plays"]).alias("plays")) for a in TOP_ARTISTS])
    hit = J.first_contained("p_name", names)
    return t.part.select("p_partkey", F.coalesce(hit["plays"], F.lit(0)).alias("plays"))
