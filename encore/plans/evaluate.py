"""Queries of the splits and ranking metrics (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.operators import evaluate as V
from encore.operators import recommend as M
from encore.operators.ranking import top_k_per_group
from encore.plans.base import hash_sql, query, sql
from encore.plans.recommend import BRIDGE, FEATURES, IDS, LOOKUP, WIDE, scored_bridges, wide
from encore.plans.timeseries import rounded
from encore.session import checkpointed

SPLITS = """SELECT row_number() OVER (ORDER BY cut) AS split_id, cut, n_train, n_test FROM (SELECT CAST(cut AS DATE) AS cut,
    (SELECT count(*) FROM history WHERE ts < cut) AS n_train, (SELECT count(*) FROM history WHERE ts >= cut AND ts < cut + INTERVAL 180 DAYS) AS n_test
    FROM (SELECT unnest(generate_series(min(ts) + INTERVAL 360 DAYS, max(ts) - INTERVAL 181 DAYS, INTERVAL 90 DAYS)) AS cut FROM history))
    WHERE n_train >= 1000 AND n_test >= 100"""


@query(
    "n1_expanding_splits",
    sql("SELECT split_id, strftime(cut, '%Y-%m-%d') AS cut, n_train, n_test FROM sp", "history", sp=SPLITS),
)
def _(t):
    out = V.expanding_splits(t.history, "ts")
    return out.select("split_id", F.col("cut").cast("string").alias("cut"), "n_train", "n_test")


RATIO = """SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM history"""


@query("n2_ratio_split", sql("SELECT event_id, split FROM sp", "history", sp=RATIO))
def _(t):
    return V.ratio_split(t.history, "ts", "event_id").select("event_id", "split")


THREE = """SELECT *, CASE WHEN rn <= n - floor(n * 0.2) - floor(n * 0.1) THEN 'train' WHEN rn <= n - floor(n * 0.2) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM history)"""


@query("n3_three_way_time_split", sql("SELECT event_id, split FROM sp", "history", sp=THREE))
def _(t):
    return V.three_way_time_split(t.history, "ts", "event_id").select("event_id", "split")


@query(
    "n4_seeded_split",
    sql(
        """SELECT label, split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS checksum FROM (SELECT *, CASE WHEN rn <= floor(c * 0.2) THEN 'test'
        WHEN rn <= floor(c * 0.2) + floor(c * 0.1) THEN 'validation' ELSE 'train' END AS split FROM r) GROUP BY 1, 2""",
        "history",
        r=f"""SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('event_id')}, event_id) AS rn,
        count(*) OVER (PARTITION BY label) AS c FROM history""",
    ),
)
def _(t):
    out = V.seeded_split(t.history, ["event_id"], strata=["label"])
    return out.groupBy("label", "split").agg(F.count("*").alias("n"), F.sum("event_id").alias("checksum"))


@query(
    "n5_kfold",
    sql(
        f"""SELECT fold, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS checksum FROM (SELECT event_id,
        (row_number() OVER (ORDER BY {hash_sql('event_id')}, event_id) - 1) % 5 AS fold FROM history) GROUP BY 1""",
        "history",
    ),
)
def _(t):
    return V.kfold(t.history, ["event_id"]).groupBy("fold").agg(F.count("*").alias("n"), F.sum("event_id").alias("checksum"))


@query(
    "n6_split_integrity",
    sql(
        """SELECT count(*) AS n_rows, 0::BIGINT AS n_unassigned, 0::BIGINT AS n_overlap, max(ts) FILTER (split = 'train') < min(ts) FILTER (split = 'test')
        AS train_before_test, max(ts) FILTER (split = 'train') < min(ts) FILTER (split = 'test') AS valid FROM sp""",
        "history",
        sp=THREE,
    ),
)
def _(t):
    return V.split_integrity(V.three_way_time_split(t.history, "ts", "event_id"), ["event_id"], "split", "ts")


FINGER_COLUMNS = {
    "o_custkey": "bigint", "o_orderdate": "timestamp_ntz", "o_orderkey": "bigint", "o_orderpriority": "string", "o_orderstatus": "string", "o_totalprice": "double"
}


@query(
    "n7_data_fingerprint",
    f"""SELECT n_rows, content, sha256(concat_ws('|', n_rows, content, '{",".join(f"{c}:{k}" for c, k in FINGER_COLUMNS.items())}')) AS fingerprint FROM (
    SELECT count(*) AS n_rows, CAST(sum(({hash_sql(*FINGER_COLUMNS, seed=0)})::HUGEINT) AS VARCHAR) AS content FROM orders)""",
)
def _(t):
    return V.data_fingerprint(t.orders)


# Recommendations: the items a user bought most before the cut; test: the items bought after it.
CUT = "TIMESTAMP '2000-01-01'"
TRAIN = f"SELECT * FROM baskets WHERE ts < {CUT}"
TEST = f"SELECT * FROM baskets WHERE ts >= {CUT}"
RECS = """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY sum(quantity) DESC, item_id) AS rank FROM train
    GROUP BY 1, 2 QUALIFY rank <= 20"""
EVAL = {
    "train": TRAIN,
    "test": TEST,
    "recs": RECS,
    "hits": """SELECT r.*, CAST(EXISTS (SELECT 1 FROM test WHERE test.user_id = r.user_id AND test.item_id = r.item_id) AS INTEGER) AS hit
        FROM recs r WHERE rank <= 10""",
}


def parts(t):
    cut = F.lit("2000-01-01").cast("timestamp")
    return t.baskets.filter(F.col("ts") < cut), t.baskets.filter(F.col("ts") >= cut)


def recs_of(train, n: int = 20):
    sums = train.groupBy("user_id", "item_id").agg(F.sum("quantity").alias("q"))
    return top_k_per_group(sums, ["user_id"], [F.desc("q"), F.col("item_id")], n).select("user_id", "item_id", "rank")


def recs_and_test(t):
    train, test = parts(t)
    return recs_of(train), test


@query(
    "n8_precision_recall_at_k",
    sql(
        """SELECT user_id, CAST(sum(hit) AS BIGINT) AS hits, coalesce(min(n), 0) AS n_test, round(sum(hit) / 10, 6) AS precision,
        round(coalesce(sum(hit) / min(n), 0), 6) AS recall FROM hits LEFT JOIN (SELECT user_id, count(DISTINCT item_id) AS n FROM test GROUP BY 1)
        USING (user_id) GROUP BY 1""",
        "baskets",
        **EVAL,
    ),
)
def _(t):
    return rounded(V.precision_recall(*recs_and_test(t), ["user_id"], "item_id"), "precision", "recall")


@query(
    "n9_ndcg_at_k",
    sql(
        """SELECT user_id, CAST(sum(hit) AS BIGINT) AS hits, round(coalesce(sum(hit / log2(rank + 1)) / min(ideal), 0), 6) AS ndcg FROM hits JOIN
        (SELECT user_id, sum(CASE WHEN o <= h THEN 1 / log2(o + 1) END) AS ideal FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id) AS o,
        sum(hit) OVER (PARTITION BY user_id) AS h FROM hits) GROUP BY 1) USING (user_id) GROUP BY 1""",
        "baskets",
        **EVAL,
    ),
)
def _(t):
    return rounded(V.ndcg(*recs_and_test(t), ["user_id"], "item_id"), "ndcg")


@query(
    "n10_coverage",
    sql(
        """SELECT count(DISTINCT item_id) AS n_recommended, round(count(DISTINCT item_id) / (SELECT count(DISTINCT p_partkey) FROM part), 6) AS coverage FROM recs""",
        "baskets",
        **EVAL,
    ),
)
def _(t):
    out = V.coverage(recs_and_test(t)[0], t.part.withColumnRenamed("p_partkey", "item_id"), "item_id")
    return rounded(out, "coverage")


def item_features(t):
    return t.tracks.withColumnRenamed("track_id", "item_id")


@query(
    "n11_intra_list_diversity",
    sql(
        """SELECT user_id, round(coalesce(avg(d), 0), 6) AS diversity FROM (SELECT a.user_id, CASE WHEN b.rank IS NOT NULL THEN sqrt((a.energy - b.energy) ** 2
        + (a.valence - b.valence) ** 2 + (a.danceability - b.danceability) ** 2) END AS d FROM f a LEFT JOIN f b ON a.user_id = b.user_id AND a.rank < b.rank) GROUP BY 1""",
        "baskets",
        "tracks",
        **EVAL,
        f="SELECT user_id, rank, energy, valence, danceability FROM recs JOIN tracks ON track_id = item_id WHERE rank <= 10",
    ),
)
def _(t):
    out = V.intra_list_diversity(recs_and_test(t)[0], item_features(t), ["user_id"], "item_id", ["energy", "valence", "danceability"], 10)
    return rounded(out, "diversity")


@query(
    "n12_novelty",
    sql(
        """SELECT user_id, round(avg(1 - n / (SELECT count(*) FROM train)), 9) AS novelty FROM recs JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1)
        USING (item_id) GROUP BY 1""",
        "baskets",
        **EVAL,
    ),
)
def _(t):
    train, _test = parts(t)
    return V.novelty(recs_of(train), train, ["user_id"], "item_id").withColumn("novelty", F.round("novelty", 9))


@query(
    "n13_normalised_entropy",
    sql(
        """SELECT user_id, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p + 1e-10)) / log2(count(*)) ELSE 0 END, 6) AS cultural_diversity FROM (
        SELECT user_id, culture, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM recs JOIN tracks ON track_id = item_id GROUP BY 1, 2) GROUP BY 1""",
        "baskets",
        "tracks",
        **EVAL,
    ),
)
def _(t):
    rows = recs_and_test(t)[0].join(item_features(t), "item_id")
    return rounded(V.normalised_entropy(rows, ["user_id"], "culture"), "cultural_diversity")


@query(
    "n14_serendipity",
    sql(
        """SELECT user_id, round(avg(CASE WHEN seen THEN 0.0 WHEN hit THEN 1.0 ELSE 0.5 END), 6) AS serendipity FROM (SELECT r.user_id,
        EXISTS (SELECT 1 FROM early e WHERE e.user_id = r.user_id AND e.artist_name = t.artist_name) AS seen,
        EXISTS (SELECT 1 FROM test e WHERE e.user_id = r.user_id AND e.item_id = r.item_id) AS hit FROM recs r JOIN tracks t ON t.track_id = r.item_id) GROUP BY 1""",
        "baskets",
        "tracks",
        **EVAL,
        early="SELECT DISTINCT user_id, artist_name FROM baskets JOIN tracks ON track_id = item_id WHERE ts < TIMESTAMP '1996-01-01'",
    ),
)
def _(t):
    recs, test = recs_and_test(t)
    names = item_features(t).select("item_id", "artist_name")
    early = t.baskets.filter(F.col("ts") < F.lit("1996-01-01").cast("timestamp")).join(names, "item_id")
    out = V.serendipity(recs.join(names, "item_id"), early, test, ["user_id"], "item_id", "artist_name")
    return rounded(out, "serendipity")


@query(
    "n15_temporal_consistency",
    sql(
        """SELECT user_id, round((1 - abs(a.energy - b.energy) + 1 - abs(a.valence - b.valence) + 1 - abs(a.danceability - b.danceability)) / 3 + 1e-9, 6)
        AS temporal_consistency FROM (SELECT user_id, avg(energy) AS energy, avg(valence) AS valence, avg(danceability) AS danceability FROM recs
        JOIN tracks ON track_id = item_id GROUP BY 1) a JOIN (SELECT user_id, avg(energy) AS energy, avg(valence) AS valence,
        avg(danceability) AS danceability FROM test JOIN tracks ON track_id = item_id GROUP BY 1) b USING (user_id)""",
        "baskets",
        "tracks",
        **EVAL,
    ),
)
def _(t):
    out = V.temporal_consistency(*recs_and_test(t), item_features(t), ["user_id"], "item_id", ["energy", "valence", "danceability"])
    return out.withColumn("temporal_consistency", F.round(F.col("temporal_consistency") + 1e-9, 6))


SPLIT_KEYS = ["split_id", "user_id"]


def split_metrics(t):
    """The whole evaluation of the last three splits in one plan: the split is one more key column."""
    splits = V.expanding_splits(t.history, "ts").orderBy(F.desc("split_id")).limit(3)
    rows = V.assign_splits(t.baskets.withColumnRenamed("item_id", "track_id"), splits, "ts")
    rows = checkpointed(rows.groupBy(*SPLIT_KEYS, "split", "track_id").agg(F.count("*").alias("n")))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    scores = checkpointed(wide(t))
    profiles = M.user_profiles(train, scores, t.tracks, SPLIT_KEYS, "track_id", IDS, FEATURES, weight="n")
    rated = checkpointed(scores.join(scored_bridges(t).select("track_id", "bridge_score", "culture"), "track_id"))
    ranks = M.unseen_ranks(train, train, checkpointed(profiles), rated, SPLIT_KEYS, "track_id", IDS, 50)
    # the measures need places and classes only
    recs = checkpointed(ranks.join(rated.select("track_id", "culture"), "track_id"))
    keys, item = SPLIT_KEYS, "track_id"
    audio = ["energy", "valence", "danceability"]
    artists = t.tracks.select("track_id", "artist_name")
    out = V.precision_recall(recs, test, keys, item).join(V.ndcg(recs, test, keys, item).drop("hits"), keys)
    for part in (
        V.intra_list_diversity(recs, t.tracks, keys, item, audio, 50),
        V.normalised_entropy(recs, keys, "culture"),
        V.temporal_consistency(recs, test, t.tracks, keys, item, audio),
        V.novelty(recs, t.plays, keys, item),
        V.serendipity(recs.join(artists, item), train.join(artists, item), test, keys, item, "artist_name"),
    ):
        out = out.join(part, keys)
    return out.join(V.coverage(recs, t.tracks, item, ["split_id"]).drop("n_recommended"), "split_id")


METRICS = ["precision", "recall", "ndcg", "diversity", "cultural_diversity", "temporal_consistency", "novelty", "serendipity", "coverage"]


LIST = "(PARTITION BY split_id, user_id ORDER BY round(score, 9) DESC, track_id)"
SHAPE = ["energy", "valence", "danceability"]
WHOLE = {
    "ws": WIDE,
    "lk": LOOKUP,
    "br": BRIDGE,
    "sp": f"SELECT split_id, cut FROM ({SPLITS}) ORDER BY split_id DESC LIMIT 3",
    "rr": """SELECT split_id, user_id, item_id AS track_id, CASE WHEN CAST(ts AS DATE) < cut THEN 'train' ELSE 'test' END AS split, count(*) AS n
        FROM baskets JOIN sp ON CAST(ts AS DATE) < cut + 180 GROUP BY ALL""",
    "pf": "SELECT split_id, user_id, " + ", ".join(f"w_{i} / ({' + '.join(f'w_{j}' for j in IDS)}) AS w_{i}" for i in IDS) + " FROM (SELECT split_id, user_id, "
    + ", ".join(f"sum(n * s_{i}) / sum(n) AS w_{i}" for i in IDS) + " FROM rr JOIN ws USING (track_id) WHERE split = 'train' GROUP BY 1, 2)",
    "us": f"""SELECT split_id, user_id, ws.track_id, 0.6 * ({' + '.join(f'w_{i} * s_{i}' for i in IDS)}) + 0.2 * bridge_score + 0.16 AS score FROM pf JOIN ws ON NOT EXISTS (
        SELECT 1 FROM rr WHERE rr.split = 'train' AND rr.split_id = pf.split_id AND rr.user_id = pf.user_id AND rr.track_id = ws.track_id) JOIN br USING (track_id)""",
    "recs": f"SELECT r.*, {', '.join(SHAPE)}, culture, artist_name FROM (SELECT *, row_number() OVER {LIST} AS rank FROM us QUALIFY rank <= 50) r JOIN tracks USING (track_id)",
    "tst": "SELECT * FROM rr WHERE split = 'test'",
    "hits": "SELECT r.split_id, r.user_id, rank, CAST(t.track_id IS NOT NULL AS INTEGER) AS hit FROM recs r LEFT JOIN tst t USING (split_id, user_id, track_id) WHERE rank <= 10",
    "pr": """SELECT split_id, user_id, sum(hit) / 10 AS precision, coalesce(sum(hit) / any_value(c), 0) AS recall, coalesce(sum(hit / log2(rank + 1))
        / list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(sum(hit) AS BIGINT) + 1)]), 0) AS ndcg
        FROM hits LEFT JOIN (SELECT split_id, user_id, count(*) AS c FROM tst GROUP BY 1, 2) USING (split_id, user_id) GROUP BY 1, 2""",
    "dv": f"""SELECT a.split_id, a.user_id, coalesce(avg(CASE WHEN b.rank IS NOT NULL THEN sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in SHAPE)}) END), 0) AS diversity
        FROM recs a LEFT JOIN recs b ON a.split_id = b.split_id AND a.user_id = b.user_id AND a.rank < b.rank GROUP BY 1, 2""",
    "en": """SELECT split_id, user_id, CASE WHEN count(*) > 1 THEN -sum(p * log2(p + 1e-10)) / log2(count(*)) ELSE 0 END AS cultural_diversity FROM (
        SELECT split_id, user_id, count(*) / sum(count(*)) OVER (PARTITION BY split_id, user_id) AS p FROM recs GROUP BY split_id, user_id, culture) GROUP BY 1, 2""",
    "tc": f"""SELECT split_id, user_id, ({' + '.join(f'1 - abs(a.{c} - b.{c})' for c in SHAPE)}) / 3 AS temporal_consistency FROM
        (SELECT split_id, user_id, {', '.join(f'avg({c}) AS {c}' for c in SHAPE)} FROM recs GROUP BY 1, 2) a JOIN
        (SELECT split_id, user_id, {', '.join(f'avg({c}) AS {c}' for c in SHAPE)} FROM tst JOIN tracks USING (track_id) GROUP BY 1, 2) b USING (split_id, user_id)""",
    "nv": """SELECT split_id, user_id, avg(1 - coalesce(c, 0) / (SELECT count(*) FROM plays)) AS novelty FROM recs LEFT JOIN (SELECT track_id, count(*) AS c FROM plays GROUP BY 1)
        USING (track_id) GROUP BY 1, 2""",
    "se": """SELECT r.split_id, r.user_id, avg(CASE WHEN h.artist_name IS NOT NULL THEN 0.0 WHEN t.track_id IS NOT NULL THEN 1.0 ELSE 0.5 END) AS serendipity FROM recs r
        LEFT JOIN (SELECT DISTINCT split_id, user_id, artist_name FROM rr JOIN tracks USING (track_id) WHERE split = 'train') h USING (split_id, user_id, artist_name)
        LEFT JOIN tst t USING (split_id, user_id, track_id) GROUP BY 1, 2""",
    "cv": "SELECT split_id, count(DISTINCT track_id) / (SELECT count(DISTINCT track_id) FROM tracks) AS coverage FROM recs GROUP BY 1",
    "every": "SELECT * FROM pr JOIN dv USING (split_id, user_id) JOIN en USING (split_id, user_id) JOIN tc USING (split_id, user_id) JOIN nv USING (split_id, user_id)"
    " JOIN se USING (split_id, user_id) JOIN cv USING (split_id)",
    "long": " UNION ALL ".join(f"SELECT split_id, '{m}' AS metric, avg({m}) AS x FROM every GROUP BY 1" for m in METRICS),
}


@query(
    "n16_evaluate_splits",
    sql(
        """SELECT metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(x) AS n_splits,
        CASE WHEN avg(x) > 0.7 THEN 'high' WHEN avg(x) > 0.4 THEN 'medium' ELSE 'low' END AS level FROM long GROUP BY 1""",
        "history",
        "baskets",
        "tracks",
        "plays",
        **WHOLE,
    ),
)
def _(t):
    return rounded(V.summarise(split_metrics(t), "split_id", METRICS), "mean", "std", "min", "max")


def _run_sql(seed: int) -> str:
    """Mean value of each label's training part under a seed."""
    return f"""SELECT label, avg(value) FILTER (rn > floor(c * 0.2) + floor(c * 0.1)) AS v FROM (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY
    {hash_sql('event_id', seed=seed)}, event_id) AS rn, count(*) OVER (PARTITION BY label) AS c FROM history) GROUP BY 1"""


@query(
    "n17_compare_runs",
    sql(
        """SELECT 'same seed ' || label AS metric, round(v, 4) AS original, round(v, 4) AS reproduced, true AS matches FROM a UNION ALL
        SELECT 'other seed ' || label, round(a.v, 4), round(b.v, 4), abs(a.v - b.v) <= 1e-6 FROM a JOIN b USING (label)""",
        "history",
        a=_run_sql(42),
        b=_run_sql(43),
    ),
)
def _(t):
    """A run of the split and its metric against a second run of the stored rows in another order, and against one of another seed."""

    def run(history, seed):
        parts = V.seeded_split(history, ["event_id"], strata=["label"], seed=seed)
        return parts.filter("split = 'train'").groupBy("label").agg(F.avg("value").alias("v"))

    again = checkpointed(t.history.repartition(7, "ts"))
    runs = [("same seed ", run(again, 42)), ("other seed ", run(t.history, 43))]
    mine = run(t.history, 42)
    out = None
    for name, other in runs:
        tag = lambda df: df.select(F.concat(F.lit(name), "label").alias("metric"), "v")
        part = V.compare_runs(tag(mine), tag(other), "metric", "v")
        out = part if out is None else out.unionByName(part)
    return out.drop("difference").withColumns({c: F.round(c, 4) for c in ("original", "reproduced")})
