"""Queries of the sources and sinks (A). Files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.plans.base import query, sql
from encore.session import scratch_folder
from encore.sources import readers as R
from encore.sources import writers as W


def exported(t):
    """The play log in the layout of an export record, some fields missing or unparsable."""
    error = F.col("label") == "error"
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.plays.select(
        F.floor(F.col("event_id") / 1000).alias("part"),
        F.when(F.col("value") < 0.3, "not a time").otherwise(stamp).alias("ts"),
        F.when(~error, F.col("ms_played")).alias("ms_played"),
        F.when(~error, F.concat(F.lit("ios "), "label")).alias("platform"),
        F.concat(F.lit("track "), F.col("track_id")).alias("master_metadata_track_name"),
        F.concat(F.lit("artist "), F.col("artist_id")).alias("master_metadata_album_artist_name"),
        F.concat(F.lit("x:track:"), F.col("track_id")).alias("spotify_track_uri"),
        F.when(F.col("label") != "view", F.col("value") < 5).alias("skipped"),
    )


PARSED = """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS played_at, CASE WHEN label = 'error' THEN 0 ELSE ms_played END AS ms_played,
    CASE WHEN label = 'error' THEN 'Unknown' ELSE 'ios ' || label END AS platform, 'Unknown' AS conn_country, 'track ' || track_id AS track_name,
    'artist ' || artist_id AS artist_name, CASE WHEN label = 'view' THEN 'none' WHEN value < 5 THEN 'true' ELSE 'false' END AS skipped FROM plays WHERE value >= 0.3"""


def shown(df):
    return df.select(
        F.date_format("played_at", "yyyy-MM-dd HH:mm:ss").alias("played_at"), "ms_played", "platform", "conn_country", "track_name", "artist_name",
        F.coalesce(F.col("skipped").cast("string"), F.lit("none")).alias("skipped"),
    )


def write_json_arrays(df, path, part):
    """Input of the history reader: one JSON array per value of ``part``, which cuts the rows into small pieces."""
    cols = [c for c in df.columns if c != part]
    arrays = df.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*cols))).alias("value"))
    arrays.write.mode("overwrite").partitionBy(part).text(path)


@query("a1_read_history_json", sql(PARSED, "plays"))
def _(t):
    folder = scratch_folder(t.spark)
    write_json_arrays(exported(t), folder, "part")
    return shown(R.parse_history(R.read_history_json(t.spark, folder, "part-*")))


@query("a2_parse_history_record", sql(PARSED, "plays"))
def _(t):
    records = exported(t).select(F.to_json(F.struct("*")).alias("j"))
    raw = records.select(F.from_json("j", R.HISTORY_SCHEMA).alias("r")).select("r.*")
    return shown(R.parse_history(raw))


@query(
    "a3_spread_audio_map",
    sql(
        """SELECT track_id, coalesce(CASE WHEN energy > 0.3 THEN energy END, -1) AS audio_energy, valence AS audio_valence, tempo AS audio_tempo FROM tracks""",
        "tracks",
    ),
)
def _(t):
    entries = F.map_filter(
        F.create_map(F.lit("energy"), "energy", F.lit("valence"), "valence", F.lit("tempo"), "tempo"), lambda k, v: (k != "energy") | (v > 0.3)
    )
    out = R.spread_map(t.tracks.select("track_id", entries.alias("audio")), "audio", ["energy", "valence", "tempo"])
    return out.withColumn("audio_energy", F.coalesce("audio_energy", F.lit(-1.0)))


@query(
    "a4_flatten_play_item",
    """SELECT l_orderkey AS event_id, CAST(l_partkey AS VARCHAR) AS track_id, p_name AS track_name, 's' || l_suppkey AS artist_id, p_brand AS artist_name,
    p_type AS album_name, CAST(l_quantity * 1000 AS BIGINT) AS duration_ms, p_size AS popularity, l_returnflag = 'R' AS explicit,
    CASE WHEN l_linestatus = 'O' THEN 'VN,US' ELSE '' END AS markets FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def _(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    artists = F.array(
        F.struct(F.concat(F.lit("s"), "l_suppkey").alias("id"), F.col("p_brand").alias("name")), F.struct(F.lit("x").alias("id"), F.lit("guest").alias("name"))
    )
    track = F.struct(
        F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), artists.alias("artists"),
        F.struct(F.lit("a").alias("id"), F.col("p_type").alias("name")).alias("album"), (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"),
        F.col("p_size").alias("popularity"), (F.col("l_returnflag") == "R").alias("explicit"),
        F.when(F.col("l_linestatus") == "O", F.array(F.lit("VN"), F.lit("US"))).alias("available_markets"),
    )
    items = rows.select(F.col("l_orderkey").alias("event_id"), F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("played_at"), track.alias("track"))).alias("j"))
    out = R.flatten_play_items(items, "j", ["event_id"])
    return out.select(
        "event_id", "track_id", "track_name", "artist_id", "artist_name", "album_name", "duration_ms", "popularity", "explicit",
        F.concat_ws(",", "markets").alias("markets"),
    )


@query(
    "a5_flatten_artist_item",
    """SELECT CAST(l_suppkey AS VARCHAR) AS artist_id, s_name AS artist_name, 'pop,rock' AS genres, CAST(s_nationkey AS INTEGER) AS popularity,
    CAST(s_acctbal AS BIGINT) AS followers FROM (SELECT DISTINCT l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey""".replace(
        "CAST(s_acctbal AS BIGINT)", "CAST(trunc(s_acctbal) AS BIGINT)"
    ),
)
def _(t):
    rows = t.lineitem.select("l_suppkey").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    artist = F.struct(
        F.col("l_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.array(F.lit("pop"), F.lit("rock")).alias("genres"),
        F.col("s_nationkey").alias("popularity"), F.struct(F.col("s_acctbal").cast("long").alias("total")).alias("followers"),
    )
    out = R.flatten_artist_items(rows.select(F.to_json(artist).alias("j")), "j")
    return out.select("artist_id", "artist_name", F.concat_ws(",", "genres").alias("genres"), "popularity", "followers")


CSV_SCHEMA = T.StructType(
    [T.StructField("Track Name", T.StringType()), T.StructField("Artist Name(s)", T.StringType()), T.StructField("Added At", T.StringType()), T.StructField("Valence", T.DoubleType())]
)


@query(
    "a6_read_playlists_csv",
    """SELECT p_type AS playlist_name, p_name AS track_name, p_brand AS artist_name, CASE WHEN p_size > 25 THEN '2024-01-02 03:04:05' ELSE 'none' END AS added_at,
    p_size / 50.0 AS valence FROM part""",
)
def _(t):
    folder = scratch_folder(t.spark)
    rows = t.part.select(
        "p_type", F.col("p_name").alias("Track Name"), F.col("p_brand").alias("Artist Name(s)"),
        F.when(F.col("p_size") > 25, "2024-01-02T03:04:05Z").otherwise("someday").alias("Added At"), (F.col("p_size") / 50).alias("Valence"),
    )
    rows.write.partitionBy("p_type").option("header", True).csv(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), "p_type=([^/]+)/", 1)
    out = R.read_playlists_csv(t.spark, folder, CSV_SCHEMA, name)
    return out.select(
        "playlist_name", F.col("Track Name").alias("track_name"), F.col("Artist Name(s)").alias("artist_name"),
        F.coalesce(F.date_format("Added At", "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("added_at"), F.col("Valence").alias("valence"),
    )


@query(
    "a7_read_events_parquet",
    "SELECT event_type, count(*) AS n, count(*) FILTER (ts IS NULL) AS n_invalid, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY 1",
)
def _(t):
    rows = R.read_events_parquet(t.spark, f"{t.folder}/events.parquet", "ts")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("n_invalid"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts")
    )


MONTHLY = """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"""


def monthly(rows, month):
    return rows.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "a8_read_result_json",
    f"SELECT 'month=2001-08' AS name, CAST(n AS BIGINT) AS n, total FROM ({MONTHLY}) WHERE month = '2001-08'",
)
def _(t):
    folder = scratch_folder(t.spark)
    rows = monthly(t.orders, F.date_format("o_orderdate", "yyyy-MM"))
    rows.repartition("month").write.partitionBy("month").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), "/(month=[^/]+)/", 1)
    latest = R.read_latest_result(t.spark, folder).select("payload", name.alias("name"))
    return latest.select("name", F.from_json("payload", "n bigint, total double").alias("r")).select("name", "r.n", "r.total")


@query("a9_write_parquet", MONTHLY)
def _(t):
    path = scratch_folder(t.spark)
    W.write_parquet(t.orders, path, "o_orderdate")
    return monthly(t.spark.read.parquet(path), F.col("month").cast("string"))


@query("a10_write_csv", "SELECT c_custkey, c_name, c_mktsegment, '[\"' || c_mktsegment || '\"]' AS tags FROM customer")
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.array("c_mktsegment").alias("tags"))
    paths = W.write_csv({"customers": rows}, scratch_folder(t.spark), "20240101_000000")
    schema = "c_custkey bigint, c_name string, c_mktsegment string, tags string"
    return t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(paths["customers"])


@query("a11_write_json_report", MONTHLY)
def _(t):
    path = scratch_folder(t.spark)
    W.write_json_report(monthly(t.orders, F.date_format("o_orderdate", "yyyy-MM")), path)
    return t.spark.read.schema("month string, n bigint, total double").json(path)


@query(
    "a12_save_load_model",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity)
    FROM lineitem) * l_quantity, 3) AS prediction FROM lineitem""",
)
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = [VectorAssembler(inputCols=["l_quantity"], outputCol="features"), LinearRegression(labelCol="l_extendedprice", solver="normal")]
    path = scratch_folder(t.spark)
    W.save_model(Pipeline(stages=stages).fit(t.lineitem), path)
    scored = W.load_model(path).transform(t.lineitem)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 3).alias("prediction"))
