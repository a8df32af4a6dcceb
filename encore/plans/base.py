"""Query registry and the views of the given tables as plays, tracks and histories."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy readers over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def plays(self) -> DataFrame:
        """``events`` as a play log: the JSON property is the track, five tracks per artist."""
        track = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        return self.events.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            F.col("event_type").alias("label"),
            "value",
            track.alias("track_id"),
            F.floor(track / 5).cast("int").alias("artist_id"),
            F.round(F.col("value") * 6000).cast("long").alias("ms_played"),
        )

    @cached_property
    def tracks(self) -> DataFrame:
        """``part`` as the track dimension with features scaled to [0, 1]."""
        return self.part.select(
            F.col("p_partkey").cast("int").alias("track_id"),
            F.col("p_name").alias("track_name"),
            F.col("p_brand").alias("artist_name"),
            F.col("p_type").alias("genres"),
            (F.col("p_size") / 50).alias("energy"),
            ((F.col("p_retailprice") - 900) / 100).alias("valence"),
            ((F.col("p_size") * 7 % 50) / 50).alias("danceability"),
            ((F.col("p_partkey") % 11) / 10).alias("acousticness"),
            (F.col("p_size") * 3 + 60).cast("double").alias("tempo"),
            F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "vietnamese")
            .when(F.col("p_type").isin("STANDARD", "MEDIUM"), "western")
            .when(F.col("p_type") == "LARGE", "bridge")
            .otherwise("other")
            .alias("culture"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """``orders`` as a multi-year log."""
        return self.orders.select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderpriority").alias("label"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("value"),
        )

    @cached_property
    def baskets(self) -> DataFrame:
        """Items of the multi-year log: ``lineitem`` with the user and time of its order."""
        items = self.lineitem.select(
            F.col("l_orderkey").alias("event_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_suppkey").alias("artist_id"),
            F.col("l_quantity").alias("quantity"),
        )
        return items.join(self.history, "event_id")

    @cached_property
    def daily(self) -> DataFrame:
        """One row per date of the multi-year log; means are rounded so that equal ones tie in every engine."""
        return self.history.groupBy(F.to_date("ts").alias("date")).agg(
            F.count(F.lit(1)).alias("n_plays"),
            F.round(F.avg("value") / 100000, 9).alias("avg_value"),
            F.round(F.avg((F.col("label") == "1-URGENT").cast("double")), 9).alias("urgent_share"),
            F.round(F.avg((F.col("status") == "O").cast("double")), 9).alias("open_share"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        """The daily table unpivoted to (date, signal, x)."""
        names = ["n_plays", "avg_value", "urgent_share", "open_share"]
        pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
        return self.daily.selectExpr("date", f"stack({len(names)}, {pairs}) AS (signal, x)")


CTES = {
    "plays": """SELECT event_id, ts, user_id, event_type AS label, value,
        CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS track_id,
        CAST(regexp_extract(props, '[0-9]+') AS INTEGER) // 5 AS artist_id,
        CAST(round(value * 6000) AS BIGINT) AS ms_played FROM events""",
    "tracks": """SELECT CAST(p_partkey AS INTEGER) AS track_id, p_name AS track_name, p_brand AS artist_name,
        p_type AS genres, p_size / 50.0 AS energy, (p_retailprice - 900) / 100 AS valence,
        (p_size * 7 % 50) / 50.0 AS danceability, (p_partkey % 11) / 10.0 AS acousticness,
        CAST(p_size * 3 + 60 AS DOUBLE) AS tempo, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'vietnamese'
        WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'western' WHEN p_type = 'LARGE' THEN 'bridge' ELSE 'other' END AS culture
        FROM part""",
    "history": """SELECT o_orderkey AS event_id, o_orderdate AS ts, o_custkey AS user_id, o_orderpriority AS label,
        o_orderstatus AS status, o_totalprice AS value FROM orders""",
    "baskets": """SELECT l_orderkey AS event_id, l_partkey AS item_id, l_suppkey AS artist_id,
        l_quantity AS quantity, o_orderdate AS ts, o_custkey AS user_id, o_orderpriority AS label,
        o_orderstatus AS status, o_totalprice AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "daily": """SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_plays, round(avg(o_totalprice) / 100000, 9) AS avg_value,
        round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 9) AS urgent_share,
        round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 9) AS open_share FROM orders GROUP BY 1""",
    "signals": """SELECT date, 'n_plays' AS signal, CAST(n_plays AS DOUBLE) AS x FROM daily
        UNION ALL SELECT date, 'avg_value', avg_value FROM daily
        UNION ALL SELECT date, 'urgent_share', urgent_share FROM daily
        UNION ALL SELECT date, 'open_share', open_share FROM daily""",
    "sess": """SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (
        SELECT *, CASE WHEN lag(ts) OVER w IS NULL
            OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS is_new
        FROM plays WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
}
NEEDS = {"signals": ["daily"], "sess": ["plays"]}


def sql(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named shared views and the given extra ones (in order) before ``body``."""
    chosen: dict[str, str] = {}

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        chosen.setdefault(name, CTES[name])

    for name in names:
        add(name)
    chosen.update(extra)
    if not chosen:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in chosen.items()) + "\n" + body


def hash_sql(*cols: str, seed: int = 42) -> str:
    """``text_hash`` in the oracle's dialect."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(cols)}, '{seed}')), 1, 15))::BIGINT"


def query(key: str, oracle: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register
