"""Sources (A1-A8): JSON histories, nested API items, CSV playlists, parquet logs, result files."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of one exported play record.
HISTORY_FIELDS = [
    ("ts", "string"), ("ms_played", "bigint"), ("platform", "string"), ("conn_country", "string"), ("ip_addr", "string"),
    ("master_metadata_track_name", "string"), ("master_metadata_album_artist_name", "string"),
    ("master_metadata_album_album_name", "string"), ("spotify_track_uri", "string"), ("episode_name", "string"),
    ("episode_show_name", "string"), ("spotify_episode_uri", "string"), ("reason_start", "string"),
    ("reason_end", "string"), ("shuffle", "boolean"), ("skipped", "boolean"), ("offline", "boolean"),
    ("offline_timestamp", "bigint"), ("incognito_mode", "boolean"), ("audio_features", "map<string,double>"),
]
HISTORY_SCHEMA = ", ".join(f"{n} {k}" for n, k in HISTORY_FIELDS)
HISTORY_PATTERN = "Streaming_History_Audio_*.json"

# Short names of the record fields that are renamed.
RENAMED = {
    "ts": "played_at",
    "master_metadata_track_name": "track_name",
    "master_metadata_album_artist_name": "artist_name",
    "master_metadata_album_album_name": "album_name",
    "spotify_track_uri": "track_uri",
    "spotify_episode_uri": "episode_uri",
}
# Defaults of absent fields.
DEFAULTS = {"ms_played": 0, "platform": "Unknown", "conn_country": "Unknown", "ip_addr": ""}


def matching_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths below the folder whose names match; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(folder).select("path", "length")


def read_history_json(spark: SparkSession, folder: str, pattern: str = HISTORY_PATTERN) -> DataFrame:
    """All history files of a folder, each one JSON array; an unreadable file is skipped, no match is an error."""
    if matching_files(spark, folder, pattern).isEmpty():
        raise FileNotFoundError(f"no file matches {pattern} in {folder}")
    reader = spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
    reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return reader.json(folder)


def parse_history(raw: DataFrame) -> DataFrame:
    """Renamed and defaulted fields with a UTC timestamp; records without a valid time are dropped."""
    cols = []
    for name, _ in HISTORY_FIELDS:
        col = F.col(name)
        if name == "ts":
            col = F.try_to_timestamp(name)
        elif name in DEFAULTS:
            col = F.coalesce(col, F.lit(DEFAULTS[name]))
        cols.append(col.alias(RENAMED.get(name, name)))
    return raw.select(*cols).filter(F.col("played_at").isNotNull())


def spread_map(df: DataFrame, col: str, keys: Sequence[str], prefix: str = "audio_") -> DataFrame:
    """Declared map entries as ``<prefix><key>`` columns; for keys that are not known beforehand see ``map_rows``."""
    return df.select(*[c for c in df.columns if c != col], *[F.try_element_at(col, F.lit(k)).alias(prefix + k) for k in keys])


def map_rows(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """Every entry of a map as a row (kept columns, key, value), whatever its keys."""
    return df.select(*keep, F.explode(col).alias("key", "value"))


PLAY_ITEM = (
    "struct<played_at:string,track:struct<id:string,name:string,artists:array<struct<id:string,name:string>>,"
    "album:struct<id:string,name:string,release_date:string>,duration_ms:bigint,popularity:int,explicit:boolean,"
    "preview_url:string,available_markets:array<string>,external_urls:map<string,string>>>"
)
ARTIST_ITEM = (
    "struct<id:string,name:string,genres:array<string>,popularity:int,followers:struct<total:bigint>,external_urls:map<string,string>>"
)


def flatten_play_items(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested play record (JSON text) to flat columns; the first artist only; absent lists and maps are empty."""
    item = df.select(*keep, F.from_json(col, PLAY_ITEM).alias("i"))
    t = F.col("i.track")
    artist = F.get(t["artists"], F.lit(0))
    return item.select(
        *keep, F.col("i.played_at").alias("played_at"), t["id"].alias("track_id"), t["name"].alias("track_name"),
        artist["id"].alias("artist_id"), artist["name"].alias("artist_name"), t["album"]["id"].alias("album_id"),
        t["album"]["name"].alias("album_name"), t["duration_ms"].alias("duration_ms"), t["popularity"].alias("popularity"),
        t["explicit"].alias("explicit"), t["preview_url"].alias("preview_url"), t["album"]["release_date"].alias("release_date"),
        F.coalesce(t["available_markets"], F.array().cast("array<string>")).alias("markets"),
        F.coalesce(t["external_urls"], F.create_map().cast("map<string,string>")).alias("external_urls"),
    )


def flatten_artist_items(df: DataFrame, col: str) -> DataFrame:
    """Artist record (JSON text) to columns, one row per artist id."""
    a = df.select(F.from_json(col, ARTIST_ITEM).alias("a")).select("a.*").filter(F.col("id").isNotNull())
    out = a.select(
        F.col("id").alias("artist_id"), F.col("name").alias("artist_name"), "genres", "popularity",
        F.col("followers.total").alias("followers"),
        F.coalesce("external_urls", F.create_map().cast("map<string,string>")).alias("external_urls"),
    )
    return out.dropDuplicates(["artist_id"])


PLAYLIST_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Track Name", "Artist Name(s)", "Genres", "Added At")]
    + [T.StructField(c, T.DoubleType()) for c in ("Valence", "Energy", "Danceability", "Acousticness", "Speechiness", "Liveness", "Loudness", "Tempo")]
)


def file_stem() -> Column:
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))  # names come percent-encoded
    return F.regexp_extract(name, r"^(.+?)(?:\.[^.]*)?$", 1)


def read_playlists_csv(
    spark: SparkSession, folder: str, schema: T.StructType | None = None, name: Column | None = None, max_files: int | None = None, mixed_headers: bool = False
) -> DataFrame:
    """Union of the CSV files of a folder with ``playlist_name`` from the file name and a coerced ``Added At``.

    Files of one layout are one scan. With ``mixed_headers`` one pass over the first
    lines groups the files by header, each header is one scan, and the scans are
    joined by column name (all text).
    """
    label = file_stem() if name is None else name
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
    reader = reader.option("ignoreCorruptFiles", "true").option("multiLine", True).option("escape", '"')
    paths = [folder]
    if max_files is not None:
        listed = matching_files(spark, folder, "*.csv").select("path").orderBy("path")
        paths = [r["path"] for r in listed.limit(max_files).collect()]  # file names only
    if mixed_headers:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(paths)
        lines = lines.where(F.col("_metadata.file_block_start") == 0)
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.rtrim("value").alias("header"), F.monotonically_increasing_id().alias("n"))
        first = lines.groupBy("path").agg(F.min_by("header", "n").alias("header"))
        layouts = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()  # file names only
        out = None
        for layout in layouts:
            one = reader.csv([unquote(p) for p in layout["paths"]])
            one = one.select("*", label.alias("playlist_name"))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise FileNotFoundError(f"no csv file with a header in {folder}")
    else:
        out = reader.schema(schema or PLAYLIST_SCHEMA).csv(paths)
        out = out.select("*", label.alias("playlist_name"))
    if "Added At" in out.columns:
        out = out.withColumn("Added At", F.try_to_timestamp("Added At"))
    return out


def read_events_parquet(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """Parquet log with its time column coerced; an empty log is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    if dict(df.dtypes)[ts] != "string":  # already typed, so filters on it reach the scan
        return df
    return df.withColumn(ts, F.try_to_timestamp(ts))


def read_result_json(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(name, payload) per result file, the payload as JSON text."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.text(folder).select(file_stem().alias("name"), F.col("value").alias("payload"))


def read_latest_result(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(name, payload) of the result file whose path sorts last; of the others only the names are listed."""
    last = matching_files(spark, folder, pattern).agg(F.max("path")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no file matches {pattern} in {folder}")
    return read_result_json(spark, last)
