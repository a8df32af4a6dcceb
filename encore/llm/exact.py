"""Exact duplicates of track names by a content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.session import checkpointed

#: The six ASCII white-space characters that do not count.
WHITE = " \t\n\x0b\f\r"
#: Code points of a name that order the ranges; with the digest they keep the sampled splitters short.
HEAD = 16


def without_white(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for mark in WHITE:
        text = F.replace(text, F.lit(mark))
    return text


def first_copies(tracks: DataFrame, track_id: str = "track_id", track_name: str = "track_name") -> DataFrame:
    """Whole rows of ``tracks``, all columns, one per group of ``exact_duplicates``.

    Rows are found again by id, digest and length; of rows that agree in all three
    one stays.
    """
    kept = exact_duplicates(tracks, track_id, track_name).where("kept").select(F.col(track_id).alias("__id"), F.col("text_sha256").alias("__sha"), F.col("name_chars").alias("__chars"))
    keys = {"__key": F.sha2(without_white(F.col(track_name)), 256), "__size": F.length(F.coalesce(track_name, F.lit("")))}
    same = F.col(track_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")) & (F.col("__size") == F.col("__chars"))
    return tracks.withColumns(keys).join(kept, same, "left_semi").dropDuplicates([track_id, "__key", "__size"]).select(*tracks.columns)


def exact_duplicates(tracks: DataFrame, track_id: str = "track_id", track_name: str = "track_name", salts: int = 64) -> DataFrame:
    """One row per track: the track that stays for its name and the size of its group.

    Names are equal when they are identical without ASCII white space. Of equal
    names the one with the most code points in the original stays, then the
    smallest id. The content is sorted: sampled splitters over (start of the
    normalised bytes, digest, salt) range-partition the rows, the external sort
    puts equal names next to each other, and each row is compared in full with
    its neighbour. A name that fills many rows is cut by its salt into up to
    ``salts`` pieces, each summarised where it lies; only summaries (one per
    piece) meet, by digest and length.

    Null names are empty; empty names form one group. Null ids sort last and
    stay only when no other id is there. Repeated rows count each, and one of
    them is kept. An empty table gives no rows. Other columns are ignored.

    Columns: track_id, keep_id, group_size, kept, text_sha256, name_chars (code points).
    """
    text = F.coalesce(F.col(track_name), F.lit(""))
    rows = tracks.select(F.col(track_id).alias("id"), F.length(text).alias("points"), without_white(F.col(track_name)).alias("norm"))
    rows = rows.select("*", F.sha2("norm", 256).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    rows = rows.withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange("head", "digest", "salt")

    piece = Window.partitionBy("head", "digest", "salt")
    starts = (~F.col("norm").eqNullSafe(F.lag("norm").over(piece.orderBy("norm")))).cast("int")
    rows = rows.withColumn("starts", starts).withColumn("size", F.octet_length("norm"))
    rows = rows.withColumn("run", F.sum("starts").over(piece.orderBy("norm"))).drop("norm")
    order = [F.col("points").desc(), F.col("id").asc_nulls_last()]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("head", "digest", "salt", "run").orderBy(*order)))
    slim = checkpointed(rows.select("id", "points", "digest", "size", "salt", "run", "place"))

    first = F.col("place") == 1
    best = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("no_id"), "id", "salt", "run")
    runs = slim.groupBy("digest", "size", "salt", "run").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(first, F.col("points"))).alias("points"), F.max(F.when(first, F.col("id"))).alias("id")
    )
    groups = runs.groupBy("digest", "size").agg(F.sum("n").alias("group_size"), F.min(best).alias("best"))
    pieces = runs.select("digest", "size", "salt", "run").join(groups, ["digest", "size"])
    stays = first & (F.col("salt") == F.col("best.salt")) & (F.col("run") == F.col("best.run"))
    return slim.join(pieces, ["digest", "size", "salt", "run"]).select(
        F.col("id").alias(track_id), F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256"), F.col("points").alias("name_chars")
    )
