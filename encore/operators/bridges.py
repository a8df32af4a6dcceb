"""Bridge items and label transitions (K)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.columns import composite_key
from encore.operators.scan import exact_quantiles


def bridge_candidates(stats: DataFrame, plays: str, a: str, b: str, energy: str, valence: str, acousticness: str, min_points: int = 3) -> DataFrame:
    """Points and reasons per track; the play-count quantiles are computed once for the table."""
    q = exact_quantiles(stats.select(plays), plays, [0.8, 0.95]).select(F.struct("q_0", "q_1")).scalar()
    rules = [
        ("high_replay_value", 2, F.col(plays) > F.col("__q.q_0")),
        ("cross_cultural_artist", 3, (F.col(a) > 0) & (F.col(b) > 0)),
        ("moderate_energy", 1, F.col(energy).between(0.4, 0.6)),
        ("high_valence", 1, F.col(valence) > 0.7),
        ("acoustic_content", 1, F.col(acousticness) > 0.3),
        ("extremely_popular", 2, F.col(plays) > F.col("__q.q_1")),
    ]
    points = sum((F.when(cond, n).otherwise(0) for _, n, cond in rules), F.lit(0))
    reasons = F.filter(F.array(*[F.when(cond, name) for name, _, cond in rules]), lambda r: r.isNotNull())
    out = stats.withColumn("__q", q).withColumns({"bridge_score": points, "bridge_reasons": reasons}).drop("__q")
    return out.filter(F.col("bridge_score") >= min_points)


def gateway_items(plays: DataFrame, item: str, label: str, next_label: str, min_transitions: int = 3, min_rate: float = 0.5, k: int = 10, unknown: str = "unknown") -> DataFrame:
    """Items whose plays are followed by another class in more than ``min_rate`` of the cases."""
    known = (F.col(label) != unknown) & (F.col(next_label) != unknown)
    moves = known & (F.col(label) != F.col(next_label))
    by = plays.groupBy(item, F.when(moves, F.concat(label, F.lit("_to_"), next_label)).alias("move")).agg(F.count("*").alias("n"))
    out = by.groupBy(item).agg(
        F.sum("n").alias("total_plays"),
        F.coalesce(F.sum(F.when(F.col("move").isNotNull(), F.col("n"))), F.lit(0)).alias("transitions"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("move").isNotNull(), F.struct("move", "n"))))).alias("moves"),
    )
    out = out.withColumn("transition_rate", F.col("transitions") / F.col("total_plays"))
    kept = out.filter((F.col("transitions") >= min_transitions) & (F.col("transition_rate") > min_rate))
    return kept.orderBy(F.desc("transition_rate"), item).limit(k)


def effective_transition_items(transitions: DataFrame, item: str, min_count: int = 2, k: int = 20) -> DataFrame:
    """Items with several transitions by mean strength; ties (to 9 digits) by item."""
    by = transitions.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.avg("strength").alias("mean_strength"))
    return by.filter(F.col("n") >= min_count).orderBy(F.desc(F.round("mean_strength", 9)), item).limit(k)


def transition_patterns(transitions: DataFrame) -> DataFrame:
    """Direction counts and mean strength by time band as one (kind, key, n, strength) table."""
    dims = ["from_label", "to_label", "band"]
    out = transitions.groupingSets([["from_label", "to_label"], ["band"]], *dims).agg(
        F.count("*").alias("n"), F.avg("strength").alias("strength")
    )
    is_band = F.col("band").isNotNull()
    return out.select(
        F.when(is_band, "band").otherwise("direction").alias("kind"),
        F.when(is_band, F.col("band")).otherwise(F.concat("from_label", F.lit(">"), "to_label")).alias("key"),
        "n",
        "strength",
    )


def behavioural_bridges(plays: DataFrame, item: str, entity: str, label: str, ts: str, min_hours: int = 5, k: int = 50) -> DataFrame:
    """Items of entities that span several classes, or played in many distinct hours; the most played k."""
    spanning = plays.groupBy(entity).agg(F.countDistinct(label).alias("c")).filter(F.col("c") > 1).select(entity)
    by_entity = plays.join(spanning, entity, "left_semi").select(item).distinct()
    hours = plays.groupBy(item).agg(F.countDistinct(F.hour(ts)).alias("h"))
    by_hours = hours.filter(F.col("h") >= min_hours).select(item)
    counts = plays.groupBy(item).agg(F.count("*").alias("plays"))
    both = by_entity.union(by_hours).distinct()
    return counts.join(both, item, "left_semi").orderBy(F.desc("plays"), item).limit(k)


def class_audio_profiles(tracks: DataFrame, features: Sequence[str], is_bridge: Column, is_a: Column, is_b: Column) -> DataFrame:
    """Per feature: bridge, A and B means, their span and how central the bridges sit between A and B."""
    row = tracks.agg(
        *[F.avg(F.when(cond, F.col(f))).alias(f"{f}_{n}") for f in features for n, cond in (("bridge", is_bridge), ("a", is_a), ("b", is_b))]
    )
    parts = ", ".join(f"'{f}', {f}_bridge, {f}_a, {f}_b" for f in features)
    out = row.selectExpr(f"stack({len(features)}, {parts}) AS (feature, bridge_mean, a_mean, b_mean)")
    span = F.abs(F.col("a_mean") - F.col("b_mean"))
    mid = (F.col("a_mean") + F.col("b_mean")) / 2
    central = F.when(span > 0, 1 - F.abs(F.col("bridge_mean") - mid) / (span / 2)).otherwise(F.lit(1.0))
    return out.withColumns({"span": span, "centrality": central})


def track_bridge_features(
    plays: DataFrame, tracks: DataFrame, item: str, artist: str, ts: str, transitions: DataFrame, audio: Sequence[str], profiles: DataFrame
) -> DataFrame:
    """One row per played track: counts, distinct hours and weekdays, audio, class flags, transition score, centrality."""
    counts = plays.groupBy(item).agg(
        F.count("*").alias("plays"),
        F.countDistinct(artist).alias("artists"),
        F.countDistinct(F.hour(ts)).alias("hours"),
        F.countDistinct(F.weekday(ts)).alias("weekdays"),
    )
    strength = transitions.groupBy(item).agg(F.count("*").alias("__t"), F.avg("strength").alias("__s"))
    strength = strength.filter(F.col("__t") >= 2).select(item, "__s")
    centrality = profiles.select(F.avg("centrality")).scalar()
    out = counts.join(tracks.select(item, "culture", *audio), item).join(strength, item, "left")
    return out.select(
        item, "plays", "artists", "hours", "weekdays", *audio,
        (F.col("culture") == "vietnamese").cast("int").alias("is_vietnamese"),
        (F.col("culture") != "vietnamese").cast("int").alias("is_western"),
        F.coalesce("__s", F.lit(0.0)).alias("transition_score"),
    ).withColumn("mean_centrality", centrality)


def novelty_by_frequency(plays: DataFrame, item: str) -> DataFrame:
    counts = plays.groupBy(item).agg(F.count("*").alias("plays"))
    total = plays.select(F.count("*")).scalar()
    return counts.withColumn("novelty", 1 - F.least(F.col("plays") * 100 / total, F.lit(1.0)))


def bridge_score(tracks: DataFrame, bridges: DataFrame, key: str = "key", score: str = "score") -> DataFrame:
    """Looked-up score / 10, else points from the features, at most 1."""
    points = (
        F.when(F.coalesce("energy", F.lit(0.5)).between(0.4, 0.7), 0.3).otherwise(0.0)
        + F.when(F.coalesce("valence", F.lit(0.5)) > 0.6, 0.3).otherwise(0.0)
        + F.when(F.coalesce("acousticness", F.lit(0.5)) > 0.3, 0.2).otherwise(0.0)
        + F.when(F.col("culture").isin("bridge", "other"), 0.2).otherwise(0.0)
    )
    tagged = tracks.withColumn(key, F.lower(composite_key("track_name", "artist_name")))
    known = bridges.select(key, F.col(score).alias("__score"))
    out = tagged.join(known, key, "left")
    return out.withColumn("bridge_score", F.coalesce(F.col("__score") / 10, F.least(points, F.lit(1.0)))).drop("__score", key)


def bridges_between(candidates: DataFrame, item: str, current: str, target: str, n: int = 5, top: int = 20) -> DataFrame:
    """The first n of the top bridges that link the two main classes."""
    best = candidates.orderBy(F.desc("bridge_score"), item).limit(top)
    wanted = F.array(F.lit("cross_cultural_artist"), F.lit("high_valence"))
    linked = {current, target} == {"vietnamese", "western"}
    fit = best.filter(F.arrays_overlap("bridge_reasons", wanted) & F.lit(linked))
    return fit.orderBy(F.desc("bridge_score"), item).limit(n)


def extract_bridges(results: DataFrame, column: str) -> DataFrame:
    """Bridge rows from the JSON text of a result: name, artist, score, classes, lookup key."""
    schema = "bridge_candidates array<struct<track_name:string,artist_name:string,bridge_score:double,from_culture:string,to_culture:string>>"
    rows = results.select(F.explode(F.from_json(column, schema)["bridge_candidates"]).alias("b")).select("b.*")
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    out = rows.select(
        text("track_name", "").alias("track_name"),
        text("artist_name", "").alias("artist_name"),
        F.coalesce("bridge_score", F.lit(0.0)).alias("bridge_score"),
        text("from_culture", "unknown").alias("cultural_from"),
        text("to_culture", "unknown").alias("cultural_to"),
    )
    return out.withColumn("lookup_key", composite_key("track_name", "artist_name", normal=True))
