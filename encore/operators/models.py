"""Supervised models on Spark ML (L13-L23)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.functions.tails import chi2_upper_col
from encore.operators.ranking import top_k
from encore.operators.sessions import lag_features, sessionize
from encore.operators.stats import mann_whitney
from encore.session import checkpointed


def _hash_share(*key: str, seed: int = 42) -> Column:
    """Uniform [0, 1) from a hash of the key: splits that do not move with the partitioning."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0


# ---- daily volume --------------------------------------------------------


def volume_features(plays: DataFrame, ts: str, is_class: Column) -> DataFrame:
    """Daily plays with calendar cycles, class share and the trailing mean and std of earlier days."""
    from pyspark.sql import Window

    daily = plays.groupBy(F.to_date(ts).alias("date")).agg(
        F.count("*").cast("double").alias("plays"), F.avg(F.hour(ts)).alias("mean_hour"), F.avg(is_class.cast("double")).alias("class_share")
    )
    day = F.datediff("date", F.lit("1970-01-01"))
    week = Window.orderBy(day).rangeBetween(-7, -1)  # daily grain: one row per date
    month = Window.orderBy(day).rangeBetween(-30, -1)
    hs, hc = C.cyclical("mean_hour", 24)
    ds, dc = C.cyclical(F.weekday("date"), 7)
    ms, mc = C.cyclical(F.month("date"), 12)
    return daily.withColumns(
        {
            "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc, "month_sin": ms, "month_cos": mc,
            "is_weekend": (F.weekday("date") >= 5).cast("double"),
            "mean_7d": F.coalesce(F.avg("plays").over(week), F.lit(0.0)),
            "std_7d": F.coalesce(F.stddev_samp("plays").over(week), F.lit(0.0)),
            "mean_30d": F.coalesce(F.avg("plays").over(month), F.lit(0.0)),
            "std_30d": F.coalesce(F.stddev_samp("plays").over(month), F.lit(0.0)),
        }
    )


VOLUME_FEATURES = [
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos", "is_weekend", "class_share", "mean_7d", "std_7d", "mean_30d", "std_30d",
]


def volume_regressor(daily: DataFrame, features: Sequence[str] = VOLUME_FEATURES, trees: int = 200, rate: float = 0.1, depth: int = 6, seed: int = 42):
    """Fitted scaler + gradient-boosted trees for daily plays; one row per date, stored in one part for the many short jobs."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        GBTRegressor(featuresCol="features", labelCol="plays", maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(checkpointed(daily.coalesce(1)))


def side_by_side(tasks: Sequence[Callable], width: int = 8) -> list:
    """Results of independent fits whose jobs run at the same time; small fits leave most cores idle one by one."""
    with ThreadPoolExecutor(min(width, max(1, len(tasks)))) as pool:
        return list(pool.map(lambda task: task(), tasks))


def expanding_cv(daily: DataFrame, date: str, fit, label: str = "plays", folds: int = 5) -> DataFrame:
    """MAE per fold: train on all earlier dates, test on the next block; fold -1 is the fit of all dates on themselves.

    Boosting runs thousands of short jobs over a table of one row per date, so the fits
    run side by side.
    """
    daily = checkpointed(daily)
    cuts = daily.select(F.percentile(F.unix_date(date), [i / (folds + 1) for i in range(1, folds + 2)]).alias("c")).first()["c"]
    day = F.unix_date(date)
    parts = [(daily, daily)] + [(daily.filter(day <= cuts[i]), daily.filter((day > cuts[i]) & (day <= cuts[i + 1]))) for i in range(folds)]
    models = side_by_side([lambda train=train: fit(train) for train, _ in parts])
    out = None
    for i, (model, (_, test)) in enumerate(zip(models, parts)):
        row = regression_metrics(model.transform(test), label, "prediction").withColumn("fold", F.lit(i - 1))
        out = row if out is None else out.unionByName(row)
    return out


def volume_forecast(model, recent: DataFrame, targets: DataFrame, ts: str, label: str, date: str, main_class: str, features: Sequence[str] = VOLUME_FEATURES, spread: float = 0.2) -> DataFrame:
    """One row per target date: prediction, interval, class shares, peak hours, expected sessions.

    The history features of a target come from the most recent plays.
    """
    daily = recent.groupBy(F.to_date(ts).alias("d")).agg(F.count("*").cast("double").alias("n"))
    stats = daily.select(F.struct(F.avg("n").alias("m"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("s"))).scalar()
    mean_hour = recent.select(F.avg(F.hour(ts))).scalar()
    mix = recent.groupBy(label).agg(F.count("*").alias("n"))
    shares = mix.select(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label), (F.col("n").cast("double")))))).alias("m")).scalar()
    total = recent.select(F.count("*")).scalar()
    out = targets.withColumns({"__s": stats, "mean_hour": mean_hour, "class_counts": shares, "__n": total})
    hs, hc = C.cyclical("mean_hour", 24)
    ds, dc = C.cyclical(F.weekday(date), 7)
    ms, mc = C.cyclical(F.month(date), 12)
    known = {
        "hour_sin": hs, "hour_cos": hc, "day_sin": ds, "day_cos": dc, "month_sin": ms, "month_cos": mc,
        "is_weekend": (F.weekday(date) >= 5).cast("double"), "class_share": F.coalesce(F.try_element_at("class_counts", F.lit(main_class)) / F.col("__n"), F.lit(0.0)),
        "mean_7d": F.col("__s.m"), "std_7d": F.col("__s.s"), "mean_30d": F.col("__s.m"), "std_30d": F.col("__s.s"),
    }
    scored = model.transform(out.withColumns({f: known[f] for f in features}))
    weights = model.stages[-1].featureImportances.toArray()
    margin = F.col("prediction") * float(weights.std()) * spread
    hours = F.when(F.weekday(date) < 5, F.array(F.lit(9), F.lit(13), F.lit(19))).otherwise(F.array(F.lit(11), F.lit(15), F.lit(21)))
    return scored.select(
        date, F.col("prediction").alias("predicted_plays"), F.greatest(F.lit(0.0), F.col("prediction") - margin).alias("low"),
        (F.col("prediction") + margin).alias("high"), F.transform_values("class_counts", lambda k, v: v / F.col("__n")).alias("class_shares"),
        hours.alias("peak_hours"), (F.col("prediction") / 15).alias("expected_sessions"),
    )


def ratio_forecaster(monthly: DataFrame, order: str, value: str, alpha: float = 1.0, months: int = 6) -> DataFrame:
    """Ridge on lag 1, lag 2, index and its cycle; then months ahead, each fed by the one before, clipped to [0, 1].

    The forecast is a chain of column steps of the fitted formula on one row.
    """
    feats = ["lag_1", "lag_2", "idx", "idx_sin", "idx_cos"]
    rows = lag_features(monthly, order, value).withColumn("idx", F.col("idx").cast("double"))
    stats = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in feats for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in feats}
    data = VectorAssembler(inputCols=feats, outputCol="features").transform(rows.withColumns(z))
    ridge = LinearRegression(featuresCol="features", labelCol=value, regParam=alpha / stats["n"], elasticNetParam=0.0, standardization=False)
    model = ridge.fit(data)
    w = [float(c) for c in model.coefficients]
    last = lag_features(monthly, order, value).orderBy(F.desc("idx")).limit(1).select(
        F.col(value).alias("y1"), F.col("lag_1").alias("y2"), F.col("idx").alias("i0")
    )
    out, y1, y2, steps = last, F.col("y1"), F.col("y2"), []
    for h in range(1, months + 1):
        idx = F.col("i0") + h
        angle = idx * (2 * math.pi / 12)
        raw = {"lag_1": y1, "lag_2": y2, "idx": idx, "idx_sin": F.sin(angle), "idx_cos": F.cos(angle)}
        pred = sum((w[j] * (raw[c] - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for j, c in enumerate(feats)), F.lit(float(model.intercept)))
        out = out.withColumn(f"h{h}", F.least(F.lit(1.0), F.greatest(F.lit(0.0), pred)))
        y1, y2 = F.col(f"h{h}"), y1
        steps.append(f"{h}, h{h}")
    return out.selectExpr(f"stack({months}, {', '.join(steps)}) AS (months_ahead, predicted)")


# ---- sessions ------------------------------------------------------------


def session_features(plays: DataFrame, ts: str, user: str, row_id: str, artist: str, is_class: Column, min_len: int = 3, cap: int = 100, keep: int = 50, gap_minutes: float = 30) -> DataFrame:
    """Per play of a session with enough plays: scaled calendar, relative position, class flag, band one-hot, artist label.

    With more than ``cap`` artists only the ``keep`` most played stay as labels.
    """
    from encore.operators.joins import attach_group_stats

    rows = sessionize(plays, ts, [user], row_id, gap_minutes)
    rows = attach_group_stats(rows, [user, "session_no"], [F.count("*").alias("session_length")]).filter(F.col("session_length") >= min_len)
    rows = checkpointed(rows)  # read three times below
    n_artists = rows.select(F.countDistinct(artist)).scalar()
    top = top_k(rows, artist, keep).select(artist, F.lit(True).alias("__top"))
    rows = rows.join(top, artist, "left").withColumn("__n", n_artists).filter((F.col("__n") <= cap) | F.col("__top").isNotNull()).drop("__top", "__n")
    hour = F.hour(ts)
    return rows.select(
        row_id, user, "session_no", artist,
        (hour / 24).alias("hour"), (F.weekday(ts) / 6).alias("day"), C.weekend_flag(ts).cast("double").alias("is_weekend"),
        ((F.col("session_position") - 1) / F.col("session_length")).alias("position"), F.col("session_length").cast("double").alias("session_length"),
        is_class.cast("double").alias("class_flag"), *[c.cast("double").alias(n) for n, c in C.band_flags(hour).items()],
    )


#: Rows of a part that the forests read.
FOREST_ROWS = 100_000
SESSION_FEATURES = ["hour", "day", "is_weekend", "position", "session_length", "class_flag", "is_morning", "is_afternoon", "is_evening", "is_night"]


def session_artist_classifier(rows: DataFrame, artist: str, row_id: str, trees: int = 100, folds: int = 5, seed: int = 42, features: Sequence[str] = SESSION_FEATURES):
    """Random forest for the next artist; 80/20 hash split; (model, row of accuracy, mean and std over the folds, classes and rows).

    Folds are a column of the hash, and their fits run side by side. The forests read even parts in which equal rows
    follow one another and so meet the same nodes; equal rows are predicted once.
    """
    share = _hash_share(row_id, seed=seed)
    tagged = rows.withColumn("__a", F.col(artist).cast("string")).withColumn("__u", share)
    tagged = checkpointed(tagged.withColumn("__fold", F.least(F.floor(_hash_share(row_id, seed=seed + 1) * folds), F.lit(folds - 1)).cast("int")))
    prepared = Pipeline(stages=[
        StringIndexer(inputCol="__a", outputCol="label", handleInvalid="keep"),
        VectorAssembler(inputCols=list(features), outputCol="features"),
    ]).fit(tagged)
    parts = max(1, math.ceil(tagged.count() / FOREST_ROWS))
    even = tagged.repartition(parts, row_id).sortWithinPartitions(*features, "__a", row_id)
    data = checkpointed(prepared.transform(even))
    forest = RandomForestClassifier(numTrees=trees, seed=seed)
    right = F.sum(F.when(F.col("prediction") == F.col("label"), F.col("__n")).otherwise(0)) / F.sum("__n")
    splits = [("__u < 0.8", "__u >= 0.8")] + [(f"__fold <> {i}", f"__fold = {i}") for i in range(folds)]

    def fitted(train: str, test: str):
        model = forest.fit(data.filter(train))
        cells = data.filter(test).groupBy("features", "label").agg(F.count("*").alias("__n"))
        return model, model.transform(cells).agg(right).first()[0]

    found = side_by_side([lambda p=p: fitted(*p) for p in splits])
    scores = [float(s) for _, s in found[1:] if s is not None]
    model = PipelineModel(stages=[*prepared.stages, found[0][0]])
    row = data.agg(F.count_if(F.col("__u") >= 0.8).alias("n_test"), F.count("*").alias("n_samples"), F.countDistinct("__a").alias("n_classes"))
    mean = sum(scores) / len(scores) if scores else None
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)) if scores else None
    known = {"accuracy": found[0][1], "cv_accuracy": mean, "cv_std": spread}
    return model, row.withColumns({k: F.lit(v).cast("double") for k, v in known.items()})


def mood_features(plays: DataFrame, ts: str, user: str, row_id: str, artist: str, label: str, min_len: int = 3, gap_minutes: float = 30) -> DataFrame:
    """Per session: start calendar, length, span, classes, share of the top artist, mood by rules (order matters)."""
    key = [user, "session_no"]
    rows = checkpointed(sessionize(plays, ts, [user], row_id, gap_minutes).select(*key, ts, artist, label))  # read twice below
    top = rows.filter(F.col(artist).isNotNull()).groupBy(*key, artist).agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("__top"))
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 3_600_000_000
    base = rows.groupBy(*key).agg(
        F.min(ts).alias("__start"), F.count("*").alias("session_length"), span.alias("span_hours"), F.countDistinct(label).alias("n_classes")
    ).filter(F.col("session_length") >= min_len)
    out = base.join(top, key).select(
        *key, F.hour("__start").alias("hour"), F.weekday("__start").alias("day_of_week"), (F.weekday("__start") >= 5).cast("int").alias("is_weekend"),
        "session_length", "span_hours", "n_classes", (F.col("__top") / F.col("session_length")).alias("artist_repetition"),
    )
    h, n, rep, weekend = F.col("hour"), F.col("session_length"), F.col("artist_repetition"), F.col("is_weekend") == 1
    mood = (
        F.when((h >= 6) & (h < 12), F.when(n > 20, "energetic").otherwise("calm"))
        .when((h >= 9) & (h < 17) & ~weekend, F.when(rep > 0.5, "focused").otherwise("background"))
        .when((h >= 18) & (h < 22), F.when(weekend & (n > 30), "social").otherwise("relaxed"))
        .otherwise(F.when(rep > 0.6, "contemplative").otherwise("chill"))
    )
    return out.withColumn("mood", mood)


MOOD_FEATURES = ["hour", "day_of_week", "is_weekend", "session_length", "span_hours", "n_classes", "artist_repetition"]


def mood_classifier(sessions: DataFrame, trees: int = 100, clusters: int = 5, seed: int = 42, features: Sequence[str] = MOOD_FEATURES):
    """One-vs-rest boosted trees for the mood and k-means over the same features; (model, clusters model).

    Boosting runs hundreds of short jobs after one another, so the fits of the moods run side by side.
    """
    sessions = checkpointed(sessions)
    prep = Pipeline(stages=[
        StringIndexer(inputCol="mood", outputCol="label"),
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
    ]).fit(sessions)
    data = prep.transform(sessions)
    model = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=3, seed=seed), parallelism=8).fit(data)
    groups = KMeans(k=clusters, seed=seed, predictionCol="mood_cluster").fit(data)
    return prep, model, groups


# ---- bridges -------------------------------------------------------------


def bridge_classifier(rows: DataFrame, features: Sequence[str], label: str, row_id: str, top: int = 15, trees: int = 200, depth: int = 10, seed: int = 42, ratio: int = 3):
    """Balanced sample, z-scores, the best features by ANOVA F, random forest on a stratified 70/30 split.

    Returns (fitted steps, scored test rows).
    """
    from encore.operators.ranking import balanced_negatives

    data = balanced_negatives(checkpointed(rows), label, [row_id], ratio, seed)
    data = checkpointed(data.withColumn("label", F.col(label).cast("double")))
    split = data.withColumn("__u", _hash_share(row_id, label, seed=seed))
    selector = UnivariateFeatureSelector(featuresCol="scaled", outputCol="features", labelCol="label", selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(top, len(features)))
    steps = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        selector,
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
    ]).fit(split.filter("__u < 0.7"))
    return steps, steps.transform(split.filter("__u >= 0.7"))


def detect_bridges(model, candidates: DataFrame, item: str, centrality: str, transition: str, novelty: str, threshold: float = 0.6) -> DataFrame:
    """Candidates whose probability reaches the threshold, with their scores and confidence, best first per rank column."""
    p = vector_to_array("probability")[1]
    out = model.transform(candidates).withColumn("bridge_probability", p).filter(F.col("bridge_probability") >= threshold)
    return out.select(
        item, "bridge_probability", F.col(centrality).alias("cultural_span"), F.col(transition).alias("transition_effectiveness"),
        F.col(novelty).alias("novelty"), (2 * F.abs(F.col("bridge_probability") - 0.5)).alias("confidence"),
    )


def bridge_logistic(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Logistic regression on mean-imputed features: accuracy against the base rate and a likelihood-ratio test."""
    from encore.operators.quality import impute_mean

    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        impute_mean(rows, features).withColumn("label", F.col(label).cast("double"))
    )
    model = LogisticRegression(maxIter=100, regParam=0.0).fit(data)
    p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-12)), F.lit(1e-12))
    y = F.col("label")
    out = model.transform(data).agg(
        F.count("*").alias("n"), F.avg((F.col("prediction") == y).cast("double")).alias("accuracy"), F.avg(y).alias("__b"),
        F.sum(y * F.ln(p) + (1 - y) * F.ln(1 - p)).alias("__ll"),
    )
    b = F.col("__b")
    null = F.col("n") * (b * F.ln(b) + (1 - b) * F.ln(1 - b))
    out = out.withColumns({"base_rate": F.greatest(b, 1 - b), "lr_chi2": 2 * (F.col("__ll") - null)}).drop("__b", "__ll")
    return out.withColumn("p_value", chi2_upper_col(F.col("lr_chi2"), F.lit(len(features))))


# ---- metrics -------------------------------------------------------------


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    n = F.count(y)
    out = df.groupBy(*keys).agg(
        n.alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * n)).alias("r2"),
    )
    return out


def class_metrics(df: DataFrame, label: str, prediction: str, score: str) -> DataFrame:
    """Accuracy, precision, recall and the area under the ROC curve (rank form) of a 0/1 label."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    hits = F.count_if(y & p)
    out = df.agg(
        F.count("*").alias("n"), F.avg((y == p).cast("double")).alias("accuracy"),
        (hits / F.greatest(F.count_if(p), F.lit(1))).alias("precision"), (hits / F.greatest(F.count_if(y), F.lit(1))).alias("recall"),
    )
    u = mann_whitney(df, score, label, 1, 0)
    auc = u.select(F.try_divide(F.col("statistic"), F.col("n_a") * (F.col("n") - F.col("n_a")))).scalar()
    return out.withColumn("auc", auc)
