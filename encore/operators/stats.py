"""Hypothesis tests from aggregates (O).

Every statistic is a distributed aggregate that ends in a few rows; the tail
probability of those rows is the last step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.functions.columns import effect_size_label, silhouette_label
from encore.functions.tails import (
    binomial_upper_col,
    chi2_upper_col,
    f_upper_col,
    normal_two_sided_col,
    t_two_sided_col,
    t_upper_col,
)
from encore.operators import resample as R
from encore.operators.resample import label_index
from encore.operators.scan import exact_quantiles, value_counts_below
from encore.operators.timeseries import anova, spaced_change_points
from encore.session import checkpointed, ship_package

ALPHA = 0.05


# Advice by the strength of the evidence; N is the sample size.
ADVICE = {
    "strong": "✅ Strong evidence - suitable for publication",
    "moderate": "⚡ Moderate evidence - consider replicating with larger sample",
    "more_data": "🔍 Large effect but not significant - collect more data (current N={})",
    "small_sample": "📈 Increase sample size (current N={}) for reliable results",
    "weak": "❌ Weak evidence - reconsider approach or variables",
}


def evidence_advice(p_value: str, effect_size: str, n: str) -> Column:
    """Advice text of a finished test."""
    p, effect = F.col(p_value), F.col(effect_size)
    sized = lambda k: F.replace(F.lit(ADVICE[k]), F.lit("{}"), F.col(n).cast("string"))
    return (
        F.when((p < 0.05) & (effect > 0.5), ADVICE["strong"]).when((p < 0.05) & (effect > 0.2), ADVICE["moderate"])
        .when((p >= 0.05) & (effect > 0.5), sized("more_data")).when(F.col(n) < 30, sized("small_sample")).otherwise(ADVICE["weak"])
    )


def paired_t(df: DataFrame, base: str, improved: str, keys: Sequence[str] = (), min_n: int = 6) -> DataFrame:
    """One-sided paired t: mean improvement, t, Cohen d, share improved, labels, advice."""
    d = F.col(improved) - F.col(base)
    out = df.withColumn("__d", d).filter(F.col("__d").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("__d").alias("mean_improvement"),
        F.stddev_samp("__d").alias("sd"),
        F.avg((F.col("__d") > 0).cast("double")).alias("share_improved"),
    ).filter(F.col("n") >= min_n)
    out = out.withColumns(
        {
            "statistic": F.try_divide(F.col("mean_improvement"), F.col("sd") / F.sqrt("n")),
            "effect_size": F.try_divide(F.col("mean_improvement"), F.col("sd")),
        }
    ).drop("sd")
    out = out.withColumn("magnitude", effect_size_label("effect_size"))
    out = out.withColumn("p_value", t_upper_col(F.col("statistic"), F.col("n") - 1))
    return out.withColumn("advice", evidence_advice("p_value", "effect_size", "n"))


def wilcoxon_signed_rank(df: DataFrame, base: str, improved: str) -> DataFrame:
    """Average ranks of |d| with zeros split, normal approximation, r = z / sqrt n."""
    d = df.select((F.col(improved) - F.col(base)).alias("d")).filter(F.col("d").isNotNull()).withColumn("a", F.abs("d"))
    below = value_counts_below(d, "a")
    signed = d.groupBy("a").agg(F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") == 0).alias("zero"))
    rank = F.col("below") + (F.col("n") + 1) / 2
    t = F.col("n").cast("double")
    out = below.join(signed, "a").agg(
        F.sum(rank * (F.col("pos") + F.col("zero") / 2)).alias("statistic"),
        F.max("total").cast("double").alias("n"),
        F.sum(t * t * t - t).alias("__ties"),
    )
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48)
    out = out.withColumn("z", F.try_divide(F.col("statistic") - n * (n + 1) / 4, sd)).drop("__ties")
    out = out.withColumn("effect_size", F.abs("z") / F.sqrt("n"))
    return out.withColumn("p_value", F.when(F.col("z") > 0, 0.5).otherwise(F.lit(1.0)) * normal_two_sided_col(F.col("z")))


def sign_test(df: DataFrame, base: str, improved: str) -> DataFrame:
    d = F.col(improved) - F.col(base)
    out = df.agg(F.count_if(d > 0).alias("statistic"), F.count_if(d != 0).alias("n"))
    out = out.filter(F.col("n") > 0).withColumn("effect_size", F.col("statistic") / F.col("n") - 0.5)
    return out.withColumn("p_value", binomial_upper_col(F.col("statistic"), F.col("n"), F.lit(0.5)))


def two_sample_t(df: DataFrame, x: str, group: str, a, b, keys: Sequence[str] = (), equal_var: bool = True) -> DataFrame:
    """Student's or Welch's t between two groups with pooled Cohen d."""
    is_a, is_b = F.col(group) == a, F.col(group) == b
    aggs = []
    for name, cond in (("a", is_a), ("b", is_b)):
        v = F.when(cond, F.col(x))
        aggs += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"m_{name}"), F.var_samp(v).alias(f"v_{name}")]
    out = df.groupBy(*keys).agg(*aggs).filter((F.col("n_a") > 1) & (F.col("n_b") > 1))
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "v_a", "v_b"))
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    diff = F.col("m_a") - F.col("m_b")
    se2 = pooled * (1 / na + 1 / nb) if equal_var else va / na + vb / nb
    free = na + nb - 2 if equal_var else F.try_divide(
        F.pow(va / na + vb / nb, 2), F.pow(va / na, 2) / (na - 1) + F.pow(vb / nb, 2) / (nb - 1)
    )
    out = out.withColumns(
        {"mean_difference": diff, "statistic": F.try_divide(diff, F.sqrt(se2)), "free": free.cast("double"), "effect_size": F.try_divide(diff, F.sqrt(pooled))}
    )
    return out.drop("m_a", "m_b", "v_a", "v_b").withColumn("p_value", t_two_sided_col("statistic", "free"))


def mann_whitney(df: DataFrame, x: str, group: str, a, b, keys: Sequence[str] = ()) -> DataFrame:
    """Average ranks from per-value counts, tie-corrected normal approximation, r = z / sqrt N."""
    keys = list(keys)
    two = df.filter(F.col(group).isin(a, b) & F.col(x).isNotNull())
    below = value_counts_below(two, x, keys)
    mine = two.groupBy(*keys, x).agg(F.count_if(F.col(group) == a).alias("k"))
    rank = F.col("below") + (F.col("n") + 1) / 2
    t = F.col("n").cast("double")
    out = below.join(mine, [*keys, x]).groupBy(*keys).agg(
        F.sum(rank * F.col("k")).alias("__r"),
        F.sum("k").cast("double").alias("n_a"),
        F.max("total").cast("double").alias("n"),
        F.sum(t * t * t - t).alias("__ties"),
    )
    na, n = F.col("n_a"), F.col("n")
    nb = n - na
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.try_divide(F.col("__ties"), n * (n - 1))))
    out = out.withColumn("statistic", F.col("__r") - na * (na + 1) / 2)
    out = out.withColumn("z", F.try_divide(F.col("statistic") - na * nb / 2, sd)).drop("__r", "__ties")
    out = out.withColumn("effect_size", F.abs("z") / F.sqrt("n"))
    return out.withColumn("p_value", normal_two_sided_col(F.col("z")))


def levene(df: DataFrame, x: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """F test on absolute deviations from the group median."""
    by = [*keys, group]
    medians = exact_quantiles(df, x, [0.5], by)
    dev = df.join(medians, by).withColumn("__dev", F.abs(F.col(x) - F.col("q_0")))
    return anova(dev, keys, group, "__dev")


def normality_gate(df: DataFrame, x: str, keys: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Jarque-Bera: the rank test is chosen where normality is rejected."""
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    out = out.withColumn("statistic", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4))
    out = out.withColumn("p_value", chi2_upper_col(F.col("statistic"), F.lit(2)))
    return out.withColumn("test", F.when(F.col("p_value") > alpha, "t").otherwise("rank"))


def fdr_bh(df: DataFrame, p: str, alpha: float = ALPHA) -> DataFrame:
    """Benjamini-Hochberg adjusted p.

    Works on the distinct p-values with their ranks: all rows of one value share
    the adjusted value of the last of them. The running minimum from above is
    taken within cells first, then over the cells, so no task sorts all rows.
    """
    from encore.operators.scan import CELL, HotCells

    ranked = value_counts_below(df, p)
    raw = ranked.withColumn("__raw", F.col(p) * F.col("total") / (F.col("below") + F.col("n")))
    raw = HotCells().apply(raw, [], [p])
    later = Window.orderBy(CELL).rowsBetween(1, Window.unboundedFollowing)  # one row per cell
    cells = raw.groupBy(CELL).agg(F.min("__raw").alias("__m")).withColumn("__next", F.min("__m").over(later)).drop("__m")
    w = Window.partitionBy(CELL).orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = raw.join(cells, CELL).withColumn(
        "p_adjusted", F.least(F.lit(1.0), F.min("__raw").over(w), F.coalesce("__next", F.lit(1.0)))
    )
    out = df.join(adjusted.select(p, "p_adjusted"), p, "left")
    return out.withColumn("rejected", F.col("p_adjusted") <= alpha)


T2_ROW = T.StructType([T.StructField(n, T.DoubleType()) for n in ("t2", "f", "pillai")])


@F.pandas_udf(T2_ROW)
def _solve_t2(diff: pd.Series, cov: pd.Series, na: pd.Series, nb: pd.Series) -> pd.DataFrame:
    rows = []
    for d, c, a, b in zip(diff, cov, na, nb):
        k = len(d)
        t2 = a * b / (a + b) * float(np.asarray(d) @ np.linalg.solve(np.asarray(c).reshape(k, k), np.asarray(d)))
        free = a + b - 2
        rows.append((t2, (free - k + 1) / (k * free) * t2, t2 / (t2 + free)))
    return pd.DataFrame(rows, columns=["t2", "f", "pillai"])


def hotelling_t2(df: DataFrame, features: Sequence[str], group: str, a, b, ridge: float = 1e-6) -> DataFrame:
    """Pooled covariance from pairwise aggregates in one pass; a k x k solve on the one result row."""
    ship_package(df.sparkSession)
    k, aggs = len(features), []
    conds = {"a": F.col(group) == a, "b": F.col(group) == b}
    for g, cond in conds.items():
        aggs.append(F.count_if(cond).alias(f"n_{g}"))
        aggs += [F.avg(F.when(cond, F.col(f))).alias(f"m_{g}_{i}") for i, f in enumerate(features)]
        aggs += [
            F.covar_samp(F.when(cond, F.col(features[i])), F.when(cond, F.col(features[j]))).alias(f"c_{g}_{i}_{j}")
            for i in range(k)
            for j in range(i, k)
        ]
    row = df.agg(*aggs)
    na, nb = F.col("n_a"), F.col("n_b")

    def pooled(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        value = ((na - 1) * F.col(f"c_a_{i}_{j}") + (nb - 1) * F.col(f"c_b_{i}_{j}")) / (na + nb - 2)
        return value + (ridge if i == j else 0.0)

    diff = F.array(*[F.col(f"m_a_{i}") - F.col(f"m_b_{i}") for i in range(k)])
    cov = F.array(*[pooled(i, j) for i in range(k) for j in range(k)])
    out = row.filter((na > k) & (nb > k)).select(
        na.cast("double").alias("n_a"), nb.cast("double").alias("n_b"), _solve_t2(diff, cov, na.cast("double"), nb.cast("double")).alias("s")
    ).select("n_a", "n_b", "s.*")
    return out.withColumn("p_value", f_upper_col(F.col("f"), F.lit(k), F.col("n_a") + F.col("n_b") - k - 1))


# ---- cluster quality ----------------------------------------------------


def with_vector(df: DataFrame, features: str | Sequence[str], out: str = "features") -> DataFrame:
    array = F.col(features) if isinstance(features, str) else F.array(*features)
    return df.withColumn(out, array_to_vector(array.cast("array<double>")))


def silhouette(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean silhouette over squared Euclidean distances, with its quality label."""
    evaluator = ClusteringEvaluator(featuresCol=vector, predictionCol="__p", distanceMeasure="squaredEuclidean")
    score = evaluator.evaluate(df.select(vector, F.col(label).cast("double").alias("__p")))
    out = df.sparkSession.range(1).select(F.lit(float(score)).alias("silhouette"))
    return out.withColumn("quality", silhouette_label("silhouette"))


def centroids(df: DataFrame, vector: str, by: Sequence[str]) -> DataFrame:
    """Size, centroid and per-dimension variance of each cluster: one vector aggregate."""
    s = Summarizer.metrics("mean", "variance", "count").summary(F.col(vector)).alias("s")
    out = df.groupBy(*by).agg(s)
    return out.select(
        *by, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("c"), vector_to_array("s.variance").alias("v")
    )


def _dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def calinski_harabasz(df: DataFrame, vector: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Between over within dispersion, from cluster sizes, means and variances."""
    keys = list(keys)
    c = centroids(df, vector, [*keys, label])
    weighted = F.transform("c", lambda x: x * F.col("n"))
    rows = F.collect_list(F.struct("n", "c", weighted.alias("w")))  # one struct per cluster
    out = c.withColumn("__in", _sum(F.col("v")) * (F.col("n") - 1)).groupBy(*keys).agg(
        rows.alias("r"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("__in").alias("within")
    )
    total = F.aggregate(
        F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.get("r", F.lit(0))["w"], lambda s, x: F.zip_with(s, x["w"], lambda p, q: p + q)
    )
    out = out.withColumn("__t", total).withColumn("__m", F.transform("__t", lambda x: x / F.col("n")))
    between = F.aggregate("r", F.lit(0.0), lambda s, x: s + x["n"] * _dist2(x["c"], F.col("__m")))
    within = F.try_divide(F.col("within"), F.col("n") - F.col("k"))
    score = F.try_divide(F.try_divide(between, F.col("k") - 1), within)
    return out.select(*keys, "n", "k", score.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, vector: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / distance_ij."""
    keys = list(keys)
    by = [*keys, label]
    c = centroids(df, vector, by).select(*by, "c")
    spread = df.withColumn("__x", vector_to_array(vector)).join(c, by).groupBy(*by).agg(
        F.avg(F.sqrt(_dist2(F.col("__x"), F.col("c")))).alias("s")
    )
    rows = spread.join(c, by).groupBy(*keys).agg(F.collect_list(F.struct(label, "s", "c")).alias("r"))  # one struct per cluster
    worst = F.transform(
        "r",
        lambda a: F.array_max(
            F.transform(F.filter("r", lambda b: b[label] != a[label]), lambda b: F.try_divide(a["s"] + b["s"], F.sqrt(_dist2(a["c"], b["c"]))))
        ),
    )
    return rows.select(*keys, (_sum(worst) / F.size("r")).alias("davies_bouldin"))


def permutation_baseline(df: DataFrame, vector: str, label: str, row_id: str, k: int, replicates: int = 100, seed: int = 42) -> DataFrame:
    """CH and DB of random labelings against the observed ones; p = (count + 1) / (n + 1).

    The label of a row in a replicate is its draw modulo ``k``. One pass adds up the
    clusters of all replicates, a second one the distances to their centres.
    """
    rows, dims = R.vector_rows(df, vector, row_id, seed)

    def random(vectors, a, b):
        labels = R.draws(a, b, replicates) % k
        return labels, np.ones(labels.shape)

    def scattered(vectors, a, b):
        labels = R.draws(a, b, replicates) % k
        far = np.sqrt(R.distances(vectors, centres.reshape(-1, dims))).reshape(len(vectors), replicates, k)
        own = np.take_along_axis(far, labels[:, :, None], axis=2)[:, :, 0]
        return np.stack([np.where(labels == c, own, 0.0).sum(axis=0) for c in range(k)], axis=1)

    sums = R.cluster_sums(rows, ["__a", "__b"], replicates, k, dims, random)
    ch, centres = R.spread(sums)
    db = R.scatter_index(R.replicate_sums(rows, ["__a", "__b"], replicates, k, dims, scattered), sums[..., 0], centres)
    seen_ch = calinski_harabasz(df, vector, label).select("calinski_harabasz")
    seen_db = davies_bouldin(df, vector, label).select("davies_bouldin")
    reps = df.sparkSession.createDataFrame([(float(c), float(d)) for c, d in zip(ch, db)], "c double, d double")
    both = reps.withColumns({"__ch": seen_ch.scalar(), "__db": seen_db.scalar()})
    return both.agg(
        F.count("*").alias("replicates"),
        F.first("__ch").alias("calinski_harabasz"),
        F.avg("c").alias("random_ch"),
        ((F.count_if(F.col("c") >= F.col("__ch")) + 1) / (F.count("*") + 1)).alias("p_ch"),
        F.first("__db").alias("davies_bouldin"),
        F.avg("d").alias("random_db"),
        ((F.count_if(F.col("d") <= F.col("__db")) + 1) / (F.count("*") + 1)).alias("p_db"),
    )


def adjusted_rand_index(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """From the contingency counts of two labelings."""
    keys = list(keys)
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(*keys, a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(*keys, a).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("ra"))
    cols = cells.groupBy(*keys, b).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("rb"))
    both = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("ri"), F.sum("n").alias("n"))
    if keys:
        out = both.join(rows, keys).join(cols, keys)
    else:
        out = both.withColumns({"ra": rows.select("ra").scalar(), "rb": cols.select("rb").scalar()})
    expected = F.coalesce(F.try_divide(F.col("ra") * F.col("rb"), pairs(F.col("n"))), F.lit(0.0))
    best = (F.col("ra") + F.col("rb")) / 2
    value = F.when(best == expected, 1.0).otherwise((F.col("ri") - expected) / (best - expected))
    return out.select(*keys, F.col("n").cast("long").alias("n"), value.alias("ari"))


def _interval(stat: DataFrame, point: Column, level: float) -> DataFrame:
    tail = (1 - level) / 2
    out = stat.agg(F.percentile("stat", tail).alias("ci_low"), F.percentile("stat", 1 - tail).alias("ci_high"), F.count("*").alias("replicates"))
    return out.withColumn("estimate", point)


def bootstrap_ci(df: DataFrame, x: str, row_id: Sequence[str], replicates: int = 1000, level: float = 0.95, seed: int = 42, median: bool = False) -> DataFrame:
    """Percentile interval of the mean (or median) over Poisson resamples; every row is read once for all replicates."""
    if median:
        return _interval(R.replicate_medians(df, x, row_id, replicates, seed), exact_quantiles(df, x, [0.5]).select("q_0").scalar(), level)
    return _interval(R.replicate_means(df, x, row_id, replicates, seed), df.select(F.avg(x)).scalar(), level)


def bootstrap_silhouette(df: DataFrame, vector: str, label: str, row_id: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean silhouette (squared Euclidean distance) over Poisson resamples.

    The summed distance of a row to a cluster follows from the cluster's weight, sum
    and sum of squares, so one pass adds those up for all replicates and a second one
    the silhouettes. A row that is alone in its cluster has silhouette 0.
    """
    place, k = label_index(df, label)
    rows, dims = R.vector_rows(df.where(F.col(label).isNotNull()), vector, row_id, seed, l=place)

    def resampled(vectors, a, b, labels):
        w = R.weights(a, b, replicates)
        return np.broadcast_to(labels[:, None], w.shape), w.astype(float)

    def silhouettes(vectors, a, b, labels):
        w = R.weights(a, b, replicates)
        out = np.zeros((replicates, 2))
        squares = (vectors**2).sum(axis=1)[:, None]
        for r in range(replicates):
            n = sums[r, :, 0]
            far = np.maximum(squares * n - 2 * vectors @ sums[r, :, 2:].T + sums[r, :, 1], 0.0)
            own = n[labels]
            with np.errstate(divide="ignore", invalid="ignore"):
                inner = far[np.arange(len(labels)), labels] / (own - 1)
                mean = np.where(n > 0, far / n, np.inf)
                mean[np.arange(len(labels)), labels] = np.inf
                outer = mean.min(axis=1)
                value = np.where((own > 1) & (outer < np.inf), (outer - inner) / np.maximum(inner, outer), 0.0)
            out[r] = (np.nan_to_num(value) * w[:, r]).sum(), w[:, r].sum()
        return out

    sums = R.cluster_sums(rows, ["__a", "__b", "l"], replicates, k, dims, resampled)
    total = R.replicate_sums(rows, ["__a", "__b", "l"], replicates, 2, dims, silhouettes)
    stats = [(float(s / w),) for s, w in total if w > 0]
    return _interval(df.sparkSession.createDataFrame(stats, "stat double"), silhouette(df.where(F.col(label).isNotNull()).withColumn("__l", place), vector, "__l").select("silhouette").scalar(), level)


#: Rows from which k-means draws its first centres, and steps at most.
START_ROWS, STEPS = 1_000, 20


def first_centres(vectors: np.ndarray, drawn: np.ndarray, k: int) -> np.ndarray:
    """The row of the smallest draw, then always the row farthest from all chosen ones; repeated where there are too few."""
    chosen = [int(drawn.argmin())]
    nearest = ((vectors - vectors[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def cluster_stability(df: DataFrame, vector: str, row_id: str, k: int, replicates: int = 50, seed: int = 42) -> DataFrame:
    """Adjusted Rand index between the clustering of all rows and of each Poisson resample.

    Lloyd steps run for all rows and every replicate side by side: one pass assigns
    each row in each of them and adds up weighted sums by (replicate, centre), so
    there are as many jobs as steps. First centres come from ``START_ROWS`` rows.
    """
    rows, dims = R.vector_rows(df, vector, row_id, seed)
    sample = rows.orderBy("__a", "__b").limit(START_ROWS).collect()
    spark, names = df.sparkSession, "n long, ari double, rep int"
    if not sample:
        return spark.createDataFrame([], names)
    start = np.array([r["x"] for r in sample], float)
    a, b = (np.array([r[c] for r in sample], np.int64) for c in ("__a", "__b"))
    drawn = np.concatenate([a[:, None], R.draws(a, b, replicates)], axis=1)
    taken = np.concatenate([np.ones((len(a), 1), np.int64), R.weights(a, b, replicates)], axis=1) > 0
    taken[:, ~taken.any(axis=0)] = True
    reps = replicates + 1  # the first one has all rows
    centres = np.stack([first_centres(start[taken[:, r]], drawn[taken[:, r], r], k) for r in range(reps)])

    def assigned(vectors, a, b):
        w = np.concatenate([np.ones((len(a), 1), np.int64), R.weights(a, b, replicates)], axis=1)
        near = R.distances(vectors, centres.reshape(-1, dims)).reshape(len(vectors), reps, k)
        return near.argmin(axis=2), w.astype(float)

    def contingency(vectors, a, b):
        labels, w = assigned(vectors, a, b)
        pair = labels[:, :1] * k + labels[:, 1:]
        return np.stack([np.bincount(pair[w[:, r + 1] > 0, r], minlength=k * k) for r in range(replicates)]).astype(float)

    for _ in range(STEPS):
        sums = R.cluster_sums(rows, ["__a", "__b"], reps, k, dims, assigned)
        n = sums[..., :1]
        moved = np.where(n > 0, sums[..., 2:] / np.where(n > 0, n, 1), centres)
        still = np.abs(moved - centres).max() < 1e-6
        centres = moved
        if still:
            break
    cells = R.replicate_sums(rows, ["__a", "__b"], replicates, k * k, dims, contingency).reshape(replicates, k, k)
    pairs = lambda n: n * (n - 1) / 2
    out = []
    for r, table in enumerate(cells):
        n, ra, rb, ri = table.sum(), pairs(table.sum(axis=1)).sum(), pairs(table.sum(axis=0)).sum(), pairs(table).sum()
        expected = ra * rb / pairs(n) if n > 1 else 0.0
        best = (ra + rb) / 2
        out.append((int(n), 1.0 if best == expected else float((ri - expected) / (best - expected)), r + 1))
    return spark.createDataFrame(out, names)


# ---- proportions, correlations, records ----------------------------------


def proportion_test(df: DataFrame, cond: Column, value: Column, expected: float, name: str) -> DataFrame:
    """Share of non-null values that meet the condition against an expected share; Cohen h, exact binomial."""
    out = df.agg(F.count(value).alias("n"), F.count_if(cond & value.isNotNull()).alias("hits")).filter(F.col("n") > 0)
    share = F.col("hits") / F.col("n")
    h = 2 * (F.asin(F.sqrt(share)) - F.asin(F.sqrt(F.lit(expected))))
    out = out.select(F.lit(name).alias("test_name"), "n", "hits", share.alias("statistic"), F.abs(h).alias("effect_size"))
    return out.withColumn("p_value", binomial_upper_col(F.col("hits"), F.col("n"), F.lit(expected)))


def correlation_test(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r, p and the Fisher z interval."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).filter(F.col("n") > 3)
    z, se = F.atanh("r"), 1.96 / F.sqrt(F.col("n") - 3)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-15)))
    out = out.withColumns({"ci_low": F.tanh(z - se), "ci_high": F.tanh(z + se)})
    return out.withColumn("p_value", t_two_sided_col(t, F.col("n") - 2))


def one_sample_t(df: DataFrame, x: str, mu: float, keys: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.stddev_pop(x).alias("__sp")
    ).filter(F.col("n") > 1)
    out = out.withColumns(
        {
            "statistic": F.try_divide(F.col("mean") - mu, F.col("sd") / F.sqrt("n")),
            "effect_size": F.try_divide(F.abs(F.col("mean") - mu), F.col("__sp")),
        }
    ).drop("__sp")
    return out.withColumn("p_value", t_two_sided_col(F.col("statistic"), F.col("n") - 1))


def change_count_test(series: DataFrame, keys: Sequence[str], date: str, x: str) -> DataFrame:
    """Spaced change points per series against ln(n), chi-square with one degree of freedom."""
    found = spaced_change_points(series, keys, date, x).groupBy(*keys).agg(F.count("*").alias("observed"))
    sizes = series.groupBy(*keys).agg(F.count("*").alias("n"), F.ln(F.count("*")).alias("expected"))
    out = sizes.join(found, list(keys), "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    gap = F.col("observed") - F.col("expected")
    out = out.withColumns(
        {"statistic": F.try_divide(gap * gap, F.col("expected")), "effect_size": F.abs(gap) / F.greatest(F.col("expected"), F.lit(1.0))}
    )
    return out.withColumn("p_value", chi2_upper_col(F.col("statistic"), F.lit(1)))


def decay_test(curve: DataFrame, keys: Sequence[str], horizon: str, accuracy: str) -> DataFrame:
    """Slope of log accuracy on the horizon with its 95% interval; decay means negative and significant."""
    x, y = F.col(horizon).cast("double"), F.ln(F.greatest(F.col(accuracy), F.lit(0.001)))
    out = curve.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("__sxx"),
        F.regr_syy(y, x).alias("__syy"), F.count("*").alias("n"),
    )
    se = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("__syy"), (F.col("n") - 2) * F.col("__sxx")))
    out = out.withColumn("se", se).withColumn("statistic", F.try_divide(F.col("slope"), F.col("se")))
    out = out.withColumn("p_value", t_two_sided_col(F.col("statistic"), F.col("n") - 2)).drop("__sxx", "__syy")
    return out.withColumns(
        {
            "ci_low": F.col("slope") - 1.96 * F.col("se"),
            "ci_high": F.col("slope") + 1.96 * F.col("se"),
            "decays": (F.col("slope") < 0) & (F.col("p_value") < ALPHA),
        }
    )


# Expected accuracy at a horizon in days, and the assumed standard error.
EXPECTED_ACCURACY = {7: 0.90, 30: 0.60, 90: 0.30}
ACCURACY_SE = 0.05


def threshold_at_horizon(curve: DataFrame, keys: Sequence[str], horizon: str, accuracy: str, days: int) -> DataFrame:
    """Accuracy at the nearest horizon against the expected one."""
    near = F.min_by(accuracy, F.struct(F.abs(F.col(horizon) - days), F.col(horizon)))
    expected = EXPECTED_ACCURACY.get(days, 0.5)
    out = curve.groupBy(*keys).agg(near.alias("observed"))
    t = (F.col("observed") - expected) / ACCURACY_SE
    out = out.withColumns({"expected": F.lit(expected), "statistic": t, "effect_size": F.abs(t)})
    return out.withColumn("p_value", t_two_sided_col(F.col("statistic"), F.lit(1)))


def count_tests(factors: DataFrame, interpretable: Column, cross: Column, low: int = 3, high: int = 7) -> DataFrame:
    """Interpretable factors in range and above 70 %; cross-class factors above 20 %."""
    row = factors.agg(F.count("*").alias("n"), F.count_if(interpretable).alias("a"), F.count_if(cross).alias("b"))
    rows = row.select(
        "n", F.explode(F.array(
            F.struct(F.lit("interpretable").alias("test_name"), F.col("a").alias("hits"), F.lit(0.7).alias("expected"), F.col("a").between(low, high).alias("in_range")),
            F.struct(F.lit("cross_class").alias("test_name"), F.col("b").alias("hits"), F.lit(0.2).alias("expected"), (F.col("b") >= 1).alias("in_range")),
        )).alias("r"),
    ).select("n", "r.*")
    h = 2 * (F.asin(F.sqrt(F.col("hits") / F.greatest(F.col("n"), F.lit(1)))) - F.asin(F.sqrt("expected")))
    return rows.withColumn("effect_size", F.abs(h)).withColumn("p_value", binomial_upper_col("hits", "n", "expected"))


def evidence_rollup(records: DataFrame, hypothesis: str, medium: float = 0.5) -> DataFrame:
    """Per hypothesis: significant tests, share, primary effect and the evidence label.

    Expects is_primary, significant, effect_size, power. Strong: the primary test
    is significant with at least a medium effect, or three quarters of the tests are.
    """
    primary = F.col("is_primary")
    out = records.groupBy(hypothesis).agg(
        F.count("*").alias("n_tests"),
        F.count_if("significant").alias("n_significant"),
        F.bool_or(primary & F.col("significant")).alias("primary_significant"),
        F.max(F.when(primary, F.col("effect_size"))).alias("primary_effect"),
        F.avg("power").alias("mean_power"),
        F.min("power").alias("min_power"),
    )
    share = F.col("n_significant") / F.col("n_tests")
    strong = (F.col("primary_significant") & (F.col("primary_effect") > medium)) | (share >= 0.75)
    level = F.when(strong, "strong").when(F.col("primary_significant") | (share >= 0.5), "moderate").otherwise("weak")
    return out.withColumns({"share_significant": share, "evidence": level})


def class_difference_by_feature(df: DataFrame, features: Sequence[str], score_a: str, score_b: str) -> DataFrame:
    """Rows split by the larger score; per feature a t and a rank test, p adjusted over the features."""
    from encore.operators.quality import unpivot

    tagged = df.withColumn("side", F.when(F.col(score_a) > F.col(score_b), "a").otherwise("b"))
    long = unpivot(tagged, features, keep=["side"])
    t = two_sample_t(long, "x", "side", "a", "b", ["feature"], equal_var=False).select(
        "feature", "n_a", "n_b", F.col("statistic").alias("t"), "effect_size", F.col("p_value").alias("p_t")
    )
    u = mann_whitney(long, "x", "side", "a", "b", ["feature"]).select("feature", F.col("z").alias("z"), F.col("p_value").alias("p_u"))
    return fdr_bh(t.join(u, "feature"), "p_t")


