"""Queries of the hypothesis tests (O). The statistics are compared; p-values are tested against known constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from encore.operators import resample as R
from encore.operators import stats as H
from encore.plans.base import hash_sql, query, sql
from encore.plans.sessions import SHIFT
from encore.plans.timeseries import ANOVA, DECAY, SPACED, curve, rounded

# Paired scores: a part's size share before, its price share after.
PAIRED = "SELECT p_type, p_size / 50.0 AS base, (p_retailprice - 900) / 100 AS improved FROM part"


def paired(t):
    return t.tracks.select(F.col("genres").alias("p_type"), F.col("energy").alias("base"), F.col("valence").alias("improved"))


@query(
    "o1_paired_t_test",
    sql(
        """SELECT p_type, count(*) AS n, round(avg(d), 6) AS mean_improvement, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END), 6) AS share_improved,
        round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS statistic, round(avg(d) / stddev_samp(d), 6) AS effect_size,
        CASE WHEN abs(avg(d) / stddev_samp(d)) >= 0.8 THEN 'large' WHEN abs(avg(d) / stddev_samp(d)) >= 0.5 THEN 'medium'
        WHEN abs(avg(d) / stddev_samp(d)) >= 0.2 THEN 'small' ELSE 'negligible' END AS magnitude,
        -- one-sided bound of t: 1.645 for many degrees of freedom, about 1.52 / df more for fewer
        CASE WHEN avg(d) / (stddev_samp(d) / sqrt(count(*))) > 1.645 + 1.52 / (count(*) - 1) AND avg(d) / stddev_samp(d) > 0.5 THEN '✅ Strong evidence - suitable for publication'
        WHEN avg(d) / (stddev_samp(d) / sqrt(count(*))) > 1.645 + 1.52 / (count(*) - 1) AND avg(d) / stddev_samp(d) > 0.2 THEN '⚡ Moderate evidence - consider replicating with larger sample'
        WHEN avg(d) / stddev_samp(d) > 0.5 THEN '🔍 Large effect but not significant - collect more data (current N=' || count(*) || ')'
        WHEN count(*) < 30 THEN '📈 Increase sample size (current N=' || count(*) || ') for reliable results'
        ELSE '❌ Weak evidence - reconsider approach or variables' END AS advice
        FROM (SELECT *, improved - base AS d FROM pr) GROUP BY 1""",
        pr=PAIRED,
    ),
)
def _(t):
    out = H.paired_t(paired(t), "base", "improved", ["p_type"]).drop("p_value")
    return rounded(out, "mean_improvement", "share_improved", "statistic", "effect_size")


LINE_PAIRS = "SELECT l_quantity AS base, round(l_extendedprice / 1500) AS improved FROM lineitem"


def line_pairs(t):
    return t.lineitem.select(F.col("l_quantity").alias("base"), F.round(F.col("l_extendedprice") / 1500).alias("improved"))


@query(
    "o2_wilcoxon_signed_rank",
    sql(
        """SELECT round(w, 2) AS statistic, n, round((w - n * (n + 1) / 4) / sd, 6) AS z, round(abs((w - n * (n + 1) / 4) / sd) / sqrt(n), 6) AS effect_size
        FROM (SELECT w, n, sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd FROM (SELECT sum(r * CASE WHEN d > 0 THEN 1 WHEN d = 0 THEN 0.5 ELSE 0 END) AS w,
        count(*)::DOUBLE AS n FROM ranked), (SELECT sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM ranked GROUP BY abs(d))))""",
        pr=LINE_PAIRS,
        ranked="""SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM (SELECT improved - base AS d FROM pr)""",
    ),
)
def _(t):
    out = H.wilcoxon_signed_rank(line_pairs(t), "base", "improved").drop("p_value")
    return rounded(out, "z", "effect_size").withColumn("statistic", F.round("statistic", 2))


@query(
    "o3_sign_test",
    sql(
        """SELECT count(*) FILTER (d > 0) AS statistic, count(*) FILTER (d <> 0) AS n, round(count(*) FILTER (d > 0) / count(*) FILTER (d <> 0) - 0.5, 6)
        AS effect_size FROM (SELECT improved - base AS d FROM pr)""",
        pr=LINE_PAIRS,
    ),
)
def _(t):
    return rounded(H.sign_test(line_pairs(t), "base", "improved").drop("p_value"), "effect_size")


T_SQL = """SELECT na AS n_a, nb AS n_b, round(ma - mb, 6) AS mean_difference, round((ma - mb) / sqrt({se}), 6) AS statistic, round({free}, 6) AS free,
    round((ma - mb) / sqrt(pooled), 6) AS effect_size FROM (SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS pooled FROM (
    SELECT count(*) FILTER (g = 'a') AS na, count(*) FILTER (g = 'b') AS nb, avg(x) FILTER (g = 'a') AS ma, avg(x) FILTER (g = 'b') AS mb,
    var_samp(x) FILTER (g = 'a') AS va, var_samp(x) FILTER (g = 'b') AS vb FROM src))"""
GROUPS = "SELECT CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' END AS g, l_quantity AS x, l_discount AS y FROM lineitem WHERE l_returnflag IN ('A', 'R')"


def groups(t):
    g = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "b")
    return t.lineitem.select(g.alias("g"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")).filter("g IS NOT NULL")


@query(
    "o4_two_sample_t_student",
    sql(T_SQL.format(se="pooled * (1 / na + 1 / nb)", free="(na + nb - 2)::DOUBLE"), src=GROUPS),
)
def _(t):
    out = H.two_sample_t(groups(t), "x", "g", "a", "b").drop("p_value")
    return rounded(out, "mean_difference", "statistic", "free", "effect_size")


@query(
    "o4_two_sample_t_welch",
    sql(
        T_SQL.format(se="va / na + vb / nb", free="(va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))").replace(
            "round((va / na", "round((va / na"
        ),
        src=GROUPS,
    ),
)
def _(t):
    out = H.two_sample_t(groups(t), "x", "g", "a", "b", equal_var=False).drop("p_value")
    return rounded(out, "mean_difference", "statistic", "free", "effect_size")


@query(
    "o5_mann_whitney_u",
    sql(
        """SELECT na AS n_a, n, round(u, 2) AS statistic, round((u - na * nb / 2) / sd, 6) AS z, round(abs((u - na * nb / 2) / sd) / sqrt(n), 6) AS effect_size FROM (
        SELECT *, sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sd FROM (SELECT sum(r) FILTER (g = 'a') - count(*) FILTER (g = 'a') *
        (count(*) FILTER (g = 'a') + 1) / 2 AS u, (count(*) FILTER (g = 'a'))::DOUBLE AS na, (count(*) FILTER (g = 'b'))::DOUBLE AS nb, count(*)::DOUBLE AS n FROM rk),
        (SELECT sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM src GROUP BY x)))""",
        src=GROUPS,
        rk="SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM src",
    ),
)
def _(t):
    out = H.mann_whitney(groups(t), "x", "g", "a", "b").drop("p_value")
    return rounded(out, "z", "effect_size").withColumn("statistic", F.round("statistic", 2))


@query(
    "o6_levene",
    sql(
        "SELECT k, n_total, round(f, 6) AS f_statistic FROM a",
        src="SELECT l_returnflag AS g0, l_quantity * l_discount AS x0 FROM lineitem",
        dev="SELECT 'all' AS one, g0 AS g, abs(x0 - m) AS x FROM src JOIN (SELECT g0, quantile_cont(x0, 0.5) AS m FROM src GROUP BY 1) USING (g0)",
        a=ANOVA.format(k="one", src="SELECT one, x, g FROM dev"),
    ),
)
def _(t):
    rows = t.lineitem.select("l_returnflag", (F.col("l_quantity") * F.col("l_discount")).alias("x"))
    return rounded(H.levene(rows, "x", "l_returnflag").drop("p_value"), "f_statistic")


@query(
    "o7_normality_gate",
    sql(
        """SELECT l_returnflag, n, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2 - 3, 6) AS kurt, round(n / 6 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 4)
        AS statistic FROM (SELECT l_returnflag, count(*) AS n, avg((l_quantity - m) ** 2) AS m2, avg((l_quantity - m) ** 3) AS m3, avg((l_quantity - m) ** 4) AS m4
        FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1)""",
    ),
)
def _(t):
    out = H.normality_gate(t.lineitem, "l_quantity", ["l_returnflag"]).drop("p_value", "test")
    return rounded(out, "skew", "kurt").withColumn("statistic", F.round("statistic", 4))


P_VALUES = "SELECT track_id, 0.05 * valence * valence AS p FROM tracks"


@query(
    "o8_fdr_bh",
    sql(
        """SELECT track_id, round(adj, 9) AS p_adjusted, round(adj, 12) <= 0.04 AS rejected FROM (SELECT track_id, least(1, min(p * m / r) OVER
        (ORDER BY p DESC, r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM (SELECT *, count(*) OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pv))""",
        "tracks",
        pv=P_VALUES,
    ),
)
def _(t):
    rows = t.tracks.select("track_id", (0.05 * F.col("valence") * F.col("valence")).alias("p"))
    out = H.fdr_bh(rows, "p", 0.04)
    return out.select("track_id", F.round("p_adjusted", 9).alias("p_adjusted"), (F.round("p_adjusted", 12) <= 0.04).alias("rejected"))


@query(
    "o9_hotelling_t2",
    sql(
        """SELECT na AS n_a, nb AS n_b, round(t2, 4) AS t2, round((na + nb - 3) / (2 * (na + nb - 2)) * t2, 4) AS f, round(t2 / (t2 + na + nb - 2), 6) AS pillai FROM (
        SELECT *, na * nb / (na + nb) * (dx * dx * syy - 2 * dx * dy * sxy + dy * dy * sxx) / (sxx * syy - sxy * sxy) AS t2 FROM (SELECT na, nb, max_a - max_b AS dx, may_a - may_b AS dy,
        ((na - 1) * xa + (nb - 1) * xb) / (na + nb - 2) + 1e-6 AS sxx, ((na - 1) * ya + (nb - 1) * yb) / (na + nb - 2) + 1e-6 AS syy,
        ((na - 1) * ca + (nb - 1) * cb) / (na + nb - 2) AS sxy FROM (SELECT (count(*) FILTER (g = 'a'))::DOUBLE AS na, (count(*) FILTER (g = 'b'))::DOUBLE AS nb,
        avg(x) FILTER (g = 'a') AS max_a, avg(x) FILTER (g = 'b') AS max_b, avg(y) FILTER (g = 'a') AS may_a, avg(y) FILTER (g = 'b') AS may_b,
        var_samp(x) FILTER (g = 'a') AS xa, var_samp(x) FILTER (g = 'b') AS xb, var_samp(y) FILTER (g = 'a') AS ya, var_samp(y) FILTER (g = 'b') AS yb,
        covar_samp(x, y) FILTER (g = 'a') AS ca, covar_samp(x, y) FILTER (g = 'b') AS cb FROM src)))""",
        src=GROUPS,
    ),
)
def _(t):
    out = H.hotelling_t2(groups(t), ["x", "y"], "g", "a", "b").drop("p_value")
    return rounded(out, "pillai").withColumns({"t2": F.round("t2", 4), "f": F.round("f", 4)})


def vectors(t):
    return H.with_vector(t.embeddings, "embedding").select("vec_id", "label", "features")


# Sums of squares over the 64 dimensions, from the unnested vectors.
DIMS = {
    "e": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings",
    "cen": "SELECT label, d, avg(x) AS c, count(*) AS n FROM e GROUP BY 1, 2",
}


@query(
    "o10_silhouette",
    sql(
        """SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM (SELECT i, max(CASE WHEN own THEN s / (n - 1) END) AS a,
        min(CASE WHEN NOT own THEN s / n END) AS b, max(CASE WHEN own THEN n END) AS n FROM (SELECT p.i, p.l = p.m AS own, sum(dist) AS s, min(z.n) AS n FROM
        (SELECT x.vec_id AS i, x.label AS l, y.label AS m, list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda q: (q[1] - q[2]) ** 2)) AS dist
        FROM embeddings x, embeddings y) p JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) z ON z.label = p.m GROUP BY p.i, p.l, p.m) GROUP BY i)""",
    ),
)
def _(t):
    return rounded(H.silhouette(vectors(t), "features", "label").drop("quality"), "silhouette")


@query(
    "o11_calinski_harabasz",
    sql(
        """SELECT n, k, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM (SELECT sum((x - c) ** 2) AS w, count(DISTINCT vec_id) AS n, count(DISTINCT label) AS k
        FROM e JOIN cen USING (label, d)), (SELECT sum(n * (c - m) ** 2) AS b FROM cen JOIN (SELECT d, avg(x) AS m FROM e GROUP BY 1) USING (d))""",
        **DIMS,
    ),
)
def _(t):
    return rounded(H.calinski_harabasz(vectors(t), "features", "label"), "calinski_harabasz")


@query(
    "o12_davies_bouldin",
    sql(
        """SELECT round(avg(worst), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / dist) AS worst FROM sc a JOIN sc b ON a.label <> b.label JOIN
        (SELECT p.label AS i, q.label AS j, sqrt(sum((p.c - q.c) ** 2)) AS dist FROM cen p JOIN cen q USING (d) GROUP BY 1, 2) z ON z.i = a.label AND z.j = b.label GROUP BY 1)""",
        **DIMS,
        sc="""SELECT label, avg(r) AS s FROM (SELECT vec_id, label, sqrt(sum((x - c) ** 2)) AS r FROM e JOIN cen USING (label, d) GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def _(t):
    return rounded(H.davies_bouldin(vectors(t), "features", "label"), "davies_bouldin")


def draws_sql(replicates: int, *row_id: str) -> str:
    """Draw ``u`` of each row in each replicate, as ``operators.resample`` takes it."""
    a, b = (f"{hash_sql(*row_id, seed=s)} % {R.P}" for s in (42, 43))
    return f"SELECT *, (a + rep * b) % {R.P} AS u FROM (SELECT *, {a} AS a, {b} AS b FROM {{}}), (SELECT unnest(range(1, {replicates + 1})) AS rep)"


@query(
    "o13_permutation_baseline",
    sql(
        """SELECT 100::BIGINT AS replicates, round(och, 6) AS calinski_harabasz, round(avg(ch), 6) AS random_ch, (count(*) FILTER (ch >= och) + 1) / (count(*) + 1) AS p_ch,
        round(odb, 6) AS davies_bouldin, round(avg(db), 6) AS random_db, (count(*) FILTER (db <= odb) + 1) / (count(*) + 1) AS p_db
        FROM (SELECT rep, ch, db FROM chs JOIN dbs USING (rep) WHERE rep > 0), (SELECT ch AS och, db AS odb FROM chs JOIN dbs USING (rep) WHERE rep = 0) GROUP BY och, odb""",
        lab=f"""SELECT vec_id, 0 AS rep, label AS l FROM embeddings UNION ALL
        SELECT vec_id, rep, u % 10 FROM ({draws_sql(100, 'vec_id').format('embeddings')})""",
        e="SELECT vec_id, rep, l, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM lab JOIN embeddings USING (vec_id)",
        cen="SELECT rep, l, d, avg(x) AS c, count(*) AS n FROM e GROUP BY 1, 2, 3",
        chs="""SELECT rep, (b / (k - 1)) / (w / (n - k)) AS ch FROM (SELECT rep, sum((x - c) ** 2) AS w, count(DISTINCT vec_id) AS n, count(DISTINCT l) AS k
        FROM e JOIN cen USING (rep, l, d) GROUP BY 1) JOIN (SELECT rep, sum(n * (c - m) ** 2) AS b FROM cen JOIN (SELECT d, avg(x) AS m FROM e WHERE rep = 0 GROUP BY 1) USING (d)
        GROUP BY 1) USING (rep)""",
        sc="SELECT rep, l, avg(r) AS s FROM (SELECT rep, vec_id, l, sqrt(sum((x - c) ** 2)) AS r FROM e JOIN cen USING (rep, l, d) GROUP BY 1, 2, 3) GROUP BY 1, 2",
        dbs="""SELECT rep, avg(worst) AS db FROM (SELECT a.rep, a.l, max((a.s + b.s) / dist) AS worst FROM sc a JOIN sc b ON a.rep = b.rep AND a.l <> b.l JOIN
        (SELECT p.rep, p.l AS i, q.l AS j, sqrt(sum((p.c - q.c) ** 2)) AS dist FROM cen p JOIN cen q USING (rep, d) GROUP BY 1, 2, 3) z ON z.rep = a.rep AND z.i = a.l AND z.j = b.l
        GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def _(t):
    out = H.permutation_baseline(vectors(t), "features", "label", "vec_id", 10)
    return rounded(out, "calinski_harabasz", "random_ch", "davies_bouldin", "random_db")


@query("o14_bootstrap_cluster_stability")
def _(t):
    return rounded(H.cluster_stability(vectors(t), "features", "vec_id", 10), "ari")


@query(
    "o15_adjusted_rand_index",
    sql(
        """SELECT n, round((ri - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 9) AS ari FROM
        (SELECT sum(c * (c - 1) / 2) AS ri, CAST(sum(c) AS BIGINT) AS n FROM ct), (SELECT sum(c * (c - 1) / 2) AS ra FROM (SELECT sum(c) AS c FROM ct GROUP BY l_returnflag)),
        (SELECT sum(c * (c - 1) / 2) AS rb FROM (SELECT sum(c) AS c FROM ct GROUP BY l_linestatus))""",
        ct="SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1, 2",
    ),
)
def _(t):
    return H.adjusted_rand_index(t.lineitem, "l_returnflag", "l_linestatus").withColumn("ari", F.round("ari", 9))


WEIGHT = " + ".join(f"CAST(u >= {cut} AS INTEGER)" for cut in R.poisson_cuts())
WEIGHTED = f"SELECT *, {WEIGHT} AS w FROM ({draws_sql(1000, 'l_orderkey', 'l_linenumber', 'l_partkey').format('lineitem')})"
INTERVAL = "SELECT round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, count(*) AS replicates, round({}, 6) AS estimate FROM st"


@query(
    "o16_bootstrap_ci_mean",
    sql(
        INTERVAL.format("(SELECT avg(l_quantity) FROM lineitem)"),
        wt=WEIGHTED,
        st="SELECT rep, sum(l_quantity * w) / sum(w) AS stat FROM wt GROUP BY 1",
    ),
)
def _(t):
    out = H.bootstrap_ci(t.lineitem, "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(out, "ci_low", "ci_high", "estimate")


@query(
    "o16_bootstrap_ci_median",
    sql(
        INTERVAL.format("(SELECT quantile_cont(l_quantity, 0.5) FROM lineitem)"),
        wt=WEIGHTED,
        cells="SELECT rep, l_quantity AS x, sum(w) AS w FROM wt GROUP BY 1, 2",
        run="SELECT *, sum(w) OVER (PARTITION BY rep ORDER BY x) AS upto, sum(w) OVER (PARTITION BY rep) AS n FROM cells",
        st="SELECT rep, (min(x) FILTER (upto > (n - 1) // 2) + min(x) FILTER (upto > n // 2)) / 2 AS stat FROM run GROUP BY 1",
    ),
)
def _(t):
    out = H.bootstrap_ci(t.lineitem, "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"], median=True)
    return rounded(out, "ci_low", "ci_high", "estimate")


@query(
    "o16_bootstrap_ci_silhouette",
    sql(
        INTERVAL.format("(SELECT any_value(all_) FROM whole)"),
        wt=f"SELECT rep, vec_id, label, {WEIGHT} AS w FROM (SELECT 0 AS rep, vec_id, label, {R.poisson_cuts()[0]} AS u FROM embeddings UNION ALL SELECT rep, vec_id, label, u FROM ({draws_sql(1000, 'vec_id').format('embeddings')}))",
        pr="""SELECT x.vec_id AS i, y.vec_id AS j, CAST(list_sum([(x.embedding[d]::DOUBLE - y.embedding[d]::DOUBLE) ** 2 FOR d IN range(1, len(x.embedding) + 1)]) AS DOUBLE) AS dist
        FROM embeddings x, embeddings y""",
        far="SELECT rep, i, label AS m, sum(dist * w) AS s, sum(w) AS n FROM pr JOIN wt ON vec_id = j WHERE w > 0 GROUP BY 1, 2, 3",
        sil="""SELECT rep, i, max(CASE WHEN label = m THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN label <> m THEN s / n END) AS b, any_value(w) AS w
        FROM far JOIN wt USING (rep) WHERE vec_id = i AND w > 0 GROUP BY 1, 2""",
        al="SELECT rep, sum(w * coalesce((b - a) / greatest(a, b), 0)) / sum(w) AS stat FROM sil GROUP BY 1",
        whole="SELECT stat AS all_ FROM al WHERE rep = 0",
        st="SELECT * FROM al WHERE rep > 0",
    ),
)
def _(t):
    return rounded(H.bootstrap_silhouette(vectors(t), "features", "label", "vec_id"), "ci_low", "ci_high", "estimate")


PROPS = [("energy_range", "energy BETWEEN 0.4 AND 0.6", "energy", 0.2), ("valence_high", "valence > 0.7", "valence", 0.3), ("acoustic", "acousticness > 0.5", "acousticness", 0.5)]


@query(
    "o17_proportion_test",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS test_name, count({c}) AS n, count(*) FILTER ({cond}) AS hits, round(count(*) FILTER ({cond}) / count({c}), 6) AS statistic,
            round(abs(2 * (asin(sqrt(count(*) FILTER ({cond}) / count({c}))) - asin(sqrt({e})))), 6) AS effect_size FROM tracks"""
            for name, cond, c, e in PROPS
        ),
        "tracks",
    ),
)
def _(t):
    out = None
    for name, cond, c, e in PROPS:
        one = H.proportion_test(t.tracks, F.expr(cond), F.col(c), e, name)
        out = one if out is None else out.unionByName(one)
    return rounded(out.drop("p_value"), "statistic", "effect_size")


@query(
    "o18_correlation_test",
    """SELECT l_returnflag, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS ci_high FROM (
    SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def _(t):
    out = H.correlation_test(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("p_value")
    return rounded(out, "r", "ci_low", "ci_high")


@query(
    "o19_one_sample_t",
    sql(
        """SELECT artist_name, count(*) AS n, round(avg(energy), 6) AS mean, round(stddev_samp(energy), 6) AS sd, round((avg(energy) - 0.7) / (stddev_samp(energy) / sqrt(count(*))), 6) AS statistic,
        round(abs(avg(energy) - 0.7) / stddev_pop(energy), 6) AS effect_size FROM tracks GROUP BY 1""",
        "tracks",
    ),
)
def _(t):
    out = H.one_sample_t(t.tracks, "energy", 0.7, ["artist_name"]).drop("p_value")
    return rounded(out, "mean", "sd", "statistic", "effect_size")


# chi-square tail of one degree of freedom at s: 1 - erf(sqrt(s / 2)) by its series of positive terms
CHI2_ONE = """1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 3000), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(greatest(s, 1e-300) / 2) / 2
    + lgamma(n + 1) - lgamma(2 * n + 2) - s / 2)))"""


@query(
    "o20_change_count_test",
    sql(
        f"""SELECT signal, n, round(expected, 6) AS expected, observed, round(s, 6) AS statistic, round(abs(observed - expected) / greatest(expected, 1), 6) AS effect_size,
        CASE WHEN s > 700 THEN 0 ELSE round(greatest({CHI2_ONE}, 0), 6) END AS p_value FROM (SELECT *, (observed - expected) ** 2 / expected AS s FROM (SELECT signal, count(*) AS n, ln(count(*)) AS expected,
        (SELECT count(idx) FROM kept WHERE kept.signal = signals.signal) AS observed FROM signals GROUP BY 1))""",
        "signals",
        sh=SHIFT,
        **SPACED,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(t):
    return rounded(H.change_count_test(t.signals, ["signal"], "date", "x"), "expected", "statistic", "effect_size", "p_value")


@query(
    "o21_decay_test",
    sql(
        """SELECT series, n, round(slope, 6) AS slope, round(se, 6) AS se, round(slope / se, 4) AS statistic, round(slope - 1.96 * se, 6) AS ci_low, round(slope + 1.96 * se, 6) AS ci_high
        FROM (SELECT series, count(*) AS n, regr_slope(ly, x) AS slope, sqrt((1 - regr_r2(ly, x)) * regr_syy(ly, x) / (count(*) - 2) / regr_sxx(ly, x)) AS se FROM v GROUP BY 1)""",
        "history",
        c=DECAY["c"],
        v=DECAY["v"],
    ),
)
def _(t):
    out = H.decay_test(curve(t), ["series"], "days_ahead", "accuracy").select("series", "n", "slope", "se", "statistic", "ci_low", "ci_high")
    return rounded(out, "slope", "se", "ci_low", "ci_high").withColumn("statistic", F.round("statistic", 4))


@query(
    "o22_threshold_at_horizon",
    sql(
        " UNION ALL ".join(
            f"""SELECT series, {d} AS days, round(accuracy, 6) AS observed, {e}::DOUBLE AS expected, round((accuracy - {e}) / 0.05, 6) AS statistic,
            round(abs(accuracy - {e}) / 0.05, 6) AS effect_size FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY abs(days_ahead - {d}), days_ahead) = 1"""
            for d, e in ((7, 0.9), (30, 0.6), (90, 0.3))
        ),
        "history",
        c=DECAY["c"],
    ),
)
def _(t):
    out = None
    for d in (7, 30, 90):
        one = H.threshold_at_horizon(curve(t), ["series"], "days_ahead", "accuracy", d).withColumn("days", F.lit(d))
        out = one if out is None else out.unionByName(one)
    return rounded(out.drop("p_value"), "observed", "statistic", "effect_size")


FACTORS = "SELECT artist_name, avg(energy) AS e, avg(valence) AS v FROM tracks GROUP BY 1"


@query(
    "o23_count_tests",
    sql(
        """SELECT test_name, n, hits, expected, in_range, round(abs(2 * (asin(sqrt(hits / n)) - asin(sqrt(expected)))), 6) AS effect_size FROM (
        SELECT 'interpretable' AS test_name, count(*) AS n, count(*) FILTER (e > 0.52) AS hits, 0.7::DOUBLE AS expected, count(*) FILTER (e > 0.52) BETWEEN 3 AND 7 AS in_range FROM f
        UNION ALL SELECT 'cross_class', count(*), count(*) FILTER (e > 0.5 AND v > 0.5), 0.2, count(*) FILTER (e > 0.5 AND v > 0.5) >= 1 FROM f)""",
        "tracks",
        f=FACTORS,
    ),
)
def _(t):
    f = t.tracks.groupBy("artist_name").agg(F.avg("energy").alias("e"), F.avg("valence").alias("v"))
    out = H.count_tests(f, F.col("e") > 0.52, (F.col("e") > 0.5) & (F.col("v") > 0.5))
    return rounded(out.drop("p_value"), "effect_size")


RECORDS = """SELECT artist_name AS hypothesis, genres = 'ECONOMY' AS is_primary, abs(avg(energy) - 0.5) > 0.04 AS significant,
    abs(avg(energy) - 0.5) / nullif(stddev_samp(energy), 0) AS effect_size, least(1, count(*) / 20) AS power FROM tracks GROUP BY artist_name, genres"""


def records(t):
    m = F.abs(F.avg("energy") - 0.5)
    return t.tracks.groupBy(F.col("artist_name").alias("hypothesis"), "genres").agg(
        (m > 0.04).alias("significant"), F.try_divide(m, F.stddev_samp("energy")).alias("effect_size"), F.least(F.lit(1.0), F.count("*") / 20).alias("power")
    ).withColumn("is_primary", F.col("genres") == "ECONOMY")


@query(
    "o24_evidence_rollup",
    sql(
        """SELECT *, CASE WHEN (primary_significant AND pe > 0.1) OR share_significant >= 0.75 THEN 'strong' WHEN primary_significant OR share_significant >= 0.5
        THEN 'moderate' ELSE 'weak' END AS evidence FROM (SELECT hypothesis, count(*) AS n_tests, count(*) FILTER (significant) AS n_significant,
        bool_or(is_primary AND significant) AS primary_significant, max(effect_size) FILTER (is_primary) AS pe, round(max(effect_size) FILTER (is_primary), 6) AS primary_effect,
        round(avg(power), 6) AS mean_power, round(min(power), 6) AS min_power, round(count(*) FILTER (significant) / count(*), 6) AS share_significant FROM rec GROUP BY 1)""".replace(
            "SELECT *, CASE", "SELECT hypothesis, n_tests, n_significant, primary_significant, primary_effect, mean_power, min_power, share_significant, CASE"
        ),
        "tracks",
        rec=RECORDS,
    ),
)
def _(t):
    out = H.evidence_rollup(records(t), "hypothesis", 0.1)
    return rounded(out, "primary_effect", "mean_power", "min_power", "share_significant")


@query(
    "o25_class_difference_by_feature",
    sql(
        """SELECT feature, na AS n_a, nb AS n_b, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS effect_size
        FROM (SELECT feature, count(*) FILTER (s = 'a') AS na, count(*) FILTER (s = 'b') AS nb, avg(x) FILTER (s = 'a') AS ma, avg(x) FILTER (s = 'b') AS mb,
        var_samp(x) FILTER (s = 'a') AS va, var_samp(x) FILTER (s = 'b') AS vb FROM u GROUP BY 1)""",
        "tracks",
        u=" UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN energy > valence THEN 'a' ELSE 'b' END AS s, {f} AS x FROM tracks" for f in ("danceability", "acousticness", "tempo")),
    ),
)
def _(t):
    out = H.class_difference_by_feature(t.tracks, ["danceability", "acousticness", "tempo"], "energy", "valence")
    return rounded(out.select("feature", "n_a", "n_b", "t", "effect_size"), "t", "effect_size")
