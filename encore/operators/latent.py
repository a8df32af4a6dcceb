"""Features, interaction matrices and latent factors (L1-L12)."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.functions.tails import t_two_sided_col
from encore.operators import sides
from encore.operators.quality import min_support, unpivot
from encore.operators.ranking import top_k_per_group
from encore.operators.scan import HotCells, numbered
from encore.operators.stats import with_vector
from encore.session import checkpointed, scratch_folder, ship_package

# Keys and counters that are never standardised.
NOT_SCALED = ["user_id", "track_id", "artist_id", "session_no", "year", "month", "day_of_week", "hour"]


def standardise(df: DataFrame, cols: Sequence[str] | None = None, skip: Sequence[str] = NOT_SCALED) -> DataFrame:
    """Z-scores with the population std; a constant column becomes 0. One aggregate pass for all columns."""
    if cols is None:
        cols = [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint") and c not in skip]
    stats = df.select(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
    ).scalar()
    out = df.withColumn("__z", stats)
    z = {c: F.when(F.col(f"__z.{c}.s") > 0, (F.col(c) - F.col(f"__z.{c}.m")) / F.col(f"__z.{c}.s")).otherwise(F.lit(0.0)) for c in cols}
    return out.withColumns(z).drop("__z")


def feature_table(plays: DataFrame, tracks: DataFrame, ts: str, user: str, item: str, artist: str, label: str, row_id: str, scores: Sequence[str]) -> DataFrame:
    """Calendar, session, audio, class, behaviour and interaction features of each play, in a fixed order.

    Each scan reads its rows several times, so what a scan gives is stored; otherwise the next one repeats all scans before it.
    """
    from encore.operators import joins as J
    from encore.operators import sessions as S
    from encore.operators.scan import hot_cells

    hour = F.hour(ts)
    sin, cos = C.cyclical(hour, 24)
    out = plays.withColumns(
        {
            "hour": hour, "day_of_week": F.weekday(ts), "month": F.month(ts), "time_of_day": C.time_of_day_bins(hour),
            "is_weekend": C.weekend_flag(ts), "season": C.season(F.month(ts)), "hour_sin": sin, "hour_cos": cos,
        }
    )
    out = checkpointed(S.sessionize(out, ts, [user], row_id))
    out = J.attach_group_stats(
        out, [user, "session_no"], [F.count("*").alias("session_plays"), F.countDistinct(label).alias("session_classes")]
    )
    out = J.attach_features(out, tracks, item)
    first = scores[0]
    out = out.withColumns(
        {
            "session_share": F.col("session_position") / F.col("session_plays"),
            "tempo_category": C.tempo_category("tempo"),
            "energy_valence": F.col("energy") * F.col("valence"),
            "morning_score": C.when_score(hour.between(6, 12), first),
            "high_energy_score": C.when_score(F.col("energy") > 0.7, first),
        }
    )
    out = checkpointed(S.transition_flag(checkpointed(out), [user], [ts, row_id], label, hot_cells()))
    out = checkpointed(S.time_since_last_same(out, item, ts, row_id, "hours_since_track"))
    out = S.group_count(out, item, "track_plays", "is_single_play")
    return S.user_totals(out, user, item, artist, first)


# Name parts of the feature groups.
FEATURE_GROUPS = {
    "temporal": ["hour", "day", "month", "season", "time_of_day", "weekend"],
    "session": ["session"],
    "audio": ["energy", "valence", "danceability", "acousticness", "tempo"],
    "behavioural": ["plays", "since", "user_", "single", "deviation"],
    "interaction": ["_score", "transition"],
}


def feature_groups(df: DataFrame) -> dict[str, list[str]]:
    """Columns by the first group one of whose name parts they contain."""
    out: dict[str, list[str]] = {g: [] for g in FEATURE_GROUPS}
    for c in df.columns:
        group = next((g for g, parts in FEATURE_GROUPS.items() if any(p in c for p in parts)), None)
        if group:
            out[group].append(c)
    return out


#: Rows of one part of a table that is read again in each round of a fit.
PART_ROWS = 250_000


def even_parts(df: DataFrame, by: str) -> DataFrame:
    """The stored rows in parts of about ``PART_ROWS``; a table whose files cannot be split gives parts of any size otherwise."""
    n = -(-df.count() // PART_ROWS)
    return df if n <= 1 else df.repartition(n, by)


def audio_clusters(tracks: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """K-means on standardised features; needs at least five of them, otherwise the rows pass unchanged."""
    if len(features) < 5:
        return tracks
    scaled = with_vector(standardise(tracks.na.fill(0.0, list(features)), features), features)
    # parts by the hash of the whole row, so that neither how files are split nor equal features fill one of them
    stored = checkpointed(scaled.select(*features, F.xxhash64(*tracks.columns).alias("__h")))
    fitted = with_vector(even_parts(stored, "__h"), features)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="audio_cluster").fit(fitted)
    return model.transform(scaled).drop("features")


def interaction_matrix(
    df: DataFrame, user: str, item: str, value: str | None = None, min_user: int = 1, min_item: int = 1, rows_per_cell: int = 1_000_000,
    indices: Sequence[str] = ("user_idx", "item_idx"),
) -> DataFrame:
    """(user, item, user_idx, item_idx, rating): support filter, summed ratings, contiguous indices in key order.

    An index that is not among ``indices`` is left out with its numbering and join.
    """
    kept = min_support(df, user, item, min_user, min_item)
    cells = kept.groupBy(user, item).agg((F.sum(value) if value else F.count("*")).alias("__v"))
    # read up to three times below, so it is written once
    rated = checkpointed(cells.withColumn("rating", C.implicit_rating("__v")).drop("__v"))
    for key, idx in ((user, "user_idx"), (item, "item_idx")):
        if idx not in indices:
            continue
        # a numbering reads its keys several times, and the planner knows the size of a stored one
        ids = checkpointed(numbered(checkpointed(rated.select(key).distinct()), [], [key], HotCells(rows_per_cell)))
        rated = rated.join(ids.select(key, (F.col("row_no") - 1).alias(idx)), key)
    return rated.select(user, item, *[c for c in ("user_idx", "item_idx") if c in indices], "rating")


def sparsity(matrix: DataFrame) -> DataFrame:
    row = matrix.agg((F.max("user_idx") + 1).alias("n_users"), (F.max("item_idx") + 1).alias("n_items"), F.count("*").alias("n_cells"))
    return row.withColumn("sparsity", 1 - F.try_divide(F.col("n_cells"), F.col("n_users") * F.col("n_items")))


#: Random directions beyond the wanted factors, R factors that one task merges, and cells of a block of the matrix.
OVERSAMPLED, FAN_IN, BLOCK_CELLS = 10, 64, 750_000
#: Blocks of a small matrix, so that its products use all cores, and cells of one at least.
TASKS, TASK_CELLS = 24, 50_000


def _by_window(batch: pa.RecordBatch, by: Sequence[str], cols: Sequence[str]) -> tuple[np.ndarray, list]:
    """Factor columns of a batch as a matrix, and (window, its rows) pairs."""
    values = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in cols], axis=1)
    if not by:
        return values, [(None, slice(None))]
    keys = batch[by[0]].to_pylist()
    return values, [(w, np.array([i for i, k in enumerate(keys) if k == w])) for w in sorted(set(keys))]


def _qr(df: DataFrame, cols: Sequence[str], by: Sequence[str], turns: dict | None = None) -> dict:
    """R factor of the rows (turned, if given) of each window: each task reduces its rows to one R, and R factors are merged as a tree."""
    kind = f"{by[0]} {df.schema[by[0]].dataType.simpleString()}, " if by else ""
    k = len(cols)

    def reduced(groups: dict, like: pa.RecordBatch) -> pa.RecordBatch:
        found = [(w, np.linalg.qr(np.vstack(r), mode="r")) for w, r in groups.items()]
        columns = [pa.array([w for w, _ in found], like[by[0]].type)] if by else []
        return pa.RecordBatch.from_arrays([*columns, pa.array([r.ravel().tolist() for _, r in found], pa.list_(pa.float64()))], [*by, "r"])

    def local(batches):
        groups: dict = {}
        for batch in batches:
            values, parts = _by_window(batch, by, cols)
            for w, at in parts:
                groups.setdefault(w, []).append(values[at] if turns is None else values[at] @ turns[w])
                if len(groups[w]) > 8:
                    groups[w] = [np.linalg.qr(np.vstack(groups[w]), mode="r")]
        if groups:
            yield reduced(groups, batch)

    def merged(batches):
        groups: dict = {}
        for batch in batches:
            for i, r in enumerate(batch["r"].to_pylist()):
                groups.setdefault(batch[by[0]][i].as_py() if by else None, []).append(np.array(r).reshape(-1, k))
        if groups:
            yield reduced(groups, batch)

    rs = checkpointed(df.select(*by, *cols).mapInArrow(local, kind + "r array<double>"))
    tasks = rs.count()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        rs = checkpointed(rs.repartition(tasks).mapInArrow(merged, kind + "r array<double>"))
    groups: dict = {}
    for row in rs.collect():
        groups.setdefault(row[by[0]] if by else None, []).append(np.array(row["r"]).reshape(-1, k))
    return {w: np.linalg.qr(np.vstack(r), mode="r") for w, r in groups.items()}


def _rotate(df: DataFrame, keys: Sequence[str], cols: Sequence[str], by: Sequence[str], turns: dict) -> DataFrame:
    """Rows times the small matrix of their window."""
    width = next(iter(turns.values())).shape[1] if turns else len(cols)
    new = [f"f{i}" for i in range(width)]
    ddl = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} double" for c in new)])

    def turned(batches):
        for batch in batches:
            values, parts = _by_window(batch, by, cols)
            out = np.zeros((len(values), width))
            for w, at in parts:
                out[at] = values[at] @ turns[w]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), *(pa.array(out[:, i]) for i in range(width))], [*keys, *new])

    return df.select(*keys, *cols).mapInArrow(turned, ddl)


def _orthonormal(rs: dict) -> dict:
    """Matrices that make the columns orthonormal, given their R factors; directions without length become 0."""
    out = {}
    for w, r in rs.items():
        _, s, v = np.linalg.svd(r)
        s = np.append(s, np.zeros(r.shape[1] - len(s)))
        keep = s > max(s.max(initial=0.0), 1e-300) * 1e-13
        out[w] = v.T * np.where(keep, 1.0 / np.where(keep, s, 1.0), 0.0)
    return out


class _Blocks:
    """The cells (``by``, user, item, x) in files of the shared folder, by blocks of whole users and by blocks of whole items.

    A block is a hash of (``by``, key). A product reads the factors of one side block by block in the tasks of the other side
    (``sides``), so it writes one row per key whatever the number of blocks, and sums never meet in a shuffle. Blocks
    and their cells both grow as the root of the cells: what is read grows with cells x blocks, memory with one block.
    Only items of more cells than a block are cut: they have no block of their own and are summed apart in the blocks of users.
    """

    def __init__(self, data: DataFrame, by: Sequence[str], user: str, item: str, cols: Sequence[str] = (), cut: bool = True):
        self.by, self.user, self.item, self.cols, self.kind = list(by), user, item, list(cols), dict(data.dtypes)
        self.spark = data.sparkSession
        ship_package(self.spark)
        count = data.count()
        size = max(BLOCK_CELLS, isqrt(count * BLOCK_CELLS // 8))
        self.n = max(1, -(-count // size), min(TASKS, -(-count // TASK_CELLS)))
        busy = data.filter(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count("*").alias("__n")).filter(F.col("__n") > size)
        self.busy = checkpointed(busy.select(*by, item)) if cut else None
        self.cut = cut and not self.busy.isEmpty()
        whole = data.join(self.busy, [*by, item], "left_anti") if self.cut else data
        self.side = {user: self.dealt(data, user, item), item: self.dealt(whole, item, user)}
        self.cells = self.spark.read.parquet(self.side[user])

    def block(self, on: str) -> Column:
        return F.pmod(F.hash(*[F.col(c).cast(self.kind[c]) for c in (*self.by, on)]), F.lit(self.n))

    def dealt(self, data: DataFrame, own: str, other: str) -> str:
        """A folder of cells by blocks of ``own``; a task has about one block."""
        folder = scratch_folder(self.spark)
        parts = data.select(*self.by, own, other, "__x", self.block(own).alias("__b"), self.block(other).alias("__o"))
        parts = parts.repartition(self.n, *self.by, own).sortWithinPartitions("__b", "__o", *self.by, own)
        parts.write.partitionBy("__b").parquet(folder)
        return folder

    def routed(self, on: str, factors: DataFrame) -> DataFrame:
        """Factor rows with the block of their key."""
        return factors.select(*self.by, on, *self.cols, self.block(on).alias("__b"))

    def stored(self, on: str, sent: DataFrame) -> str:
        folder = sides.create(scratch_folder(self.spark))
        plain = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
        sent.repartition(self.n, *self.by, on).write.mode("append").options(**plain).partitionBy("__b").parquet(folder)
        return folder

    def ddl(self, *keys: str) -> str:
        return ", ".join([*(f"{c} {self.kind[c]}" for c in (*self.by, *keys)), *(f"{c} double" for c in self.cols)])

    def rows(self, on: str, folder: str) -> DataFrame:
        return self.spark.read.schema(self.ddl(on)).parquet(folder).select(*self.by, on, *self.cols)

    def drop(self, folder: str) -> None:
        """Remove a folder of factors that no later step reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        for folder in self.side.values():
            self.drop(folder)

    def swept(self, own: str, on: str, folder: str, turns: dict | None = None, nulls: bool = False, then: dict | None = None) -> tuple[str, dict]:
        """The folder of the sums of x times the (turned) factor rows over the cells of each ``own`` key, and their R factor (``then`` turned)."""
        by, cols, side, out = self.by, self.cols, self.side[own], sides.create(scratch_folder(self.spark))
        kind = f"{by[0]} {self.kind[by[0]]}, " if by else ""
        k, named = len(cols), own == self.user and not nulls  # in a round, a user without a name meets nothing

        def task(batches):
            for batch in batches:
                for block in batch["id"].to_pylist():
                    found = sides.swept(side, block, folder, by, own, on, cols, turns, nulls, named)
                    if found is None:
                        continue
                    keys, sums = found
                    table = keys
                    for i, c in enumerate(cols):
                        table = table.append_column(c, pa.array(sums[:, i]))
                    sides.write(out, block, table)
                    rs = [(w, np.linalg.qr(sums[at] if then is None else sums[at] @ then[w], mode="r")) for w, at in sides.windows_of(keys, by)]
                    lead = [pa.array([w for w, _ in rs], keys.schema.field(by[0]).type)] if by else []
                    yield pa.RecordBatch.from_arrays([*lead, pa.array([r.ravel().tolist() for _, r in rs], pa.list_(pa.float64()))], [*by, "r"])

        groups: dict = {}
        for row in self.spark.range(0, self.n, 1, self.n).mapInArrow(task, kind + "r array<double>").collect():  # one small R per block
            groups.setdefault(row[by[0]] if by else None, []).append(np.array(row["r"]).reshape(-1, k))
        return out, {w: np.linalg.qr(np.vstack(r), mode="r") for w, r in groups.items()}

    def times(self, sent: DataFrame, on: str, to: str, turns: dict | None = None) -> DataFrame:
        """Sum of x times the factor row (turned by the matrix of its window) over the cells of each user, or of each busy item."""
        folder = self.stored(on, sent)
        if to == self.user:
            out = self.swept(to, on, folder, turns, True)[0]
            self.drop(folder)
            return self.rows(to, out)
        by, cols, side = self.by, self.cols, self.side[self.user]
        wanted = sides.create(scratch_folder(self.spark))
        self.busy.coalesce(1).write.mode("append").parquet(f"{wanted}/__b=0")

        def task(batches):
            for batch in batches:
                for block in batch["id"].to_pylist():
                    cells, few = sides.read(side, block, [*by, on, to, "__x", "__o"]), sides.read(wanted, 0, [*by, to])
                    if cells is None or few is None:
                        continue
                    cells = cells.filter(pa.array(sides.matched(cells, few, by, to, False) >= 0))
                    keys, where = sides.places(cells, by, to)
                    rows = sides.read(folder, block, [*by, on, *cols])
                    if rows is None or not keys.num_rows:
                        continue
                    at = sides.matched(cells, rows, by, on, True)
                    here, sums = np.flatnonzero(at >= 0), np.zeros((keys.num_rows, len(cols)))
                    sides.add(sums, where[here], sides.matrix(rows, cols, by, turns)[at[here]] * cells["__x"].to_numpy()[here, None])
                    for i, c in enumerate(cols):
                        keys = keys.append_column(c, pa.array(sums[:, i]))
                    yield from keys.combine_chunks().to_batches()

        partial = self.spark.range(0, self.n, 1, self.n).mapInArrow(task, self.ddl(to))
        return partial.groupBy(*by, to).agg(*[F.sum(c).alias(c) for c in cols])

    def solved(self, own: str, on: str, folder: str, cols: Sequence[str], reg: float) -> str:
        """The folder of the non-negative factors of each ``own`` key, given those of the other side."""
        side, out = self.side[own], sides.create(scratch_folder(self.spark))

        def task(batches):
            for batch in batches:
                for block in batch["id"].to_pylist():
                    found = sides.solved(side, block, folder, own, on, cols, reg)
                    if found is not None:
                        sides.write(out, block, found)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["done"])

        self.spark.range(0, self.n, 1, self.n).mapInArrow(task, "done long").collect()  # one row per block
        return out

    def squares(self, users: str, items: str, cols: Sequence[str]) -> tuple[float, int]:
        """Sum of squared errors over all cells, and their number."""
        side, user, item = self.side[self.user], self.user, self.item

        def task(batches):
            for batch in batches:
                found = [sides.squares(side, block, users, items, user, item, cols) for block in batch["id"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["total", "n"])

        rows = self.spark.range(0, self.n, 1, self.n).mapInArrow(task, "total double, n long").collect()  # one row per block
        return sum(r["total"] for r in rows), sum(r["n"] for r in rows)

    def drawn(self, values: Sequence[Column]) -> DataFrame:
        """Products of factor rows that follow from the item, null among them."""
        here = self.cells.select(*self.by, self.item).distinct()
        return self.times(self.routed(self.item, here.select(*self.by, self.item, *values)), self.item, self.user)

    def there_and_back(self, users: str, turns: dict) -> tuple[str, str, dict, dict]:
        """For z, the items' sums of x times the (turned) user rows in a folder: folders of z and of the users' sums of x times z,
        the matrix that makes z orthonormal, and the R factor of the users' sums times it."""
        by, cols, user, item = self.by, self.cols, self.user, self.item
        z, rz = self.swept(item, user, users, turns)
        if not self.cut:
            turn = _orthonormal(rz)
            back, r = self.swept(user, item, z, then=turn)
            return z, back, turn, r
        known = self.rows(user, users).filter(F.col(user).isNotNull())
        few = checkpointed(self.times(self.routed(user, known), user, item, turns))
        for w, r in _qr(few, cols, by).items():
            rz[w] = np.linalg.qr(np.vstack([r, rz[w]]) if w in rz else r, mode="r")
        turn = _orthonormal(rz)
        back = self.rows(user, self.swept(user, item, z)[0]).unionByName(self.times(self.routed(item, few), item, user)).filter(F.col(user).isNotNull())
        back = self.stored(user, self.routed(user, back.groupBy(*by, user).agg(*[F.sum(c).alias(c) for c in cols])))
        self.routed(item, few).write.mode("append").partitionBy("__b").parquet(z)
        return z, back, turn, _qr(self.rows(user, back), cols, by, turn)


def svd_factors(
    matrix: DataFrame, user: str, item: str, rating: str, k: int = 20, iterations: int = 3, seed: int = 42, window: str | None = None,
    wanted: Sequence[str] = ("users", "items"),
) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Truncated SVD by a randomised range finder: (user factors U*S, item factors V, singular values).

    Factors stay in the shared folder, one file per block of keys and one column per component; each round
    multiplies the blocks of the matrix by the user rows and back (``_Blocks.there_and_back``). Columns are made
    orthonormal from their R factor (a tall and thin QR, merged), which
    does not square the condition as inner products would. The driver sees R
    factors only. ``window`` factorises the matrix of each window in the same jobs; its
    column then leads the results. Factors that are not ``wanted`` come as None.
    """
    ship_package(matrix.sparkSession)
    by = [window] if window else []
    cols = [f"f{i}" for i in range(k + OVERSAMPLED)]
    data = checkpointed(matrix.select(*by, user, item, F.col(rating).cast("double").alias("__x")))
    noise = [(F.pmod(F.xxhash64(item, F.lit(seed + i)), F.lit(20011)) / 10005.5 - 1).alias(c) for i, c in enumerate(cols)]
    blocks = _Blocks(data, by, user, item, cols)
    y = blocks.stored(user, blocks.routed(user, blocks.drawn(noise)))
    z, turn, r = None, None, _qr(blocks.rows(user, y), cols, by)
    for _ in range(max(1, iterations)):
        # y is kept as summed; its true columns are those times ``turn``
        found = _orthonormal(r)
        into = found if turn is None else {w: turn[w] @ m for w, m in found.items()}
        old = [f for f in (y, z) if f]
        z, y, turn, r = blocks.there_and_back(y, into)
        for folder in old:
            blocks.drop(folder)
    blocks.release()
    small = {w: np.linalg.svd(m) for w, m in r.items()}
    rotate = {w: turn[w] @ vt.T[:, :k] for w, (_, _, vt) in small.items()}
    total = {r[0] if by else None: r["t"] or 1.0 for r in data.groupBy(*by).agg(F.sum(F.col("__x") * F.col("__x")).alias("t")).collect()}
    rows = []
    for w, (_, s, _) in small.items():
        s = np.append(s, np.zeros(max(0, k - len(s))))[:k]
        rows += [(*([w] if by else []), i, float(x), float(x * x / (total[w] or 1.0))) for i, x in enumerate(s)]
    kind = f"{window} {data.schema[window].dataType.simpleString()}, " if by else ""
    spectrum = matrix.sparkSession.createDataFrame(rows, kind + "factor int, singular_value double, explained double")
    users, items = (_rotate(blocks.rows(on, f), [*by, on], cols, by, rotate) if name in wanted else None for name, on, f in (("users", user, y), ("items", item, z)))
    for name, folder in (("users", y), ("items", z)):
        if name not in wanted:
            blocks.drop(folder)
    return users, items, spectrum


def _rated(matrix: DataFrame, user: str, item: str, rating: str) -> _Blocks:
    """The cells max(x, 0) for non-negative fits, whole users and whole items in their blocks."""
    cells = matrix.select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i"), F.greatest(rating, F.lit(0.0)).cast("double").alias("__x"))
    return _Blocks(checkpointed(cells), [], "u", "i", cut=False)


def nmf_factors(
    matrix: DataFrame, user: str, item: str, rating: str, k: int = 15, reg: float = 0.01, seed: int = 42, iterations: int = 10, blocks: _Blocks | None = None,
):
    """Non-negative factorisation of max(x, 0) by alternating least squares: (user factors, item factors, error).

    The first user factors are those of the library's ALS, which sees one cell per user and makes no
    round. Each half of a round solves the normal equations of the keys of one side where its
    blocks lie (``sides.solved``), reading the factors of the other side from the shared folder; a
    task holds one block, and each factor is written once per round. ``blocks`` are those of
    ``_rated``, if they exist already.

    The library takes 32-bit ids, so ``user`` and ``item`` are contiguous indices
    (``interaction_matrix`` numbers them) of at most 2^31 users and items; a larger
    one is an error under ANSI casts.
    """
    spark = matrix.sparkSession
    ship_package(spark)
    # the library cuts the lineage of its factors there
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_folder(spark))
    kept = _rated(matrix, user, item, rating) if blocks is None else blocks
    cols = [f"f{i}" for i in range(k)]
    known = kept.cells.select("u").distinct().select("u", F.lit(0).alias("i"), F.lit(1.0).alias("x"))
    als = ALS(rank=k, maxIter=0, regParam=reg, nonnegative=True, userCol="u", itemCol="i", ratingCol="x", seed=seed, checkpointInterval=1)
    first = als.fit(known).userFactors.select(F.col("id").alias("u"), *[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
    users, items = kept.stored("u", first.withColumn("__b", kept.block("u"))), None
    for _ in range(iterations):
        old = [f for f in (users, items) if f]
        items = kept.solved("i", "u", users, cols, reg)
        users = kept.solved("u", "i", items, cols, reg)
        for folder in old:
            kept.drop(folder)
    total, cells = kept.squares(users, items, cols)
    error = spark.createDataFrame([(total**0.5 if cells else None, cells)], "reconstruction_error double, n_cells long")
    if blocks is None:
        kept.release()
    ddl = ", ".join(f"{c} float" for c in cols)
    named = lambda on, name, f: spark.read.schema(f"{on} int, {ddl}").parquet(f).select(F.col(on).alias(name), F.array(*cols).alias("features"))
    return named("u", user, users), named("i", item, items), error


def factor_sweep(matrix: DataFrame, user: str, item: str, rating: str, counts: Sequence[int] = (3, 5, 7, 10, 15), iterations: int = 5) -> DataFrame:
    """Explained share and reconstruction error for each factor count: the whole curve, for an elbow or a threshold.

    The spectra of fewer factors are the first values of one factorisation with the
    most; the non-negative fits run two at a time over the same blocks of the matrix.
    """
    matrix = checkpointed(matrix.select(user, item, rating))
    spectrum = svd_factors(matrix, user, item, rating, max(counts), wanted=())[2]
    blocks = _rated(matrix, user, item, rating)
    with ThreadPoolExecutor(2) as pool:
        errors = list(pool.map(lambda k: nmf_factors(matrix, user, item, rating, k, iterations=iterations, blocks=blocks)[2].first(), counts))
    blocks.release()
    found = [(e["reconstruction_error"], e["n_cells"], k) for e, k in zip(errors, counts)]
    rows = matrix.sparkSession.createDataFrame(found, "reconstruction_error double, n_cells long, n_factors int")
    return rows.join(spectrum, F.col("factor") < F.col("n_factors")).groupBy("n_factors", "reconstruction_error", "n_cells").agg(F.sum("explained").alias("explained"))


def long_factors(item_factors: DataFrame, item: str) -> DataFrame:
    """ALS factor arrays as (item, factor, loading) rows."""
    return item_factors.select(item, F.posexplode("features").alias("factor", "loading"))


def interpret_factors(loadings: DataFrame, items: DataFrame, item: str, features: Sequence[str], min_r: float = 0.3, alpha: float = 0.05) -> DataFrame:
    """Pearson r of each factor with each item feature, with its p-value and whether it is kept."""
    long = unpivot(items, features, "feature", "x", "double", [item])
    out = loadings.join(long, item).groupBy("factor", "feature").agg(
        F.corr("loading", "x").alias("r"), F.count("*").alias("n"), F.stddev_pop("loading").alias("factor_strength")
    )
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-15)))
    out = out.withColumn("p_value", t_two_sided_col(t, F.col("n") - 2))
    return out.withColumn("kept", (F.abs("r") > min_r) & (F.col("p_value") < alpha))


def factor_sentences(interpreted: DataFrame) -> DataFrame:
    """One sentence per factor from its three strongest kept correlations."""
    kept = interpreted.filter("kept")
    top = top_k_per_group(kept, ["factor"], [F.desc(F.abs("r")), F.col("feature")], 3)
    part = F.concat(F.when(F.col("r") > 0, "high ").otherwise("low "), "feature")
    text = top.groupBy("factor").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("t")))).alias("p"))
    named = text.select("factor", F.concat_ws(", ", F.transform("p", lambda x: x["t"])).alias("interpretation"))
    every = interpreted.select("factor").distinct()
    return every.join(named, "factor", "left").withColumn("interpretation", F.coalesce("interpretation", F.lit("uninterpretable")))


def factor_stability(df: DataFrame, user: str, item: str, value: str, window: str, windows: Sequence | None = None, k: int = 3, min_rows: int = 100, iterations: int = 3) -> DataFrame:
    """|r| of same-index user factors of consecutive windows, aligned on the user: mean, std, min, max.

    All windows are factorised in the same jobs; they are a short list of labels, by default all of the table.
    """
    cols = [f"f{i}" for i in range(k)]
    known = df.filter(F.col(window).isNotNull() if windows is None else F.col(window).isin(*windows))
    sized = known.groupBy(window).agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    usable = [r[window] for r in sized.orderBy(window).select(window).collect()]  # at most one row per window
    if len(usable) < 2:
        raise ValueError("fewer than two windows with enough rows")
    rated = known.filter(F.col(window).isin(*usable)).groupBy(window, user, item).agg(F.sum(value).alias("__v"))
    users = svd_factors(rated.withColumn("__r", C.implicit_rating("__v")), user, item, "__r", k, iterations, window=window, wanted=["users"])[0]
    place = F.array_position(F.array(*[F.lit(w) for w in usable]), F.col(window))
    users = checkpointed(users.withColumn("__p", place))
    after = users.select(user, (F.col("__p") - 1).alias("__p"), *[F.col(c).alias(f"n_{c}") for c in cols])
    pair = users.join(after, [user, "__p"]).groupBy("__p").agg(*[F.abs(F.corr(c, f"n_{c}")).alias(c) for c in cols], F.count("*").alias("n_users"))
    out = unpivot(pair, cols, "factor", "r", "double", ["__p", "n_users"])
    return out.groupBy("factor").agg(
        F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.count("*").alias("n_pairs")
    )


def top_items_per_factor(loadings: DataFrame, item: str, k: int = 20) -> DataFrame:
    return top_k_per_group(loadings, ["factor"], [F.desc("loading"), F.col(item)], k)


def factor_artists(top: DataFrame, plays: DataFrame, item: str, artist: str, k: int = 10) -> DataFrame:
    """Per factor the ``k`` artists with most of its top items: ``top_artists`` as (artist, items), most items first, ties by artist."""
    held = top.select("factor", item).join(plays.select(item, artist).distinct(), item)
    counts = top_k_per_group(held.groupBy("factor", artist).agg(F.count("*").alias("items")), ["factor"], [F.desc("items"), F.col(artist)], k)
    rows = F.sort_array(F.collect_list(F.struct("rank", F.col(artist).alias("artist"), "items")))  # at most k structs
    return counts.groupBy("factor").agg(F.transform(rows, lambda r: F.struct(r["artist"].alias("artist"), r["items"].alias("items"))).alias("top_artists"))


def personalities(loadings: DataFrame, plays: DataFrame, item: str, artist: str, label: str, k: int = 20) -> DataFrame:
    """Per factor: artist counts of its top items, class mix of their plays, name by rules, strength and mean."""
    top = top_items_per_factor(loadings, item, k)
    counts = plays.groupBy(item, artist, label).agg(F.count("*").alias("n"))
    rows = top.select("factor", item).join(counts, item)
    mix = rows.groupBy("factor").agg(
        *[(F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"{c}_ratio") for c in ("vietnamese", "western", "bridge")]
    )
    lead = factor_artists(top, counts, item, artist)
    strength = loadings.groupBy("factor").agg(F.stddev_pop("loading").alias("factor_strength"), F.avg("loading").alias("factor_mean"))
    v, w = F.col("vietnamese_ratio"), F.col("western_ratio")
    name = F.when(v > 0.7, "Vietnamese-dominant").when(w > 0.7, "Western-dominant").when((v > 0.3) & (w > 0.3), "Cross-cultural bridge").otherwise("Culturally diverse")
    led = F.get("top_artists", F.lit(0))["artist"].cast("string")
    return mix.join(lead, "factor").join(strength, "factor").withColumn("interpretation", F.concat(name, F.lit(" (led by "), led, F.lit(")")))


def assign_personality(users: DataFrame, a: str, b: str) -> DataFrame:
    """Rule: the class mean above .5 and larger than the other, else mixed."""
    x, y = F.col(a), F.col(b)
    label = F.when((x > 0.5) & (x > y), "personality_1").when((y > 0.5) & (y > x), "personality_2").otherwise("personality_3")
    return users.withColumn("personality", label)


def assign_by_similarity(users: DataFrame, personas: Sequence[dict], ratios: Sequence[str], concentration: str) -> DataFrame:
    """Most similar personality: profile weights times user ratios, half the strength for concentrated listeners."""
    best, best_score = None, None
    for p in personas:
        score = sum((F.col(r) * float(p["profile"].get(r, 0.0)) for r in ratios), F.lit(0.0))
        score = score + F.when(F.col(concentration) > 0.3, 0.5 * float(p["strength"])).otherwise(0.0)
        if best is None:
            best, best_score = F.lit(p["id"]), score
        else:
            best = F.when(score > best_score, p["id"]).otherwise(best)
            best_score = F.greatest(score, best_score)
    return users.withColumns({"personality": best, "similarity": best_score})


def share_by(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per label


