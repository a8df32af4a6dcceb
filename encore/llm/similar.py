"""Tracks that sound alike, by counting collisions of single projections around each query."""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.vectors import matrix, paired, places, usable
from encore.session import ship_package

#: Projections, half the width of a window of radius 1, and the share of true neighbours that may miss the threshold.
PROJECTIONS, HALF_WIDTH, MISSED = 128, 1.0, 0.05
#: Radii of virtual rehashing, rising to 2, where every vector of the sphere lies inside; the shell ratio of norms.
RADII = 2.0 / 1.5 ** np.arange(10)[::-1]
SHELL = 0.8
#: Multiply-adds of a product in the time of counting one place (measured: 48 with 64 components, 90 with 512), and scores of one product.
PLACE_COST, PRODUCT = 32, 1 << 22
#: Difference of rough scores of unit queries that does not tell which row is ahead.
CLOSE = 1e-9
_SEED = 20_240


def threshold(projections: int, missed: float) -> int:
    """Collisions that a vector within the radius reaches but for a share ``missed`` of cases."""
    p = erf(HALF_WIDTH / sqrt(2))
    chance, below = (1 - p) ** projections, 0.0
    for least in range(projections + 1):
        if below + chance > missed:
            return max(1, least)
        below += chance
        chance *= (projections - least) / (least + 1) * p / (1 - p)
    return projections


class Shell:
    """Vectors of similar norm on a unit sphere of one dimension more, with a sorted array of places for each projection.

    With M the largest norm, x becomes (x, sqrt(M^2 - |x|^2)) / M and a query q
    becomes (q, 0) / |q|: the largest inner product is the smallest distance.
    """

    def __init__(self, members: np.ndarray, vectors: np.ndarray, norms: np.ndarray, most: float, lines: np.ndarray):
        self.members, self.vectors, self.most = members, vectors, most
        rest = np.sqrt(np.maximum(0.0, 1.0 - (norms / most) ** 2))
        cast = (vectors / most) @ lines[:-1] + rest[:, None] * lines[-1]
        self.order = np.argsort(cast, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(cast.T, self.order, axis=1)
        self.arrays = list(self.order)

    def windows(self, cast: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last places (query, projection) of the windows of a radius centred at each query's projections."""
        low, high = np.empty(cast.shape, np.int64), np.empty(cast.shape, np.int64)
        for j, values in enumerate(self.values):
            low[:, j] = np.searchsorted(values, cast[:, j] - HALF_WIDTH * radius, "left")
            high[:, j] = np.searchsorted(values, cast[:, j] + HALF_WIDTH * radius, "right")
        return low, high


def shells(vectors: np.ndarray, lines: np.ndarray) -> list[Shell]:
    """Shells of falling norm; a shell ends below ``SHELL`` times its largest norm."""
    norms = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    out, start = [], 0
    while start < len(order):
        most = norms[order[start]]
        end = start + int(np.searchsorted(-norms[order[start:]], -SHELL * most, "right"))
        mine = order[start:end]
        out.append(Shell(mine, vectors[mine], norms[mine], most, lines))
        start = end
    return out


class Search:
    """The search of one query in one shell: collisions so far, and the windows that were counted."""

    def __init__(self, shell: Shell, query: np.ndarray, wanted: int, needed: int, found: list):
        self.shell, self.query, self.wanted, self.needed, self.found = shell, query, wanted, needed, found
        self.counts, self.seen, self.inside = None, None, None
        self.length = sqrt(float((query**2).sum()))
        self.scores = np.concatenate([s for _, s in found]) if found else np.empty(0)

    def fresh_places(self, low: np.ndarray, high: np.ndarray) -> int:
        """Places of the windows that are not counted yet."""
        return int((high - low).sum()) - (0 if self.inside is None else int((self.inside[1] - self.inside[0]).sum()))

    def count(self, low: np.ndarray, high: np.ndarray) -> None:
        """Count what is new in the windows and verify the rows that exceed the collision threshold."""
        shell, lo, hi = self.shell, low.tolist(), high.tolist()
        if self.inside is None:
            self.counts, self.seen = np.zeros(len(shell.members), np.int64), np.zeros(len(shell.members), bool)
            new = [o[a:b] for o, a, b in zip(shell.arrays, lo, hi)]
        else:
            was = [x.tolist() for x in self.inside]
            new = [o[a:b] for o, a, b in zip(shell.arrays, lo, was[0])] + [o[a:b] for o, a, b in zip(shell.arrays, was[1], hi)]
        self.inside = (low, high)
        self.counts += np.bincount(np.concatenate(new), minlength=len(shell.members))
        fresh = np.flatnonzero((self.counts >= self.needed) & ~self.seen)
        if len(fresh):
            self.seen[fresh] = True
            self.verified(fresh, (shell.vectors[fresh] * self.query).sum(axis=1))

    def verified(self, rows: np.ndarray, scores: np.ndarray) -> None:
        self.found.append((self.shell.members[rows], scores))
        self.scores = np.concatenate([self.scores, scores])

    def ended(self, radius: float) -> bool:
        """Whether ``wanted`` verified rows lie within the radius."""
        return np.count_nonzero(self.scores >= self.length * self.shell.most * (1 - radius * radius / 2)) >= self.wanted

    def rest(self, scores: np.ndarray) -> None:
        """Take the best of all rows that were not verified, given the scores of all rows."""
        if self.seen is not None:
            scores = np.where(self.seen, -np.inf, scores)
        if len(scores) > self.wanted:
            rows = np.flatnonzero(scores >= np.partition(scores, -self.wanted)[-self.wanted] - CLOSE)
        else:
            rows = np.arange(len(scores))
        rows = rows if self.seen is None else rows[~self.seen[rows]]
        self.verified(rows, scores[rows])


def search(shell: Shell, cast: np.ndarray, queries: np.ndarray, wanted: int, needed: int, found: list[list]) -> None:
    """Add (members, scores) of vectors of the shell to ``found`` of each query, until ``wanted`` verified ones lie within the radius.

    Windows around the queries' projections ``cast`` grow from one radius to the next, only
    what is new in them is counted, and what exceeds the collision threshold is verified.
    Once counting the next windows costs more than verifying all rows of the shell, or
    at the last radius, the rows that are left are all verified, by one product for all such
    queries; of these only the best ``wanted`` (with what is too close to tell) go to ``found``, which
    also holds what earlier shells gave.
    """
    n, dims = shell.vectors.shape
    searches = [Search(shell, q, wanted, needed, f) for q, f in zip(queries, found)]
    going, whole = np.arange(len(queries)), []
    for radius in RADII[:-1]:
        if not len(going):
            break
        left = []
        low, high = shell.windows(cast[going], radius)
        for at, lo, hi in zip(going.tolist(), low, high):
            one = searches[at]
            if int((hi - lo).sum()) < needed * wanted and len(one.scores) < wanted:
                left.append(at)
            elif one.fresh_places(lo, hi) * PLACE_COST > n * dims:
                whole.append(at)
            else:
                one.count(lo, hi)
                if not one.ended(radius):
                    left.append(at)
        going = np.array(left, np.int64)
    whole += going.tolist()
    step = max(1, PRODUCT // max(1, n))
    for start in range(0, len(whole), step):
        now = whole[start : start + step]
        for at, scores in zip(now, queries[now] @ shell.vectors.T):
            searches[at].rest(scores)


def _searcher(dims: int, wanted: int, schema: pa.Schema):
    """The function of one slice of tracks and one block of queries."""
    needed = threshold(PROJECTIONS, MISSED)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        rng = np.random.default_rng(_SEED)
        lines = rng.standard_normal((dims + 1, PROJECTIONS))
        vectors, queries = matrix(left["vector"], dims), matrix(right["vector"], dims)
        size = max(np.abs(vectors).max(), 1e-300)
        rows, place = left["row"].to_numpy(), places(left["track_id"])
        own = {r: i for i, r in enumerate(rows.tolist())}
        built = shells(vectors / size, lines)
        out = []
        for start in range(0, len(queries), 256):
            block = queries[start : start + 256]
            unit = block / np.abs(block).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
            found: list[list] = [[] for _ in block]
            for shell in built:
                open_ = [i for i, f in enumerate(found) if sum(np.count_nonzero(s > shell.most * (1 + 1e-12)) for _, s in f) <= wanted]
                search(shell, unit[open_] @ lines[:-1], unit[open_], wanted + 1, needed, [found[i] for i in open_])
            for i, key in enumerate(right["row"][start : start + 256].to_pylist()):
                members, rough = (np.concatenate(x) for x in zip(*found[i]))
                if len(rough) > wanted + 1:  # exact scores only for what can be among the best
                    members = members[rough >= np.partition(rough, -wanted - 1)[-wanted - 1] - CLOSE]
                members = members[members != own[key]] if key in own else members
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (vectors[members] * block[i]).sum(axis=1)
                members, exact = members[~np.isnan(exact)], exact[~np.isnan(exact)]
                top = np.lexsort((rows[members], place[members], -exact))[:wanted]
                out.append((start + i, members[top], exact[top]))
        at = np.repeat([a for a, _, _ in out], [len(m) for _, m, _ in out])
        members = np.concatenate([m for _, m, _ in out])
        columns = [right["row"].take(at), right["track_id"].take(at), left["row"].take(members), left["track_id"].take(members), pa.array(np.concatenate([s for _, _, s in out]))]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    return run


def similar_tracks(tracks: DataFrame, queries: Column, wanted: int = 20, track_id: str = "track_id", audio_vector: str = "audio_vector") -> DataFrame:
    """The ``wanted`` tracks of largest inner product with each query track: query_id, rank, similar_id, score.

    ``queries`` marks the rows to search for; each meets all rows but itself. Every
    slice of rows keeps one sorted array for each of ``PROJECTIONS`` random lines.
    Windows around a query's own projections grow radius by radius; tracks inside
    enough of them are verified, and the search of a slice ends once ``wanted``
    verified tracks lie within the radius, so a true neighbour is missed with a
    probability of about ``MISSED`` at most. Where counting wider windows would cost
    more than that, all rows left are verified instead and none is missed. Scores are inner products of the
    vectors in double precision; ties go to the smaller id (null last).

    Rows are compared whatever their id: repeated ids are rows of their own, a
    repeated query is answered for each of its rows. Null, empty and zero vectors,
    null or non-finite components, and vectors of another length than that of the
    first id take no part; products that are not numbers are left out. With fewer
    tracks all are returned; an empty table gives no row. Other columns of
    ``tracks`` are not read.
    """
    ship_package(tracks.sparkSession)
    rows, n, dims = usable(tracks, track_id, audio_vector, nonzero=True, asked=F.coalesce(queries, F.lit(False)))
    asked = rows.where("asked")
    kind = rows.schema["track_id"].dataType.simpleString()
    left, right = paired(rows.drop("asked"), n, asked.drop("asked"), asked.count())
    ddl = f"query_row long, query_id {kind}, row long, similar_id {kind}, score double"
    like = rows.sparkSession.createDataFrame([], ddl).toArrow().schema
    found = left.cogroup(right).applyInArrow(_searcher(dims, wanted, like), ddl)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("similar_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "similar_id", "score")
