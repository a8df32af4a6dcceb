"""Hard negatives, similar tracks and vector codes against brute force, with nulls, ties, repeats, outliers and empty tables."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encore.llm import codes, negatives, similar, vectors
from encore.llm.codes import Part, compress_vectors, fingerprint
from encore.llm.negatives import hard_negatives
from encore.llm.similar import similar_tracks

SCHEMA = "track_id long, audio_vector array<double>, culture string, row string, slice int, vector string"
ODD = [
    (900, None, "a", "x", 1, "v"),
    (901, [], "a", "x", 1, "v"),
    (902, [1.0, None, 0.0, 1.0, 0.0, 1.0], "a", None, None, None),
    (903, [1.0, float("nan"), 0.0, 1.0, 0.0, 1.0], "b", None, None, None),
    (904, [1.0, float("-inf"), 0.0, 1.0, 0.0, 1.0], "b", None, None, None),
    (905, [1.0, 2.0], "b", None, None, None),
]


def table(rng, n, dims=6, copies=True):
    """Random tracks, with near copies, repeated rows, a zero vector, null ids and null cultures."""
    out = []
    centre = rng.normal(size=dims)
    for i in range(n):
        kind = i % 7
        v = rng.normal(size=dims) if kind < 4 or not copies else centre + rng.normal(size=dims) * 0.02
        if kind == 6:
            v = v * 10.0 ** rng.integers(-3, 3)
        out.append((i, [float(x) for x in v], None if i % 31 == 30 else "abc"[int(rng.integers(3))]))
    if copies:
        out += [out[4], out[4], out[0], (None, out[5][1], "a"), (None, out[6][1], None), (n, [0.0] * dims, "b")]
    return [(*r, f"r{i}", i, "z") for i, r in enumerate(out)]


def kept(data, dims=6, zero=True):
    return [r for r in data if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1]) and (zero or any(r[1]))]


def order(pair):
    score, track = pair[:2]
    return (-score, track is None, track or 0)


def brute_negatives(data, every, scale=256):
    rows = [(i, r[0], [math.floor(scale * x) for x in r[1]], r[2]) for i, r in enumerate(kept(data)) if r[2] is not None]
    out = []
    for i, a, x, culture in rows:
        if a is None or a % every:
            continue
        scored = sorted(((sum(p * q for p, q in zip(x, y)), b, c) for j, b, y, c in rows if i != j), key=order)
        for p, b, _ in [s for s in scored if s[2] == culture][:5]:
            fit = [s for s in scored if s[2] != culture and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(a, b, k + 1, s[1], p, s[0]) for k, s in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell,slices", [(64, 24), (3, 2)])
def test_hard_negatives_match_brute_force(spark, rows, monkeypatch, cell, slices):
    monkeypatch.setattr(negatives, "CELL", cell)
    monkeypatch.setattr(vectors, "SLICES", slices)
    data = table(np.random.default_rng(cell), 150) + ODD
    found = hard_negatives(rows(data, SCHEMA), F.col("track_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(data, 10)
    assert len(want) > 100 and sorted(map(tuple, found.collect()), key=str) == want


def test_hard_negatives_in_several_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE_ROWS", 16)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 3)
    data = table(np.random.default_rng(5), 80)
    found = hard_negatives(rows(data, SCHEMA), F.col("track_id") % 5 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == brute_negatives(data, 5)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-300, 300, (300, 5)), rng.integers(-3, 3, (300, 5)) + [200, 100, 0, 0, 0]])
    refs = negatives.directions(points[:100].astype(float), 8)
    lengths = np.sqrt((points**2).sum(axis=1))
    found = negatives.angles(points / np.maximum(lengths, 1)[:, None] * (lengths > 0)[:, None], refs)
    pruned = 0
    for i in range(0, 600, 20):
        low, high = negatives.bounds(found, found, lengths, lengths, found[i], lengths[i])
        scores = points @ points[i]
        assert ((low <= scores) & (scores <= high)).all()
        pruned += np.count_nonzero(high < scores.max() * 0.8)
    assert pruned > 1000


def test_huge_components_stay_within_a_long(spark, rows):
    data = [(0, [1e30, 1e30, 0.0], "a"), (1, [1e30, 1e30, 0.0], "a"), (2, [1e30, 9e29, 0.0], "b")]
    found = hard_negatives(rows(data, "track_id long, audio_vector array<double>, culture string"), F.col("track_id") == 0).collect()
    most = vectors.largest_component(3)
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, 2 * most * most, 2 * most * most)]


def brute_similar(data, every, wanted):
    rows = [(i, r[0], np.array(r[1])) for i, r in enumerate(kept(data, zero=False))]
    out = {}
    for i, q, x in rows:
        if q is not None and q % every == 0:
            best = sorted(((float((y * x).sum()), t) for j, t, y in rows if i != j), key=order)[:wanted]
            out.setdefault(q, []).extend((q, k + 1, t, s) for k, (s, t) in enumerate(best))
    return out


@pytest.mark.parametrize("slices", [24, 2])
def test_similar_tracks_reach_the_recall(spark, rows, monkeypatch, slices):
    monkeypatch.setattr(vectors, "SLICES", slices)
    data = table(np.random.default_rng(slices), 700) + ODD
    found = similar_tracks(rows(data, SCHEMA), F.col("track_id") % 20 == 0, wanted=10).collect()
    want = brute_similar(data, 20, 10)
    assert {r["query_id"] for r in found} == set(want)
    flat = {x for v in want.values() for x in v}
    hit = sum(tuple(r) in flat for r in found)
    assert len(found) == sum(map(len, want.values())) and hit >= 0.9 * len(found)
    known = {(r[0], tuple(r[1])) for r in kept(data)}
    for q in {0, 20, 40}:
        mine = sorted((r["rank"], r["score"], r["similar_id"]) for r in found if r["query_id"] == q)
        assert [m[1] for m in mine if m[0] == 1] and known
    once = [r for r in found if r["query_id"] == 20]
    assert [r["rank"] for r in sorted(once, key=lambda r: r["rank"])] == list(range(1, 11))
    assert sorted(once, key=lambda r: order((r["score"], r["similar_id"]))) == sorted(once, key=lambda r: r["rank"])


def test_random_directions_reach_the_recall_in_large_slices(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SLICES", 1)
    data = table(np.random.default_rng(9), 3000, dims=32, copies=False)
    found = similar_tracks(rows(data, SCHEMA), F.col("track_id") % 100 == 0).collect()
    points = np.array([r[1] for r in data])
    hit = 0
    for q in range(0, 3000, 100):
        scores = points @ points[q]
        scores[q] = -np.inf
        hit += len(set(np.argsort(-scores)[:20].tolist()) & {r["similar_id"] for r in found if r["query_id"] == q})
    assert len(found) == 600 and hit >= 0.9 * 600


def searched(monkeypatch, vectors_, queries, wanted=10):
    """Rows found for each query in one slice, and the number of places that were counted."""
    places, real = [0], np.bincount

    def bincount(x, *more, **given):
        places[0] += len(x)
        return real(x, *more, **given)

    monkeypatch.setattr(similar.np, "bincount", bincount)
    ids = lambda a, first: pa.array(np.arange(first, first + len(a)))
    table_ = lambda a, first: pa.table({"row": ids(a, first), "track_id": ids(a, first), "vector": pa.array(a.tolist())})
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("similar_id", pa.int64()), ("score", pa.float64())])
    found = similar._searcher(vectors_.shape[1], wanted, schema)(table_(vectors_, 0), table_(queries, 10**6))
    return found["row"].to_numpy().reshape(len(queries), wanted), places[0]


def test_rows_are_verified_at_once_where_counting_costs_more(monkeypatch):
    rng = np.random.default_rng(11)
    points, queries = rng.normal(size=(4000, 16)), rng.normal(size=(300, 16))
    found, places = searched(monkeypatch, points, queries)
    assert (found == np.argsort(-(queries @ points.T), axis=1)[:, :10]).all()
    assert places * similar.PLACE_COST <= points.size * len(queries)


def test_near_copies_of_wide_vectors_are_found_by_counting(monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 600))
    points = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 600)) * 0.002
    points /= np.sqrt((points**2).sum(axis=1, keepdims=True))
    checked = []
    monkeypatch.setattr(similar.Search, "rest", lambda self, scores, real=similar.Search.rest: checked.append(1) or real(self, scores))
    found, places = searched(monkeypatch, points, centres)
    assert places and len(checked) < 10
    hit = sum(len(set(f) & set(w)) for f, w in zip(found.tolist(), np.argsort(-(centres @ points.T), axis=1)[:, :10].tolist()))
    assert hit >= 0.9 * 400


def test_fewer_tracks_than_wanted_come_whole_and_in_order(spark, rows):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-5.0, 1.0]), (0, [0.5, 0.0]), (9, [0.0, 0.0])]
    found = similar_tracks(rows(data, "track_id long, audio_vector array<double>"), F.col("track_id") == 3).collect()
    assert sorted((r["rank"], r["similar_id"], r["score"]) for r in found) == [(1, 0, -2.5), (2, 0, -5.0), (3, 1, -5.0), (4, 2, -5.0)]


def brute_codes(data, parts, entries, rounds, scale=256):
    rows = [(r[0], [math.floor(scale * x) for x in r[1]], r[2]) for r in kept(data)]
    size = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [(near(cut(v, p), book)[1], cut(v, p)) for _, v, _ in rows]
            groups = {k: [v for c, v in mine if c == k] for k in range(len(book))}
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if groups[k] else e for k, e in enumerate(book)]
    out = []
    for track, v, culture in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((track, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), culture))
    total = {c: sum(r[2] for r in out if r[3] == c) for c in {r[3] for r in out}}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((t, c, e, total[k]) for t, c, e, k in out), key=str), digest


@pytest.mark.parametrize("parts,entries,rounds", [(3, 8, 2), (2, 64, 1), (6, 5, 0), (1, 20, 2)])
def test_codes_match_brute_force(spark, rows, parts, entries, rounds):
    data = table(np.random.default_rng(parts), 200) + ODD
    found, books = compress_vectors(rows(data, SCHEMA).repartition(5), parts, entries, rounds)
    want, digest = brute_codes(data, parts, entries, rounds)
    assert sorted(map(tuple, found.collect()), key=str) == want and fingerprint(books) == digest


def test_masks_give_the_nearest_entry():
    rng = np.random.default_rng(3)
    for dims, entries in [(1, 64), (4, 64), (4, 1), (3, 17)]:
        book, points = rng.integers(-6, 6, (entries, dims)), rng.integers(-9, 9, (500, dims))
        code, distance = Part(book).nearest(points)
        every = ((points[:, None] - book) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_parts_that_do_not_divide_and_wide_numbers(spark, rows):
    data = [(i, [float(x) for x in (i, -i, 1e25, 0.5, i % 3)], None) for i in range(40)]
    found, books = compress_vectors(rows(data, "track_id long, audio_vector array<float>, culture int"), parts=8, entries=4)
    codes_ = found.collect()
    assert len(codes_) == 40 and {len(r["code"]) for r in codes_} == {16} and [b.shape[1] for b in books] == [0, 1, 0, 1, 1, 0, 1, 1]
    assert {r["culture_error"] for r in codes_} == {sum(r["error"] for r in codes_)}
    with pytest.raises(ValueError):
        compress_vectors(found, entries=codes.MOST + 1)


def test_empty_tables(spark, rows):
    for data in ([], ODD[:4]):
        tracks = rows(data, SCHEMA)
        assert hard_negatives(tracks, F.lit(True)).collect() == []
        assert similar_tracks(tracks, F.lit(True)).collect() == []
        found, books = compress_vectors(tracks)
        assert found.collect() == [] and fingerprint(books) == hashlib.sha256(b"").hexdigest()


def test_threshold_keeps_most_of_what_lies_within_the_radius():
    least = similar.threshold(similar.PROJECTIONS, similar.MISSED)
    hits = np.random.default_rng(0).binomial(similar.PROJECTIONS, math.erf(similar.HALF_WIDTH / math.sqrt(2)), 20_000)
    assert 0.94 < (hits >= least).mean() < 0.975
