"""Jaccard join against brute force: random families, thresholds, cut groups, nulls, repeats and hot shingles."""

import random
import re

import numpy as np
import pytest

from encore.llm import near, trees
from encore.llm.links import components
from encore.llm.near import near_duplicates, shingles

SCHEMA = "track_id long, track_name string, n_shingles string, component_id string"


def words_of(name):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def set_of(name, size):
    w = words_of(name)
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def brute(data, size, percent):
    sets = [set_of(t, size) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (track, *_) in enumerate(data):
        if track is not None:
            least[find(i)] = min(least.get(find(i), track), track)
    return sorted(((d[0], len(s), least.get(find(i)) if s else d[0]) for i, (d, s) in enumerate(zip(data, sets))), key=str)


def family(rng, words, copies, edits):
    base = rng.choices(words, k=rng.randint(5, 120))
    yield base
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = text[rng.randint(0, 3) :]
        yield text


def check(spark, rows, data, size, percent):
    got = near_duplicates(rows(data, SCHEMA), words=size, percent=percent).collect()
    assert sorted(((r.track_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(data, size, percent)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 60)])
def test_random_families_match_brute_force(spark, rows, size, percent):
    rng = random.Random(size)
    words = [f"W{i}" for i in range(60 if size > 1 else 400)]
    texts = [" ".join(t) for _ in range(60) for t in family(rng, words, rng.randint(0, 6), 4)]
    rng.shuffle(texts)
    check(spark, rows, [(i * 3 + 1, t, "x", "y") for i, t in enumerate(texts)], size, percent)


def test_cut_groups_and_common_shingles_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "TREE_SETS", 7)
    monkeypatch.setattr(near, "TREE_ELEMENTS", 300)
    monkeypatch.setattr(near, "SHARE", 1)
    monkeypatch.setattr(near, "SEEN", 3)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    passage = rng.choices(words, k=30)
    data = [" ".join(passage + rng.choices(words, k=rng.randint(1, 12))) for _ in range(120)]
    data += [" ".join(t) for t in family(rng, words, 60, 2)]
    check(spark, rows, [(i, t, "x", "y") for i, t in enumerate(data)], 4, 85)


def test_edge_cases(spark, rows):
    data = [(5, None, "", ""), (6, "", "", ""), (7, " \t\n", "", ""), (8, "one two", "", ""), (9, "ONE\x0btwo", "", ""), (10, "one two three", "", ""), (3, "one two", "", ""), (3, "one two", "", "")]
    data += [(None, "a b c d e f", "", ""), (None, "A B C D E F", "", ""), (12, "a b c d e f", "", ""), (None, "only null here now", "", ""), (4, "É É É É é", "", ""), (14, "é é é é é", "", "")]
    data += [(20, " ".join(f"t{i}" for i in range(20_000)), "", ""), (21, " ".join(f"t{i}" for i in range(19_000)), "", ""), (21, "same id other text here", "", ""), (22, "é one two", "", "")]
    check(spark, rows, data, 4, 85)
    assert near_duplicates(rows([], SCHEMA)).count() == 0
    assert near_duplicates(rows([(1, None, "", "")], SCHEMA)).first().component_id == 1


def test_exact_threshold(spark, rows):
    base = [f"b{i}" for i in range(100)]
    near_enough, too_far = base[:85], base[:84]  # 85 and 84 of 100 single-word shingles
    data = [(1, " ".join(base), "", ""), (2, " ".join(near_enough), "", ""), (3, " ".join(f"c{i}" for i in range(100)), "", ""), (4, " ".join(f"c{i}" for i in range(84)), "", "")]
    assert len(too_far) == 84
    check(spark, rows, data, 1, 85)


def test_bitmaps_fold_and_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate((y, x[: rng.integers(0, len(x) + 1)])))
        wide, narrow = trees.bitmap(x, 32), trees.bitmap(x, 8)
        assert (trees.folded(wide[None, :], 8)[0] == narrow).all()
        shared, bits = len(np.intersect1d(x, y)), int(np.bitwise_count(narrow & trees.bitmap(y, 8)).sum())
        assert shared <= bits + min(len(x) - np.bitwise_count(narrow).sum(), len(y) - np.bitwise_count(trees.bitmap(y, 8)).sum())


def test_components_of_paths_and_stars(spark, rows):
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(500, 500), (301, 300)]
    got = {r.node: r.root for r in components(rows(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}, 300: 300, 301: 300}
    assert components(rows([], "a long, b long")).count() == 0


def test_shingles_of_short_names():
    assert len(shingles("", 4)) == 0 and len(shingles("a", 4)) == 1
    assert shingles("a b", 4) != shingles("a b c", 4)
