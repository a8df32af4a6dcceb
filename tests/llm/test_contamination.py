"""String tiling against a brute-force version, reordered passages, blocks, nulls and repeats."""

import random

import pytest

from encore.llm.contamination import Items, contaminated, tiled, words_of

SCHEMA = "track_id long, track_name string, coverage string, item_id string"
ITEMS = "item_id long, item_name string, track_id long"


def brute(name, item, size):
    """Greedy tiling by comparing every pair of places in every round."""
    a, b = words_of(name), words_of(item)
    free_a, free_b = [True] * len(a), [True] * len(b)
    covered = 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < size:
            return covered
        covered += n
        for k in range(n):
            free_b[j + k] = free_a[i + k] = False


@pytest.mark.parametrize("seed", range(40))
def test_tiling_equals_brute_force(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice([2, 4, 12]))]
    item = " ".join(rng.choices(words, k=25))
    parts = item.split()
    name = " ".join(rng.choices(words, k=10) + parts[12:20] + rng.choices(words, k=4) + parts[:9])
    index = Items([(1, item)], 3)
    got = dict(index.found(name)).get(1, 0.0)
    assert round(got * 25) == brute(name, item, 3)


def test_marked_words_cut_longer_matches():
    hits = [(i, j) for i in range(8) for j in [i]] + [(i + 20, i + 4) for i in range(8)]
    assert tiled(hits, 3) == 10 + 4  # ten words of the first, then what is left of the second, four words


def test_reordered_passages_and_clean_names(spark, rows):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    moved = " ".join(["intro"] * 5 + w[10:] + ["between"] * 3 + w[:10] + ["outro"])
    data = [(1, moved.upper() + "!", "", ""), (2, "clean " * 50, "", ""), (3, " ".join(w[:6]), "", ""), (4, item, "", ""), (5, None, "", ""), (None, item, "", ""), (4, "clean", "", ""), (6, "x " * 50_000 + item, "", "")]
    items = [(7, item, 1), (8, None, 1), (9, "", 1), (3, item, 1), (11, "clean", 1), (None, "other words that are not here", 1)]
    got = sorted(((r.track_id or 0, r.contaminated, r.item_id, round(r.coverage, 3), r.n_items) for r in contaminated(rows(data, SCHEMA), rows(items, ITEMS)).collect()), key=str)
    assert got == sorted(
        [(1, True, 3, 1.0, 2), (2, True, 11, 1.0, 1), (3, False, None, 0.0, 0), (4, True, 3, 1.0, 3), (4, True, 3, 1.0, 3), (5, False, None, 0.0, 0), (0, True, 3, 1.0, 2), (6, True, 3, 1.0, 2)], key=str
    )


def test_blocks_find_the_same(spark, rows):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)), 0) for i in range(30)]
    data = [(i, f"x y z {items[i % 40][1] if i % 40 < 30 else ''} more words here", "", "") for i in range(80)]
    one = contaminated(rows(data, SCHEMA), rows(items, ITEMS)).collect()
    many = contaminated(rows(data, SCHEMA), rows(items, ITEMS), block_words=50).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert sum(r.contaminated for r in one) == 60


def test_empty_tables(spark, rows):
    assert contaminated(rows([], SCHEMA), rows([(1, "a", 1)], ITEMS)).count() == 0
    assert [r.contaminated for r in contaminated(rows([(1, "a", "", "")], SCHEMA), rows([], ITEMS)).collect()] == [False]
