"""Exact duplicates: ties, nulls, empty texts, repeated rows, cut groups and clashing columns."""

from encore.llm.exact import exact_duplicates

SCHEMA = "track_id long, track_name string, group_size string, norm string"


def brute(data):
    names = [(i, "".join(c for c in (t or "") if c not in " \t\n\x0b\f\r"), len(t or "")) for i, t, *_ in data]
    out = []
    for i, norm, _ in names:
        group = [(-p, j is None, j or 0, j) for j, n, p in names if n == norm]
        out.append((i, min(group)[3], len(group)))
    return sorted(out, key=str)


def test_groups_match_brute_force(spark, rows):
    data = [(5, "a b", "x", "y"), (3, "ab ", "x", "y"), (9, "a  b\n", "x", "y"), (1, None, "x", "y"), (2, "", None, None), (None, "\t", "x", "y")]
    data += [(7, "no break", "", ""), (8, "nobreak", "", ""), (11, "z" * 100_000, "", ""), (10, "z" * 100_000, "", ""), (4, "same", "", ""), (4, "same", "", "")]
    data += [(i, "hot name", "", "") for i in range(100, 400)]
    got = exact_duplicates(rows(data, SCHEMA), salts=8).collect()
    assert sorted(((r.track_id, r.keep_id, r.group_size) for r in got), key=str) == brute(data)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == 7
    assert all(r.track_id == r.keep_id for r in kept)


def test_null_ids_stay_only_when_alone(spark, rows):
    got = exact_duplicates(rows([(None, "x", "", ""), (None, " x", "", ""), (None, "y", "", ""), (1, "y", "", "")], SCHEMA)).collect()
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in got) == [("1", 2, False), ("1", 2, True), ("None", 2, False), ("None", 2, True)]


def test_empty_table(spark, rows):
    assert exact_duplicates(rows([], SCHEMA)).count() == 0
