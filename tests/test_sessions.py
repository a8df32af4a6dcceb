import datetime as dt

import pytest
from pyspark.sql import functions as F

from encore.operators import sessions as S
from encore.operators.scan import number_cell, time_cell

T0 = dt.datetime(2024, 1, 1, 23, 0, 0)


def at(**kw):
    return T0 + dt.timedelta(**kw)


@pytest.fixture
def plays(rows):
    data = [
        (1, 1, at()), (2, 1, at(minutes=30)), (3, 1, at(minutes=60, microseconds=1)), (4, 1, at(minutes=60, microseconds=1)),
        (5, 2, at(hours=5)), (6, 1, at(days=3)),
    ]
    return rows(data, "event_id long, user_id long, ts timestamp")


@pytest.mark.parametrize("cell", [60, 3600, 86400])
def test_gap_of_exactly_the_threshold_stays_in_the_session(plays, cell):
    got = {r.event_id: (r.session_no, r.session_position) for r in S.sessionize(plays, cell_seconds=cell).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (2, 2), 6: (3, 1), 5: (1, 1)}


def test_derived_users_are_named_by_first_appearance(rows):
    data = [(i, "b" if i % 2 else "a", at(minutes=i)) for i in range(8)] + [(9, "a", at(days=1)), (10, "c", at(minutes=1))]
    df = rows(data, "event_id long, ip string, ts timestamp")
    out = S.derive_users(df, ["ip"], "ts", "event_id", 240, 3)
    got = {r.event_id: r.derived_user for r in out.collect()}
    assert got[0] == "user_0000" and got[1] == "user_0001" and 9 not in got and 10 not in got


def labels(rows, text):
    return rows([(1, i, at(minutes=i), c) for i, c in enumerate(text)], "user_id long, event_id long, ts timestamp, label string")


def test_transition_flags_on_the_first_row(rows):
    df = labels(rows, "aab")
    flags = {r.event_id: r.label_transition for r in S.transition_flag(df, ["user_id"], ["ts", "event_id"], "label", time_cell("ts")).collect()}
    assert flags == {0: 1, 1: 0, 2: 1}
    near = {r.event_id: (r.prev_label, r.next_label, r.is_transition) for r in S.neighbor_labels(df, ["user_id"], ["ts", "event_id"], "label", time_cell("ts")).collect()}
    assert near == {0: (None, "a", False), 1: ("a", "b", False), 2: ("a", None, True)}


def test_rolling_mean_needs_ten_values(rows):
    for n, nulls in ((9, 0), (10, 0), (11, 0), (11, 1)):
        data = [(1, i, None if nulls and i == 5 else float(i)) for i in range(n)]
        df = rows(data, "user_id long, event_id long, v double")
        out = S.rolling_mean_last_n(df, ["user_id"], ["event_id"], "v", number_cell("event_id", 4))
        got = [r.rolling_mean for r in out.orderBy("event_id").collect()]
        exp = [sum(range(i - 9, i + 1)) / 10 if i >= 9 and not nulls else None for i in range(n)]
        assert got == exp


def test_runs_and_transitions_skip_unknown(rows):
    df = labels(rows, "aa?abbcccccccccccca")
    runs = S.runs(df, ["user_id"], ["ts", "event_id"], "label", time_cell("ts", 180)).orderBy("segment_no")
    assert [(r.label, r.run_length) for r in runs.collect()] == [("a", 2), ("?", 1), ("a", 1), ("b", 2), ("c", 12), ("a", 1)]
    out = S.transitions_after_run(df, ["user_id"], "ts", "event_id", "label", time_cell("ts", 180), ["a", "b"], 3, "?")
    got = [(r.from_label, r.to_label, r.run_length, round(r.strength, 3)) for r in out.orderBy("event_id").collect()]
    assert got == [("a", "b", 3, 0.3), ("c", "a", 12, 0.5)]


def test_rolling_distinct_over_missing_days(rows):
    days = [(1, "x"), (1, "y"), (4, "x"), (8, "z"), (14, "x")]
    df = rows([(dt.datetime(2024, 1, d), a) for d, a in days], "ts timestamp, artist string")
    got = {r.date.day: r.distinct_7d for r in S.rolling_distinct(df, "ts", "artist", 7).collect()}
    assert got == {1: 2, 4: 2, 8: 2, 14: 2}


def test_rolling_daily_plays(rows):
    df = rows([(dt.datetime(2024, 1, d, h),) for d, h in [(1, 1), (1, 2), (7, 1), (8, 1)]], "ts timestamp")
    got = {r.date.day: r.mean_7d for r in S.rolling_daily_plays(df, "ts", [7]).collect()}
    assert got == {1: 2.0, 7: 1.5, 8: 1.0}


def test_exposure_windows_need_full_context(rows):
    df = labels(rows, "abcabXabcaaX")
    out = S.exposure_windows(df, ["user_id"], ["ts", "event_id"], "label", F.col("label") == "X", time_cell("ts", 120))
    got = [(r.event_id, r.diversity_before, r.diversity_after) for r in out.collect()]
    assert got == [(5, 0.6, 0.6)]


def test_time_since_last_same_is_null_first(rows):
    df = rows([(1, "x", at()), (2, "y", at(hours=1)), (3, "x", at(days=2))], "event_id long, track string, ts timestamp")
    out = S.time_since_last_same(df, "track", "ts", "event_id", "h")
    assert {r.event_id: r.h for r in out.collect()} == {1: None, 2: None, 3: 48.0}
