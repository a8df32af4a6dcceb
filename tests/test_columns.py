import datetime as dt

from pyspark.sql import functions as F

from encore.functions import columns as C
from encore.functions import rules as R


def test_both_time_of_day_definitions(spark):
    got = spark.range(24).select(C.time_of_day_bins("id").alias("b"), C.time_of_day_bands("id").alias("l")).collect()
    bins = ["night"] * 7 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 5
    bands = ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 4 + ["night"] * 2
    assert [r.b for r in got] == bins and [r.l for r in got] == bands


def test_skip_flag(rows):
    df = rows([(29999, None), (30000, None), (30000, True), (30000, False), (29999, False)], "ms long, s boolean")
    assert [r[0] for r in df.select(C.skip_flag("ms", "s")).collect()] == [True, False, True, False, True]


def test_calendar(rows):
    df = rows([(dt.datetime(2024, 1, 1, 9),), (dt.datetime(2024, 1, 6, 17),)], "ts timestamp")
    p = C.calendar_parts("ts")
    got = df.select(p["day_of_week"], p["day_name"], C.weekend_flag("ts"), C.work_hours_flag("ts"), C.season(p["month"])).collect()
    assert [tuple(r) for r in got] == [(0, "Monday", False, True, "winter"), (5, "Saturday", True, False, "winter")]


def test_keys_lists_and_tails(rows):
    df = rows([("My Song", "A B"), (None, "x")], "t string, a string")
    assert [r[0] for r in df.select(C.composite_key("t", "a", normal=True)).collect()] == ["my_song_a_b", None]
    lists = rows([("['a', 'b']",), ("rock",), (None,), ("[broken",)], "g string")
    assert [r[0] for r in lists.select(C.parse_list("g")).collect()] == [["a", "b"], ["rock"], [], []]
    assert rows([("a:b:c",)], "u string").select(C.uri_tail("u")).first()[0] == "c"
    assert rows([(" A, ,b ,",)], "u string").select(C.split_clean("u")).first()[0] == ["a", "b"]


def test_tempo_bins(rows):
    df = rows([(0.0,), (90.0,), (90.5,), (120.0,), (140.0,), (200.0,), (201.0,)], "t double")
    assert [r[0] for r in df.select(C.tempo_category("t")).collect()] == ["slow", "slow", "moderate", "moderate", "fast", "very_fast", None]


def test_first_match_rules(rows):
    df = rows([("iOS 17 iPhone",), ("Android",), ("OS X MACOS",), ("web_player",), ("fridge",), (None,)], "p string")
    got = [r[0] for r in df.select(C.platform_category("p")).collect()]
    assert got == ["iOS", "Android", "macOS", "Web", "Other", "Unknown"]
    loc = rows([("VN", None), ("SE", "14.1"), ("XX", "14.1"), ("XX", "9.1"), ("XX", None)], "c string, ip string")
    assert [r[0] for r in loc.select(C.location_category("c", "ip")).collect()] == ["Vietnam", "Western", "Vietnam", "Other", "Unknown"]


def test_text_rules_on_diacritics_case_and_null(rows):
    names = rows([("KHÓI",), ("Đen Vâu",), ("Drake",), ("周杰伦",), ("",), (None,)], "n string")
    got = [r[0] for r in names.select(R.classify_by_name("n")).collect()]
    assert got == ["vietnamese", "vietnamese", "western", "western", "western", "unknown"]
    score = names.select(R.pattern_hit_score("n")).collect()
    assert [round(r[0] * 9) for r in score] == [1, 2, 0, 0, 0, 0]  # khói: ó; đen vâu: đ and â
    labels = [r[0]["dominant_culture"] for r in names.select(R.regex_flags("n")).collect()]
    assert labels == ["vietnamese", "vietnamese", "western", "unknown", "unknown", "unknown"]


def test_word_edges_next_to_diacritics(rows):
    df = rows([("le",), ("lên",), ("hoà",), ("a-ho!",), ("apple",)], "n string")
    lists_only = [r[0] for r in df.select(F.round(R.pattern_hit_score("n") * 9)).collect()]
    assert lists_only == [1.0, 1.0, 1.0, 1.0, 0.0]  # lên and hoà score their letter only


def test_keyword_votes_find_cjk(rows):
    df = rows([("周杰伦", "x"), ("Son Tung MTP", "love"), ("nobody", "em yeu anh")], "a string, t string")
    got = [r[0]["classification"] for r in df.select(R.keyword_votes("a", "t")).collect()]
    assert got == ["chinese", "vietnamese", "vietnamese"]


def test_genres_and_markets(rows):
    df = rows([(["vietnamese pop", "fusion"], ["VN", "SG", "TH"]), ([], None)], "g array<string>, m array<string>")
    home, west = R.market_scores("m")
    got = df.select(R.genre_share("g", ["v-pop", "vietnamese pop"]), R.genre_share("g", ["pop"]), home, west).collect()
    assert [tuple(round(x, 6) for x in r) for r in got] == [(0.5, 0.5, 1.1, 0.0), (0.0, 0.0, 0.0, 0.0)]
