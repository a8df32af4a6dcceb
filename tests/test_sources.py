import json

import pytest

from encore.sources import readers as R
from encore.sources import writers as W


def test_history_folder_with_corrupt_and_empty_files(spark, tmp_path):
    good = [{"ts": "2024-01-01T10:00:00Z", "ms_played": 5, "skipped": True}, {"ts": "nope"}, {"ts": "2024-01-02T10:00:00Z", "platform": None}]
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps(good))
    (tmp_path / "Streaming_History_Audio_2.json").write_text("[{broken")
    (tmp_path / "Streaming_History_Audio_3.json").write_text("[]")
    (tmp_path / "other.json").write_text(json.dumps(good))
    out = R.parse_history(R.read_history_json(spark, str(tmp_path))).orderBy("played_at").collect()
    assert [(r.ms_played, r.platform, r.skipped) for r in out] == [(5, "Unknown", True), (0, "Unknown", None)]


def test_no_matching_history_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text("[]")
    with pytest.raises(FileNotFoundError):
        R.read_history_json(spark, str(tmp_path))


def test_playlists_with_different_headers(spark, tmp_path):
    (tmp_path / "chill.csv").write_text("Track Name,Added At\na,2024-01-01T00:00:00Z\n")
    (tmp_path / "loud.csv").write_text("Track Name,Energy\nb,0.5\n")
    out = R.read_playlists_csv(spark, str(tmp_path), mixed_headers=True).orderBy("Track Name").collect()
    assert [(r["playlist_name"], r["Added At"] is None, r["Energy"]) for r in out] == [("chill", False, None), ("loud", True, "0.5")]
    assert R.read_playlists_csv(spark, str(tmp_path), mixed_headers=True, max_files=1).count() == 1


def test_many_files_of_three_headers_are_three_scans(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    headers = ["Track Name,Energy", "Track Name,Added At", "Genres,Track Name"]
    for i in range(200):
        (tmp_path / f"list {i:03d}.csv").write_text(f'{headers[i % 3]}\nx{i},"two\nlines"\ny{i},0.5\n')
    (tmp_path / "empty.csv").write_text("")
    scans, read = [], DataFrameReader.csv
    monkeypatch.setattr(DataFrameReader, "csv", lambda self, *a, **k: scans.append(a) or read(self, *a, **k))
    out = R.read_playlists_csv(spark, str(tmp_path), mixed_headers=True)
    assert len(scans) == 3 and sorted(len(a[0]) for a in scans) == [66, 67, 67]
    got = out.collect()
    assert len(got) == 400 and set(out.columns) == {"Track Name", "Energy", "Added At", "Genres", "playlist_name"}
    mine = {r["playlist_name"]: r for r in got if r["Energy"] == "0.5"}
    assert len(mine) == 67 and mine["list 003"]["Track Name"] == "y3" and mine["list 003"]["Genres"] is None


def test_declared_and_undeclared_map_keys(rows):
    df = rows([(1, {"a": 1.0}), (2, {"b": 2.0})], "id int, m map<string,double>")
    out = R.spread_map(df, "m", ["a", "b"]).orderBy("id").collect()
    assert [(r.audio_a, r.audio_b) for r in out] == [(1.0, None), (None, 2.0)]
    assert sorted(map(tuple, R.map_rows(df, "m", ["id"]).collect())) == [(1, "a", 1.0), (2, "b", 2.0)]


def test_latest_result_and_parquet(spark, rows, tmp_path):
    for name in ("r_1", "r_2"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"n": name}))
    last = R.read_latest_result(spark, str(tmp_path)).first()
    assert last.name == "r_2" and json.loads(last.payload) == {"n": "r_2"}
    path = str(tmp_path / "empty")
    W.write_parquet(rows([], "ts timestamp"), path)
    with pytest.raises(ValueError):
        R.read_events_parquet(spark, path, "ts")
