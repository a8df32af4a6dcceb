"""WARC: exact round trips, one member per record, offsets, revisits, nulls and damage."""

import base64
import glob
import gzip
import hashlib
import json

import pytest

from encore.llm.warc import normalise_archives, plan_records, read_archives, record_of, records_of, write_monolithic
from encore.session import scratch_folder

SCHEMA = "page_id long, url string, html string, digest string, salt string"


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def round_trip(spark, pages, **limits):
    folder = scratch_folder(spark)
    archives = write_monolithic(plan_records(pages, **{k: v for k, v in limits.items() if k == "min_payload"}), f"{folder}/a", archive_bytes=limits.get("archive_bytes", 1 << 20))
    done = normalise_archives(archives, f"{folder}/b")
    return folder, archives, done, read_archives(spark, f"{folder}/b", span=4096)


def test_round_trip_and_index(spark, rows):
    data = [(i, f"http://x/{i}", f"<p>page {i % 50} é</p>" * (1 + i % 3), "", "") for i in range(400)]
    data += [(1000, None, None, "", ""), (1001, "http://a\r\nb", "", "", ""), (1002, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, "", ""), (1003, "u", "z" * 3_000_000, "", "")]
    folder, archives, done, back = round_trip(spark, rows(data, SCHEMA).repartition(3), archive_bytes=5000)
    first = {}
    for i, _, html, *_ in data:
        first[html or ""] = min(first.get(html or "", i), i)
    got = {r.page_id: r for r in back.collect()}
    assert len(got) == len(data) == sum(r.n_records for r in done.collect()) == sum(r.n_records for r in archives.collect())
    for i, _, html, *_ in data:
        text, r = html or "", got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), b32(text))
        assert (r.record_type, r.refers_to) == (("response", None) if first[text] == i else ("revisit", first[text]))
        assert r.html == (text if first[text] == i else None)
    for path in glob.glob(f"{folder}/b/*.warc.gz"):
        raw = open(path, "rb").read()
        entries = [json.loads(line) for line in open(path + ".index.jsonl")]
        assert [e["offset"] for e in entries] == [sum(x["length"] for x in entries[:k]) for k in range(len(entries))]
        assert sum(e["length"] for e in entries) == len(raw)
        for e in entries:
            assert gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")


def test_least_payload_ties_and_nulls(spark, rows):
    data = [(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abcdef", "", ""), (4, "u", "abcdef", "", ""), (None, "u", "abcdef", "", ""), (3, "u", "abcdef", "", ""), (None, "u", "alone", "", "")]
    *_, back = round_trip(spark, rows(data, SCHEMA), min_payload=3)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in back.collect()), key=str)
    want = [(1, "response", None, 2), (2, "response", None, 2), (3, "response", None, 6), (3, "response", None, 6), (4, "revisit", 3, 6), (None, "response", None, 5), (None, "revisit", 3, 6)]
    assert got == sorted(want, key=str)


def test_streams_of_one_and_many_members():
    data = [record_of(str(i), "u", bytes([65 + i]) * (10**i), None) for i in range(7)]
    whole, members = gzip.compress(b"".join(data)), b"".join(map(gzip.compress, data))
    for stream in (whole, members):
        for step in (7, 4096, 1 << 30):
            chunks = (stream[k : k + step] for k in range(0, len(stream), step))
            assert [r.raw for r in records_of(chunks)] == data
    assert list(records_of(iter([]))) == []


def test_damaged_streams_raise():
    stream = gzip.compress(record_of("1", "u", b"x" * 1000, None))
    with pytest.raises(ValueError):
        list(records_of(iter([stream[:-20]])))
    with pytest.raises(ValueError):
        list(records_of(iter([gzip.compress(b"HTTP/1.1 200\r\n\r\n")])))


def test_empty_table(spark, rows):
    assert round_trip(spark, rows([], SCHEMA))[3].count() == 0
