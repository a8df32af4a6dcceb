"""WARC archives of web pages: written as single gzip streams, normalised to one member per record, and read back by offset.

The project keeps no web pages, so the operators are general: one row per page.
Archives lie in a folder that the driver and all executors share, reached by any
URI that ``pyarrow.fs`` opens (a path, ``file:``, ``hdfs:``, ``s3:`` ...).
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.words import slices
from encore.session import checkpointed, ship_package

#: Bytes of records after which an archive is closed, bytes read at a time, bytes of an archive that one task reads back.
ARCHIVE, CHUNK, SPAN = 64 << 20, 1 << 20, 8 << 20
#: Fixed values of the format.
VERSION, PROFILE, DATE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"
GZIP = 31


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 0, salts: int = 64) -> DataFrame:
    """Each page with the page whose record holds its payload.

    Of equal payloads of at least ``min_payload`` bytes the smallest id is the
    response that the others revisit; smaller payloads are all responses. Payloads
    are equal when their SHA-1 is. Groups are cut by a hash of the id into
    ``salts`` pieces: only one summary per piece meets the others, and the pages
    join these summaries piece by piece, so no group lies in one task.

    A null page is empty. Null ids come last; rows that repeat both id and
    payload are all responses. Columns: id, url, html, refers_to (null: response).
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    local = rows.groupBy("digest", "salt").agg(F.min("id").alias("first"))
    first = local.groupBy("digest").agg(F.min("first").alias("first"))
    known = local.select("digest", "salt").join(first, "digest")
    revisits = (F.octet_length("html") >= min_payload) & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(known, ["digest", "salt"]).select("id", "url", "html", F.when(revisits, F.col("first")).alias("refers_to"))


def record_of(page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record with an HTTP response; a revisit has its headers only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    raw: bytes


def parsed(buffer: bytearray) -> Record | None:
    """The first record of ``buffer``, or None while it is incomplete."""
    head = buffer.find(b"\r\n\r\n")
    if head < 0:
        return None
    version, *lines = bytes(buffer[:head]).decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    start = head + 4
    end = start + int(headers["content-length"])
    if len(buffer) < end + 4:
        return None
    return Record(headers, bytes(buffer[start:end]), bytes(buffer[: end + 4]))


def records_of(chunks: Iterator[bytes]) -> Iterator[Record]:
    """Records of a gzip stream of one or more members, inflated once in bounded memory."""
    inflate, buffer, inside = zlib.decompressobj(GZIP), bytearray(), False
    for chunk in chain(chunks, [b""]):
        last = not chunk
        while chunk or last:
            more = inflate.decompress(chunk, 4 * CHUNK)
            buffer += more
            inside = not inflate.eof and (inside or bool(chunk))
            chunk = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            last = last and bool(more)
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
            while buffer and (record := parsed(buffer)):
                del buffer[: len(record.raw)]
                yield record
    if buffer or inside:
        raise ValueError("the archive ends inside a record")


def _deflated(data: bytes, level: int) -> bytes:
    member = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return member.compress(data) + member.flush()


def _chunks(path: str) -> Iterator[bytes]:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


class _File:
    """A file that appears under its name when it is complete, so a repeated task replaces it whole."""

    def __init__(self, path: str):
        self.path, self.size = path, 0
        self.system, self.place = fs.FileSystem.from_uri(path)
        self.system.create_dir(self.place.rpartition("/")[0])
        self.draft = f"{self.place}.{TaskContext.get().taskAttemptId()}.part"
        self.stream = self.system.open_output_stream(self.draft, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.stream.close()
        self.system.move(self.draft, self.place)
        return self.path


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE, level: int = 1) -> DataFrame:
    """Write planned records as archives of one gzip stream each.

    A task writes its own rows to its own archives and closes one when its
    records exceed ``archive_bytes``. An archive appears under a name that the
    task's partition fixes once it is complete, so a repeated task replaces it.

    Columns: archive, n_records. The table is written, so the archives exist.
    """
    ship_package(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, counts = TaskContext.get().partitionId(), [], []
        out, gzip, raw = None, None, 0
        for batch in slices(batches, 64):
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, gzip, raw = _File(f"{folder}/pages-{part:06d}-{len(names):04d}.warc.gz"), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
                    counts.append(0)
                data = record_of(page, url, html.encode(), refers_to)
                out.write(gzip.compress(data))
                raw += len(data)
                counts[-1] += 1
                if raw >= archive_bytes:
                    out.write(gzip.flush())
                    names.append(out.close())
                    out = None
        if out is not None:
            out.write(gzip.flush())
            names.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "n_records"])

    page = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = records.select(page, "url", "html", F.col("refers_to").cast("string"))
    return checkpointed(rows.mapInArrow(write, "archive string, n_records long"))


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite archives so that each record is a gzip member of its own, with a sidecar index of offsets.

    A gzip stream cannot be split, so each archive is one row and one task; it is
    inflated once, record by record, and its size is bounded by its writer. Next to
    each new archive lies ``<name>.index.jsonl`` with one line per record: offset,
    length, record_id, record_type. Works on any ``.warc.gz``, of one or many members.

    Columns: archive, index, n_records. The table is written, so the files exist.
    """
    spark = archives.sparkSession
    ship_package(spark)

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rpartition("/")[2]
                out, lines = _File(f"{folder}/{name}"), _File(f"{folder}/{name}.index.jsonl")
                n = 0
                for record in records_of(_chunks(path)):
                    member = _deflated(record.raw, level)
                    of = record.headers
                    entry = {"archive": out.path, "offset": out.size, "length": len(member), "record_id": of.get("warc-record-id"), "record_type": of.get("warc-type")}
                    lines.write(json.dumps(entry).encode() + b"\n")
                    out.write(member)
                    n += 1
                done = [pa.array([out.close()]), pa.array([lines.close()]), pa.array([n], pa.int64())]
                yield pa.RecordBatch.from_arrays(done, ["archive", "index", "n_records"])

    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place)
    many = max(1, archives.count())
    rows = archives.select("archive").repartitionByRange(many, "archive")
    return checkpointed(rows.mapInArrow(normalise, "archive string, index string, n_records long"))


INDEX = "archive string, offset long, length long, record_id string, record_type string"


def read_archives(spark, folder: str, page_type: str = "bigint", span: int = SPAN) -> DataFrame:
    """Read normalised archives back by their sidecar indexes.

    Index lines are dealt out by (archive, stretch of ``span`` bytes), so one
    archive is read by many tasks; each seeks to its members. The digest of a
    response is computed anew and must equal its header. A revisit has no payload
    of its own: its size and digest come from its headers.

    Columns: page_id, url, record_type, refers_to, payload_digest, payload_bytes, html (null for revisits).
    """
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream = None, None
        for batch in slices(batches, 64):
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != now:
                    system, place = fs.FileSystem.from_uri(archive)
                    now, stream = archive, system.open_input_file(place)
                stream.seek(offset)
                record = next(records_of(iter([stream.read(length)])))
                of = record.headers
                head, _, payload = record.block.partition(b"\r\n\r\n")
                size = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length")
                digest = of["warc-payload-digest"].removeprefix("sha1:")
                kind = of["warc-type"]
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of {of['warc-record-id']} in {archive} is damaged")
                page, target = (x[len("<urn:page:") : -1] or None if x else None for x in (of["warc-record-id"], of.get("warc-refers-to")))
                rows.append((page, of.get("warc-target-uri"), kind, target, digest, size, payload.decode() if kind == "response" else None))
            columns = [pa.array(c, pa.int64() if i == 5 else pa.string()) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays(columns, ["page", "url", "record_type", "target", "payload_digest", "payload_bytes", "html"])

    index = spark.read.schema(INDEX).option("pathGlobFilter", "*.index.jsonl").json(folder)
    # a fixed number of partitions: the index is small for what it points to, so its size must not decide
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("archive", "offset", "length").repartition(parts, "archive", F.floor(F.col("offset") / span)).sortWithinPartitions("archive", "offset")
    out = dealt.mapInArrow(read, "page string, url string, record_type string, target string, payload_digest string, payload_bytes long, html string")
    ids = [F.col(a).cast(page_type).alias(b) for a, b in (("page", "page_id"), ("target", "refers_to"))]
    return out.select(ids[0], "url", "record_type", ids[1], "payload_digest", "payload_bytes", "html")
