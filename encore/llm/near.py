"""Exact Jaccard join of track names on word n-grams, by signature trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.links import components
from encore.llm.trees import bitmap, bitmap_words, dual_traversal
from encore.llm.words import slices, texts
from encore.session import checkpointed, ship_package

#: Sets, and elements of sets, of one tree; larger groups are dealt out as pairs of parts.
TREE_SETS, TREE_ELEMENTS = 50_000, 8_000_000
#: Every so many rows give the common shingles, at most so many, seen at least so often there.
SHARE, COMMON, SEEN = 8, 1 << 19, 4
#: Bits of a shingle that are left out of a key.
KEY_SHIFT = np.uint64(24)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(name: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole name; with fewer words, of the whole sequence.

    A-Z are lower-cased and words end at ASCII white space, as bytes do both.
    """
    parts = name.encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * _ODD + hashes[k : k + n]
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def common_shingles(tracks: DataFrame, track_name: str, words: int) -> np.ndarray:
    """Keys of shingles that many names share, at most ``COMMON``, the most frequent ones.

    They only come last in the order of keys, which is correct for any order; a
    fixed share of the rows is enough to find those that would make large groups.
    A histogram of the counts says from which one on the list is short enough.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, words) >> KEY_SHIFT for t in texts(batch.column(0))]
            keys, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.empty(0, np.uint64), np.empty(0, np.int64))
            kept = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept].astype(np.int64)), pa.array(counts[kept].astype(np.int64))], ["key", "n"])

    rows = tracks.select(track_name).where(F.pmod(F.xxhash64(track_name), F.lit(SHARE)) == 0)
    seen = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    seen = checkpointed(seen.withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    least, kept = None, 0
    for r in sorted(seen.groupBy("step").count().collect(), reverse=True):
        kept += r["count"]
        if kept > COMMON:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(seen.where(F.col("step") >= least).select("key").toArrow()["key"].to_numpy().astype(np.uint64))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same first ``keys`` columns."""
    rows = (row for batch in slices(batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


def _stars(batches: Iterator[pa.RecordBatch], percent: int, words: int | None = None) -> Iterator[pa.RecordBatch]:
    """Links that connect the members of each tree: by their bitmaps alone or, with ``words``, by the sets of their names."""
    a, b = [], []
    whole = words is not None
    for _, rows in grouped(batches, 3):
        members = {digest: (size, data) for digest, size, data in rows}
        if whole:
            # rows that repeat an id bring along names of other classes
            sets = [(digest, shingles(name or "", words)) for digest, _, name in rows]
            members = {d: (len(s), s) for d, s in sets if xxhash.xxh3_128_digest(s.tobytes()) == d}
        if len(members) > 1:
            names = sorted(members, key=lambda d: (members[d][0], d))
            sizes = np.array([members[d][0] for d in names], np.int64)
            data = [members[d][1] if whole else np.frombuffer(members[d][1], np.uint64) for d in names]

            def alike(i: int, j: int) -> bool:
                both = np.sort(np.concatenate((data[i], data[j])))
                shared = int((both[1:] == both[:-1]).sum())
                return (100 + percent) * shared >= percent * (len(data[i]) + len(data[j]))

            maps = [bitmap(s, bitmap_words(len(s))) for s in data] if whole else data
            groups = dual_traversal(sizes, maps, percent, alike if whole else lambda i, j: True)
            for places in groups.members.values():
                a += [names[places[0]]] * (len(places) - 1)
                b += [names[p] for p in places[1:]]
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _dealt(members: DataFrame, group: str, member: str, size: int, weight: str | None = None) -> DataFrame:
    """Members of each group with the tiles (i, j) they go to.

    A group is cut into parts of about ``size`` rows (or summed ``weight``) by a hash
    of its members. With one part it is one tile; else each pair of parts is a
    tile, so every two members meet in one.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    parts = members.groupBy(group).agg(F.ceil(amount / size).cast("int").alias("parts"))
    rows = members.join(parts, group).withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiles = rows.select("*", others).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return tiles.select(*members.columns, "i", "j")


def near_duplicates(
    tracks: DataFrame, track_id: str = "track_id", track_name: str = "track_name", words: int = 5, percent: int = 80, salts: int = 64
) -> DataFrame:
    """One row per track: its number of distinct word n-grams and the component of links it belongs to.

    Two tracks link when 100 * |intersection| >= ``percent`` * |union| of their sets
    of n-grams; a name with fewer than ``words`` words has its whole sequence as
    one, a name without words is empty and links with nothing. The component is
    named by its smallest id.

    1. Each whole name becomes a set of hashes; equal sets (by a 128-bit digest)
       are one class from here on. A class carries its size, a bitmap of at least
       two bits per element, and as keys the prefix of its set that any similar set
       must share a key with. Common shingles come last in the order of keys.
    2. Classes that share a key go to the tree of the smallest of them, once
       however many keys they share. In a signature tree per group, nodes hold
       OR-combined bitmaps and size ranges; a dual traversal prunes pairs of nodes
       by their maximum possible overlap and pairs that are connected already.
    3. What remains connected is a candidate group. Its whole sets are compared
       exactly in a second traversal of the same kind, which gives the links.
    4. Components of links name the groups.

    Groups beyond ``TREE_SETS`` sets (``TREE_ELEMENTS`` elements in step 3) are cut
    into parts, and every pair of parts is a tree of its own, so a task holds two
    parts at most and no pair is lost. Links connect what is linked; not every
    linked pair is written. Nothing but the bounded list of common shingles and
    counts reaches the driver.

    Null names are empty. Null ids come last and name a component only if no other
    id is in it; repeated rows and ids are rows of their own. An empty table gives
    no rows; other columns are ignored.

    Columns: track_id, n_shingles, component_id.
    """
    spark = tracks.sparkSession
    ship_package(spark)
    rows = tracks.select(F.col(track_id).alias("id"), F.col(track_name).alias("name"))
    kind = rows.schema["id"].dataType.simpleString()
    common = spark.sparkContext.broadcast(common_shingles(rows, "name", words))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for part in slices(batches):
            out = []
            for name in texts(part.column(1)):
                own = shingles(name, words)
                n = len(own)
                if not n:
                    out.append((0, None, None, None, None))
                    continue
                digest = xxhash.xxh3_128_digest(own.tobytes())
                keys = own >> KEY_SHIFT
                last = late[np.minimum(np.searchsorted(late, keys), len(late) - 1)] == keys if len(late) else np.zeros(n, bool)
                prefix = np.concatenate((keys[~last], keys[last]))[: n - -(-percent * n // 100) + 1]
                out.append((n, digest, int.from_bytes(digest[:8], "big", signed=True), bitmap(own, bitmap_words(n)).tobytes(), np.unique(prefix).astype(np.int64)))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n", "digest", "short", "bits", "keys"])

    described_rows = checkpointed(rows.mapInArrow(described, f"id {kind}, n long, digest binary, short long, bits binary, keys array<long>"))
    classes = checkpointed(described_rows.where("n > 0").dropDuplicates(["digest"]))

    # 2: the smallest class of a key owns all that share it and have a neighbour in size that they can link with
    alike, by_size = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n")
    shared = classes.select("short", "n", F.explode("keys").alias("key"))
    shared = shared.select("short", "n", F.min("short").over(alike).alias("owner"), F.lag("n").over(by_size).alias("under"), F.lead("n").over(by_size).alias("over"))
    fits = (100 * F.col("under") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("over"))
    members = shared.where(fits).select("owner", "short").distinct()
    tiles = _dealt(members, "owner", "short", TREE_SETS).join(classes.select("short", "digest", "n", "bits"), "short")
    tiles = tiles.select("owner", "i", "j", "digest", "n", "bits")
    tiles = tiles.repartition("owner", "i", "j").sortWithinPartitions("owner", "i", "j")
    maybe = checkpointed(tiles.mapInArrow(lambda b: _stars(b, percent), "a binary, b binary"))

    # 3: whole sets of candidate groups, compared exactly
    groups = checkpointed(components(maybe))
    placed = groups.select(F.col("node").alias("digest"), F.col("root").alias("candidate")).join(classes.select("digest", "n", "id"), "digest")
    placed = _dealt(placed, "candidate", "digest", TREE_ELEMENTS, "n").withColumnRenamed("id", "own_id")
    # candidates grow with the data, so they are never broadcast, and no more than their names is shuffled
    named = rows.join(placed.hint("merge"), F.col("id").eqNullSafe(F.col("own_id")))
    tiles = named.select("candidate", "i", "j", "digest", "n", "name")
    tiles = tiles.repartition("candidate", "i", "j").sortWithinPartitions("candidate", "i", "j")
    links = checkpointed(tiles.mapInArrow(lambda b: _stars(b, percent, words), "a binary, b binary"))

    # 4: the smallest id of each component, by class first and then by row
    roots = components(links).select(F.col("node").alias("digest"), "root")
    slim = described_rows.select("id", "n", "digest", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    local = slim.where("n > 0").groupBy("digest", "salt").agg(F.min("id").alias("least"))
    per_class = local.groupBy("digest").agg(F.min("least").alias("least")).join(roots, "digest", "left")
    per_class = per_class.select("digest", F.coalesce("root", "digest").alias("root"), "least")
    named_roots = per_class.groupBy("root").agg(F.min("least").alias("component"))
    found = local.select("digest", "salt").join(per_class.select("digest", "root"), "digest").join(named_roots, "root")
    out = slim.join(found.select("digest", "salt", "component"), ["digest", "salt"], "left")
    return out.select(F.col("id").alias(track_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
