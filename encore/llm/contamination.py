"""Items of a held-out split that occur in training names, by greedy string tiling."""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from encore.llm.words import slices, texts
from encore.session import checkpointed, ship_package

_WORD = re.compile(r"\w+")
#: Words of a seed and of the shortest tile; share of an item that must be tiled; words of one block of items.
SEED, LEAST, BLOCK = 5, 0.6, 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(name: str) -> list[str]:
    return _WORD.findall(name.lower())


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + ids[k : k + n].astype(np.uint64)
    return out


def tiled(hits: list[tuple[int, int]], size: int) -> int:
    """Words of the item covered by greedy tiling, from seed hits (place in name, place in item) of ``size`` words.

    Hits that follow each other on a diagonal form one match. The longest match is
    marked first (ties: first in the item, then in the name); what others lose to
    marked words is cut off them, and parts of at least ``size`` words compete again.
    """
    runs: dict[int, list[int]] = defaultdict(list)
    for i, j in sorted(hits):
        runs[i - j].append(j)
    heap: list[tuple[int, int, int]] = []
    for diagonal, places in runs.items():
        start = last = places[0]
        for j in [*places[1:], None]:
            if j is not None and j == last + 1:
                last = j
                continue
            heap.append((-(last - start + size), start, start + diagonal))
            start = last = j
    heapq.heapify(heap)
    in_item, in_name = set(), set()
    while heap:
        length, j, i = heapq.heappop(heap)
        free = [k for k in range(-length) if j + k not in in_item and i + k not in in_name]
        if len(free) == -length:
            in_item.update(range(j, j - length))
            in_name.update(range(i, i - length))
            continue
        first = None
        for n, k in enumerate(free):
            first = k if first is None else first
            if n + 1 == len(free) or free[n + 1] != k + 1:
                if k - first + 1 >= size:
                    heapq.heappush(heap, (-(k - first + 1), j + first, i + first))
                first = None
    return len(in_item)


class Items:
    """One block of items: their words as numbers, and the places of every seed by its hash."""

    def __init__(self, items: list[tuple[object, str]], size: int):
        self.size, self.vocab, self.ids, self.words = size, {}, [], []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        whole: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, name in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(name)], np.int64)
            if not len(ids):
                continue
            n, short = len(self.ids), len(ids) < size
            for j, h in enumerate(rolled(ids, min(size, len(ids))).tolist()):
                (whole if short else places)[h if not short else (len(ids), h)].append((n, j))
            self.ids.append(item)
            self.words.append(ids)
        self.seeds = [(size, dict(places))]
        for length in sorted({k[0] for k in whole}):
            self.seeds.append((length, {h: v for (k, h), v in whole.items() if k == length}))
        self.keys = [np.array(sorted(seeds), np.uint64) for _, seeds in self.seeds]

    def found(self, name: str) -> Iterator[tuple[object, float]]:
        """Items that share a seed with a name, each with the share of its words that is tiled."""
        ids = np.fromiter(map(self.vocab.get, words_of(name), repeat(-1)), np.int64)
        for (length, seeds), keys in zip(self.seeds, self.keys):
            if not len(keys) or len(ids) < length:
                continue
            own = np.convolve(ids >= 0, np.ones(length, np.int8), "valid") == length
            if not own.any():
                continue
            at = np.flatnonzero(own)
            hashes = rolled(ids, length)[at]
            at = at[keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes]
            hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
            all_hashes = rolled(ids, length)
            for i in at.tolist():
                for n, j in seeds[int(all_hashes[i])]:
                    if np.array_equal(self.words[n][j : j + length], ids[i : i + length]):
                        hits[n].append((i, j))
            for n, pairs in hits.items():
                yield self.ids[n], tiled(pairs, length) / len(self.words[n])


def contaminated(
    tracks: DataFrame,
    held_out: DataFrame,
    track_id: str = "track_id",
    track_name: str = "track_name",
    item_id: str = "item_id",
    item_name: str = "item_name",
    seed: int = SEED,
    least: float = LEAST,
    block_words: int = BLOCK,
) -> DataFrame:
    """One row per track: whether its name holds an item of the held-out split.

    Words are lower-cased runs of letters and digits. Names and items that share a
    seed of ``seed`` words are tiled greedily: the longest common run of unmarked
    words is marked, again and again, down to the length of a seed. A track is
    contaminated when at least ``least`` of an item's words are tiled, in any
    order; an item shorter than a seed must occur as a whole.

    The held-out items are the query set. They are cut by a hash of their id into
    blocks of about ``block_words`` words, so a broadcast holds one block whatever
    their number; each block is tried against all whole names where they lie, and
    only rows with a finding are written. Findings join the tracks by id alone.

    Null names and items are empty and match nothing; null item ids are items as
    well. Null track ids share a finding, as do rows that repeat an id. Ties in
    coverage name the smallest item. Empty tables give no rows or no finding;
    other columns are ignored.

    Columns: track_id, contaminated, item_id, coverage, n_items.
    """
    spark = tracks.sparkSession
    ship_package(spark)
    items = held_out.select(F.col(item_id).alias("item"), F.coalesce(item_name, F.lit("")).alias("name"))
    words = items.agg(F.sum(F.size(F.split("name", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(words / block_words))
    rows = tracks.select(F.col(track_id).alias("id"), F.col(track_name).alias("name"))
    id_kind, item_kind = rows.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item"].dataType)
    findings = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(Items([(r.item, r.name) for r in own], seed))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part in slices(batches):
                at, found, shares = [], [], []
                for row, name in enumerate(texts(part.column(1))):
                    for item, share in index.found(name):
                        if share >= least:
                            at.append(row)
                            found.append(item)
                            shares.append(share)
                kept = part.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept, pa.array(found, item_type), pa.array(shares, pa.float64())], ["id", "item", "coverage"])

        hits = checkpointed(rows.mapInArrow(search, f"id {id_kind}, item {item_kind}, coverage double"))
        sent.unpersist()
        findings = hits if findings is None else findings.unionByName(hits)
    best = F.min(F.struct((-F.col("coverage")).alias("least"), "item"))
    held = findings.groupBy("id").agg(best.alias("best"), F.countDistinct("item").alias("n_items")).withColumnRenamed("id", "found_id")
    out = rows.select("id").join(held, F.col("id").eqNullSafe(F.col("found_id")), "left")
    return out.select(
        F.col("id").alias(track_id),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.col("best.item").alias(item_id),
        F.coalesce(-F.col("best.least"), F.lit(0.0)).alias("coverage"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
    )
