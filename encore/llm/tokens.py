"""Token counts of track names: a broadcast table of frequent pre-tokens, and worker caches for the rest."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.words import pieces, slices, texts
from encore.session import ship_package

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Words a task keeps while it counts, words it reports, entries of the broadcast table, entries of a worker's cache.
COUNTED, REPORTED, TABLE, CACHE = 400_000, 8_192, 65_536, 400_000


def frequent_pieces(tracks: DataFrame, track_name: str = "track_name", size: int = TABLE) -> list[str]:
    """The most frequent pieces of all names, at most ``size``.

    Each task counts its own pieces in bounded memory and reports its
    ``REPORTED`` most frequent ones; only these summaries are shuffled and
    summed. The list decides what is looked up first, never a count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in slices(batches):
            for text in texts(part.column(0)):
                counts.update(pieces(text)[1:])
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = counts.most_common(REPORTED)
        yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in top], "n": pa.array([n for _, n in top], pa.int64())})

    seen = tracks.select(track_name).mapInArrow(summarise, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in seen.orderBy(F.desc("n"), "piece").limit(size).collect()]


class Lengths:
    """Numbers of tokens per piece: the broadcast table, then a bounded cache, then the tokenizer."""

    current: tuple[str, Lengths] | None = None

    def __init__(self, model: str, table: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_str(model), table
        self.known = dict(table)
        self.heads: dict[str, int] = {}

    @classmethod
    def of(cls, key: str, model: str, table: dict[str, int]) -> Lengths:
        """The instance of this worker, made once per model and table."""
        if cls.current is None or cls.current[0] != key:
            cls.current = (key, cls(model, table))
        return cls.current[1]

    def encoded(self, words: list[str]) -> Iterator[int]:
        return (len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def counts(self, names: list[str]) -> list[int]:
        cut = [pieces(t) for t in names]
        if len(self.known) > len(self.table) + CACHE:
            self.known = dict(self.table)
        if len(self.heads) > CACHE:
            self.heads = {}
        missed = list(set(chain.from_iterable(c[1:] for c in cut)).difference(self.known))
        self.known.update(zip(missed, self.encoded([" " + w for w in missed])))
        first = list({c[0] for c in cut}.difference(self.heads))
        self.heads.update(zip(first, self.encoded(first)))
        of = self.known.__getitem__
        return [self.heads[c[0]] + sum(map(of, c[1:])) for c in cut]


def count_tokens(
    tracks: DataFrame, track_id: str = "track_id", track_name: str = "track_name", limit: int = 1024, tokenizer: str = TOKENIZER, table_size: int = TABLE
) -> DataFrame:
    """Tokens of every whole track name, as the library counts them with the tokenizer file.

    Two tiers and no shuffle of pre-tokens: the lengths of the ``table_size`` most
    frequent pieces are broadcast (the size is the bound of the broadcast); other
    pieces are encoded by the library once per worker and kept in a bounded cache.
    Special strings inside a name count as the library's default takes them; none
    are added, nothing is cut off.

    A null name is empty and has 0 bytes and tokens; ids may be null or repeat,
    each row gives one row. An empty table gives no rows; other columns are ignored.

    Columns: track_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).
    """
    spark = tracks.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as source:
        model = source.read()
    words = frequent_pieces(tracks, track_name, table_size)
    lengths = Lengths(model, {}).encoded([" " + w for w in words])
    sent = spark.sparkContext.broadcast((os.urandom(8).hex(), model, dict(zip(words, lengths))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths.of(*sent.value)
        for part in slices(batches):
            counts = pa.array(lengths.counts(texts(part.column(1))), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), counts], ["id", "n_bytes", "n_tokens"])

    size = F.octet_length(F.coalesce(track_name, F.lit(""))).cast("long")
    rows = tracks.select(F.col(track_id).alias("id"), F.col(track_name).alias("name"), size.alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(track_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
