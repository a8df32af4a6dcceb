"""A corpus pipeline over ``documents``: each stage applies one operator to all that the one before kept.

Decisions are by row: rows that share an id, or have none, stay or go each by its own
text. After the exact dedup no two rows have one text, so id and text name a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm.bpe import encode_names
from encore.llm.contamination import contaminated
from encore.llm.exact import first_copies
from encore.llm.near import near_duplicates
from encore.llm.toxicity import with_score
from encore.session import checkpointed


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, in the order of ids (null last) and never null."""
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text.alias("text")))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not in ``gone``, without the key."""
    gone = gone.select(F.col("__row").alias("__gone")).distinct()
    return keyed.join(gone, F.col("__row").eqNullSafe(F.col("__gone")), "left_anti").drop("__row")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not predict to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = with_score(docs, labels, "doc_id", "text", "toxic", score="__toxic", label_id="doc_id")
    return scored.where("__toxic < 0.5").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return first_copies(docs, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of links (five-word shingles, similarity of 0.8 or more)."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed, "__row", "text", words=5, percent=80)
    return _without(keyed, found.where(~F.col("__row").eqNullSafe(F.col("component_id"))))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    return _without(keyed, contaminated(keyed, items, "__row", "text", "item_id", "text").where("contaminated"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    back = encode_names(docs, "doc_id", "text", decoded="decoded")
    return back.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", tokenise)]

#: The first stage is a fitted model, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
