"""The registered queries of this subpackage: each maps a given table to an operator and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from encore.llm.bpe import encode_names
from encore.llm.chat import format_conversations, read_conversations
from encore.llm.codes import compress_vectors, fingerprint
from encore.llm.contamination import contaminated
from encore.llm.exact import exact_duplicates
from encore.llm.html_text import extract_text
from encore.llm.near import near_duplicates
from encore.llm.negatives import hard_negatives
from encore.llm.quality import score_quality
from encore.llm.similar import similar_tracks
from encore.llm.tokens import count_tokens
from encore.llm.toxicity import score_explicit
from encore.llm.warc import normalise_archives, plan_records, read_archives, write_monolithic
from encore.session import scratch_folder

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def register(fn):
        LLM_QUERIES[key] = fn
        if oracle is not None:
            LLM_ORACLES[key] = oracle
        return fn

    return register


def tracks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as tracks: the text is the track name."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("track_id"), F.col("text").alias("track_name"))


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(tracks_of(spark, sf_dir), limit=1024).withColumnRenamed("track_id", "doc_id")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("track_id"), F.col("toxic").alias("explicit"))
    return score_explicit(tracks_of(spark, sf_dir), labels).withColumnRenamed("track_id", "doc_id")


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = encode_names(tracks_of(spark, sf_dir), decoded="decoded")
    return back.select(
        F.col("track_id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plays = documents.selectExpr("doc_id AS track_id", "text AS track_name", "source AS platform", "lang AS conn_country", "n_chars AS ms_played")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "track_id")
    return score_quality(plays, labels).withColumnRenamed("track_id", "doc_id")


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("text", "item_name")
    return contaminated(tracks_of(spark, sf_dir), items).withColumnRenamed("track_id", "doc_id")


@query("op7_warc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_monolithic(plan_records(pages), f"{folder}/streams")
    normalise_archives(archives, f"{folder}/archives")
    return read_archives(spark, f"{folder}/archives").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op8_exact_dedup",
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    n AS (SELECT *, sha256(norm) AS text_sha256 FROM t),
    g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
        FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id))
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(tracks_of(spark, sf_dir))
    return found.select(F.col("track_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SAID = "</s>[INST] ok [/INST]"


@query(
    "op10_chat_format",
    rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}')),
    m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
        length(text) + length(regexp_replace(text, '[^\[<\\]', '', 'g')) AS chars,
        length(role) + length(regexp_replace(role, '[^\[<\\]', '', 'g')) AS role_chars FROM t)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(chars + 13 + CASE WHEN prev IS NULL OR prev <> role THEN 7 + role_chars ELSE 0 END) AS BIGINT) AS formatted_chars
    FROM m GROUP BY conv_id""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(SAID).alias("text"))
    formatted = format_conversations(said.unionByName(added))
    back = read_conversations(formatted)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op9_ngram_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tracks_of(spark, sf_dir), words=4, percent=85).withColumnRenamed("track_id", "doc_id")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as tracks: the embedding is the audio vector, the label the culture."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS track_id", "embedding AS audio_vector", "label AS culture")


#: Rows of embeddings that take part, with integer components; r names a row.
INTEGERS = """t AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS n FROM embeddings
        WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""


@query(
    "op11_hard_negatives",
    f"""WITH {INTEGERS},
    u AS (SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(n AS DOUBLE[]) AS n FROM t WHERE label IS NOT NULL),
    s AS (SELECT a.r AS anchor, b.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.n, b.n) AS BIGINT) AS score
        FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.r <> b.r),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5),
    h AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS place
        FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 100 * s.score BETWEEN 80 * p.score AND 100 * p.score)
    SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM h WHERE place <= 5""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = vectors_of(spark, sf_dir)
    moved = F.when(F.col("track_id") % 7 == 0, (F.col("culture") + 1) % 10).otherwise(F.col("culture"))
    return hard_negatives(tracks.withColumn("culture", moved), F.col("track_id") % 100 == 0)


@query("op12_similar_tracks")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_tracks(vectors_of(spark, sf_dir), F.col("track_id") % 20 == 0)
    return found.withColumnRenamed("similar_id", "vec_id")


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    assign = """a{k} AS (SELECT r, part, x, entry, d FROM (
            SELECT p.r, part, p.x, e.entry, CAST(list_sum([(p.x[i] - e.x[i]) * (p.x[i] - e.x[i]) FOR i IN range(1, len(p.x) + 1)]) AS BIGINT) AS d FROM p JOIN e{k} e USING (part))
        QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)"""
    move = """m{k} AS (SELECT part, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL),
    e{n} AS (SELECT part, entry, coalesce(l.x, e.x) AS x FROM e{k} e LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM m{k} GROUP BY ALL) l USING (part, entry))"""
    steps = ",\n    ".join(assign.format(k=k) + ",\n    " + move.format(k=k, n=k + 1) for k in range(rounds))
    return f"""WITH {INTEGERS},
    p AS (SELECT r, part, n[part * len(n) // {parts} + 1 : (part + 1) * len(n) // {parts}] AS x FROM t, (SELECT unnest(range({parts})) AS part)),
    f AS (SELECT r, row_number() OVER (ORDER BY vec_id, n) - 1 AS entry FROM t QUALIFY entry < {entries}),
    e0 AS (SELECT part, entry, x FROM f JOIN p USING (r)),
    {steps},
    {assign.format(k=rounds)},
    c AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
    b AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM e{rounds}))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN t USING (r), b"""


@query("op13_vector_codes", _codes_sql(parts=16, entries=64, rounds=2))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(vectors_of(spark, sf_dir))
    return codes.select(F.col("track_id").alias("vec_id"), "code", "error", F.col("culture_error").alias("label_error"), F.lit(fingerprint(books)).alias("codebooks_sha256"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
