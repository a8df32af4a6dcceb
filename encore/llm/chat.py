"""Chat formatting with a loss mask, in Spark expressions only.

The project keeps no dialogues, so the operator is general: one row per turn.
A block of the template is ``<s>role[INST]text[/INST]</s>``; turns that follow
each other with the same role share one block, each with its own ``[INST]`` pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """``text`` with a backslash after each ``[``, ``<`` and backslash, so that no mark of the template occurs in it."""
    for mark in ("\\", "[", "<"):
        text = F.replace(text, F.lit(mark), F.lit(mark + "\\"))
    return text


def unescaped(text: Column) -> Column:
    for mark in ("<", "[", "\\"):
        text = F.replace(text, F.lit(mark + "\\"), F.lit(mark))
    return text


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its formatted text and the spans that are learned.

    Turns are sorted by ``turn``; ties by role, then text. Null roles and texts
    are empty, null turns come first, null conversations form one. Repeated rows
    are turns of their own. Spans count code points of ``formatted`` and cover
    each assistant text. A conversation becomes one string, so its size is
    bounded by what a row can hold; texts cross one shuffle. An empty table
    gives no rows; other columns are ignored.

    Columns: conv_id, n_turns, formatted, loss_spans array<struct<start, length>>.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_id).alias("conv")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    places = F.transform("turns", lambda t, i: i)
    changes = F.filter(places, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    begun = sorted_turns.withColumn("n_turns", F.size("turns").cast("long")).withColumn("starts", changes)

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.col("n_turns").cast("int"))
        parts = F.transform(F.slice("turns", start + 1, end - start), lambda t: escaped(t["text"]))
        return F.struct(F.get("turns", start)["role"].alias("role"), escaped(F.get("turns", start)["role"]).alias("label"), parts.alias("parts"))

    merged = begun.select("conv", "n_turns", F.transform("starts", block).alias("blocks"))

    def written(b: Column) -> Column:
        parts = F.array_join(F.transform(b["parts"], lambda p: F.concat(F.lit(BEGIN), p, F.lit(END))), "")
        return F.concat(F.lit(OPEN), b["label"], parts, F.lit(CLOSE))

    def passed(state: Column, b: Column) -> Column:
        """Walk over one block: where the next begins, and the spans so far."""
        at = state["at"] + len(OPEN) + F.length(b["label"])
        ends = F.aggregate(
            b["parts"],
            F.struct(at.alias("at"), state["spans"].alias("spans")),
            lambda s, p: F.struct(
                (s["at"] + len(BEGIN) + F.length(p) + len(END)).alias("at"),
                F.when(b["role"] == LEARNED, F.array_append(s["spans"], F.struct((s["at"] + len(BEGIN)).alias("start"), F.length(p).alias("length"))))
                .otherwise(s["spans"])
                .alias("spans"),
            ),
        )
        return F.struct((ends["at"] + len(CLOSE)).alias("at"), ends["spans"].alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,length:int>>").alias("spans"))
    return merged.select(
        F.col("conv").alias(conv_id),
        "n_turns",
        F.array_join(F.transform("blocks", written), "").alias("formatted"),
        F.aggregate("blocks", nothing, passed)["spans"].alias("loss_spans"),
    )


def read_conversations(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """The turns back from ``formatted``, and the texts under ``loss_spans`` without escapes.

    Columns: conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted.
    """
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        role = unescaped(F.substring_index(F.substring(b, F.lit(len(OPEN) + 1), F.length(b)), BEGIN, 1))
        parts = F.split(b, r"\[INST\]")
        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(role.alias("role"), unescaped(F.substring_index(p, END, 1)).alias("text")))

    lost = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(conv_id, F.flatten(F.transform(blocks, turns_of)).alias("turns"), lost.alias("loss_texts"), "formatted")
