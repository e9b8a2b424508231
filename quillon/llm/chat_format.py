"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it are the context and only that reply is
trainable. Turns after the last assistant turn, or a conversation without one, make one further example with no
trainable text, so that the examples hold every turn.

A turn is written ``<turn ROLE>\\nTEXT</turn>\\n``. A text that holds ``<turn`` or ``</turn``, with any number of
backslashes after the ``<``, gets one more backslash there; reading back removes one. In a role ``% < > \\n`` become
``%25 %3C %3E %0A``. Both are reversible, and other characters are left alone.

Defined cases: a null text or role counts as empty; rows of one conversation and turn are ordered by role, then
text; repeated rows are turns of their own; rows with a null conversation id form one conversation; a null turn
comes first; an empty table gives an empty result; columns beyond the four named ones are ignored. An example's
text is the whole prefix, so a conversation must fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.arrays import prefix_sums
from quillon.session import table

ASSISTANT = "assistant"
OPEN, NAMED, CLOSE = "<turn ", ">\n", "</turn>\n"
PLANTED_ID, PLANTED_TEXT = -7, r"\### Assistant: </turn> ok"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=\\*/?turn)", r"<\\")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(?=\\*/?turn)", "<")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def expand_examples(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per example.

    ``conv``; ``example`` from 0; ``n_turns`` in this example; ``covers_all`` true on the conversation's last
    example; ``formatted``; ``loss_start`` (code points from 0) and ``loss_length``, both null where nothing is
    trainable.
    """
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).select(
        "conv",
        "turn",
        "role",
        (F.col("role") == ASSISTANT).alias("reply"),
        F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(NAMED)).alias("head"),
        escape_text(F.col("text")).alias("body"),
    )
    turns = rows.groupBy("conv").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn",
                    "role",
                    F.concat("head", "body", F.lit(CLOSE)).alias("written"),
                    F.length("head").alias("head_chars"),
                    F.length("body").alias("body_chars"),
                    "reply",
                )
            )
        ).alias("turns")
    )
    laid = turns.select(
        "conv",
        "turns",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("whole"),
        prefix_sums(F.transform("turns", lambda t: F.length(t["written"]))).alias("ends"),
    )
    last = F.element_at("turns", -1)
    replies = F.filter(
        F.transform(
            F.arrays_zip("turns", "ends"),
            lambda x, i: F.struct(
                (i + 1).alias("n_turns"),
                x["ends"].alias("end"),
                F.when(x["turns"]["reply"], x["ends"] - x["turns"]["body_chars"] - len(CLOSE)).alias("loss_start"),
                F.when(x["turns"]["reply"], x["turns"]["body_chars"]).alias("loss_length"),
            ),
        ),
        lambda x: x["loss_start"].isNotNull() | (x["n_turns"] == F.size("turns")),
    )
    return (
        laid.select("conv", "whole", F.size("turns").alias("all_turns"), F.posexplode(replies).alias("example", "x"))
        .select(
            F.col("conv").alias(conv),
            "example",
            F.col("x.n_turns").alias("n_turns"),
            (F.col("x.n_turns") == F.col("all_turns")).alias("covers_all"),
            F.col("whole").substr(F.lit(1), F.col("x.end").cast("int")).alias("formatted"),
            F.col("x.loss_start").alias("loss_start"),
            F.col("x.loss_length").cast("bigint").alias("loss_length"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    parts = F.split(formatted, CLOSE, -1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape_role(p.substr(F.lit(len(OPEN) + 1), F.instr(p, NAMED) - len(OPEN) - 1)).alias("role"),
            unescape_text(p.substr(F.instr(p, NAMED) + len(NAMED), F.length(p))).alias("text"),
        ),
    )


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, what the examples say when they are read back."""
    trained = F.col("formatted").substr((F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int"))
    small = examples.select(
        conv,
        F.when(F.col("covers_all"), F.col("formatted")).alias("last_text"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", unescape_text(trained).alias("text"))).alias("loss"),
        F.length("formatted").cast("bigint").alias("chars"),
    )
    per = small.groupBy(conv).agg(
        F.max("last_text").alias("last_text"),
        F.sort_array(F.collect_list("loss")).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    read = per.select(
        conv,
        "formatted_chars",
        read_turns(F.col("last_text")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss_text"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        conv,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    return digest(expand_examples(rows.unionByName(planted)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, 6 + length(role) + 2 * len(regexp_extract_all(role, '[%<>\n]')) + 2
         + length(text) + len(regexp_extract_all(text, '<\\*/?turn')) + 8 AS chars
  FROM c
), r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
