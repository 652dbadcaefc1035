r"""Chat formatting in Spark expressions only.

A conversation's rows become one array of turn structs, sorted by turn. Adjacent
turns of one role are merged into a block, and the template

    <s>[ROLE]role[/ROLE]text[TURN]text</s>

is concatenated over the blocks; ``[TURN]`` keeps merged turns apart. Control
strings inside roles and texts get one backslash after their first character,
and so does everything that already looks escaped (``<\s>`` becomes ``<\\s>``):
a control string never occurs in a text, and taking one backslash away restores
it exactly. Both ways are a single regular-expression replacement.

The output is a list of segments in order, each marked as under the loss mask
or not; joined, they are the formatted text. All steps are linear in the turns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template's control strings, and those of common chat formats, which texts must not imitate either.
OPEN, CLOSE, ROLE, END_ROLE, TURN = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]"
CONTROLS = (OPEN, CLOSE, ROLE, END_ROLE, TURN, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
LEARNT_ROLE = "assistant"

_TAILS = "|".join(re.sub(r"([\[\]|])", r"\\\1", c[1:]) for c in CONTROLS)
_PLAIN, _ESCAPED = rf"([<\[])(\\*)({_TAILS})", rf"([<\[])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    """Control strings made harmless."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _split(text: Column, mark: str, limit: int = -1) -> Column:
    return F.split(text, re.escape(mark), limit)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments) of every conversation in (conv_id, turn, role, text).

    segments is array<struct<text string, loss boolean>>; ``formatted`` is their
    concatenation. Null roles and texts count as empty, null turns come first,
    rows that tie are ordered by role, then text, repeated rows are repeated
    turns, and rows without conversation id form one conversation. Empty in,
    empty out.
    """
    turns = rows.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    starts_block = lambda i: (i == 0) | (F.get("turns.role", i) != F.get("turns.role", i - 1))
    cut = sorted_turns.withColumn("starts", F.filter(at, starts_block))
    length = lambda s, i: F.coalesce(F.get("starts", i + 1), F.size("turns")) - s
    blocks = cut.select("conv_id", F.transform("starts", lambda s, i: F.slice("turns", s + 1, length(s, i))).alias("blocks"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block_segments(block: Column) -> Column:
        role, no = block[0]["role"], F.lit(False)
        texts = F.flatten(
            F.transform(
                block,
                lambda t, i: F.array(
                    segment(F.when(i == 0, F.concat(F.lit(OPEN + ROLE), escape(role), F.lit(END_ROLE))).otherwise(TURN), no),
                    segment(escape(t["text"]), role == LEARNT_ROLE),
                ),
            )
        )
        return F.concat(texts, F.array(segment(F.lit(CLOSE), no)))

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", block_segments)).alias("segments"))
    return segments.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    parts = _split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def of_block(part: Column) -> Column:
        halves = _split(F.substr(part, F.lit(len(OPEN + ROLE) + 1)), END_ROLE, 2)
        return F.transform(_split(halves[1], TURN), lambda text: F.struct(unescape(halves[0]).alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(parts, of_block))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    learnt = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learnt, lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that every run formats besides the table's: texts made of control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of the probe."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNT_ROLE).alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return digests(format_conversations(rows.unionByName(probe)))


QUERIES = {"op6_chat": op6_chat}

_SQL_PLAIN = _PLAIN.replace("'", "''")
ORACLES = {
    "op6_chat": rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE_TEXT}'), (-7, 1, 'assistant', '{PROBE_TEXT}')
), e AS (
  SELECT *, length(regexp_replace(text, '{_SQL_PLAIN}', '\1\\\2\3', 'g')) AS text_chars,
         length(regexp_replace(role, '{_SQL_PLAIN}', '\1\\\2\3', 'g')) AS role_chars,
         coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS merged
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN merged THEN {len(TURN)} ELSE role_chars + {len(OPEN + ROLE + END_ROLE + CLOSE)} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
