"""Chat formatting: multi-party perspective rotation.

Every participant (distinct speaker) of a conversation gets a rendering of the whole dialogue in which they
are the assistant and every other speaker is a named user. The mask marks what that participant
says, end mark included: the characters a model would be trained on.

A message is rendered as ``<|assistant|>\\n`` or ``<|user name=NAME|>\\n``, its text, ``<|end|>\\n``.
Special strings inside names and texts are broken up (``<|`` becomes ``<\\u200b|``), so content cannot forge a mark.

Long conversations are rendered in blocks of at most ``block`` messages, one row a block: rows
stay bounded, and the blocks of one perspective in turn are the whole dialogue. To number the messages
without holding a conversation in one task, all messages are ranged by (conversation, turn, speaker,
text), counted range by range, and each range gets the count of those before it as its offset.
Spark splits a conversation over as many ranges as it fills; work is one sort and narrow steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorwise.llm.common import stage, table
from priorwise.llm.registry import register

END = "<|end|>\n"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<​|"))


def numbered(messages: DataFrame, ranges: int) -> DataFrame:
    """Messages (conv, turn, speaker, text) with ``nth``, their place from 0 in the conversation's order."""
    order = ["turn", "speaker", "text"]
    ranged = stage(messages.withColumn("tie", F.xxhash64("conv", *order, F.rand(7)))
                   .repartitionByRange(ranges, "conv", *order, "tie")
                   .withColumn("part", F.spark_partition_id()), "chat-ranges")
    within = Window.partitionBy("part", "conv").orderBy(*order, "tie")
    sizes = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    # few rows a conversation: one for each range that it reaches
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    offsets = sizes.withColumn("before", before).select(F.col("conv").alias("c"), F.col("part").alias("p"), "before")
    local = ranged.withColumn("at", F.row_number().over(within) - 1)
    return local.join(offsets, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))) \
        .select("conv", *order, (F.col("at") + F.col("before")).alias("nth"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text", block: int = 64) -> DataFrame:
    """Rows (conv, perspective, block_no, n_messages, text, mask): mask is an array of [start, end) in characters.

    Defined results: a null or empty speaker is named ``unknown``; null text is empty; messages are ordered
    by (turn with nulls first, speaker, text); equal messages are all kept; a null conversation id is a
    conversation of its own; a speaker who is the only one is rendered against no users; an empty table gives
    no rows. Any integer or string columns will do, and extra columns are left out.
    """
    spark = turns.sparkSession
    named = F.coalesce(F.nullif(F.col(f"`{speaker_col}`").cast("string"), F.lit("")), F.lit("unknown"))
    messages = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                            named.alias("speaker"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = numbered(messages, ranges)
    message = F.struct("nth", "speaker", "text")
    blocks = placed.groupBy("conv", F.floor(F.col("nth") / block).alias("block_no")) \
        .agg(F.sort_array(F.collect_list(message)).alias("said"))  # at most ``block`` messages
    speakers = messages.select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    views = blocks.join(speakers, F.col("conv").eqNullSafe(F.col("c"))).drop("c")

    def render(m: Column) -> Column:
        head = F.when(m["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n")) \
            .otherwise(F.concat(F.lit("<|user name="), _plain(m["speaker"]), F.lit("|>\n")))
        body = F.concat(_plain(m["text"]), F.lit(END))
        return F.struct(head.alias("head"), body.alias("body"), (m["speaker"] == F.col("perspective")).alias("own"))

    parts = views.withColumn("parts", F.transform("said", render))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return parts.select("conv", "perspective", "block_no", F.size("said").cast("long").alias("n_messages"),
                        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
                        F.aggregate("parts", start, step, lambda acc: acc["mask"]).alias("mask"))


SQL = """
WITH m AS (
  SELECT conv_id, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(nullif(role, ''), 'unknown'), coalesce(text, '')) - 1 AS nth
  FROM conversations
), v AS (
  SELECT m.conv_id, s.perspective, m.nth // 64 AS block_no, m.nth, m.speaker = s.perspective AS own,
         CASE WHEN m.speaker = s.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(m.speaker, '<|', '<' || chr(8203) || '|') || '|>' || chr(10) END AS head,
         replace(m.text, '<|', '<' || chr(8203) || '|') || '<|end|>' || chr(10) AS body
  FROM m JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM m) s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), e AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block_no ORDER BY nth) AS until FROM v
)
SELECT conv_id, perspective, block_no, count(*) AS n_messages,
       sha256(string_agg(head || body, '' ORDER BY nth)) AS text_sha256, max(until) AS n_chars,
       count(*) FILTER (own) AS n_masked,
       coalesce(string_agg(CAST(until - length(body) AS VARCHAR) || '-' || CAST(until AS VARCHAR), ',' ORDER BY nth) FILTER (own), '') AS mask
FROM e GROUP BY conv_id, perspective, block_no
"""


@register("op1_chat_rotation", SQL)
def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return out.select(F.col("conv").alias("conv_id"), "perspective", "block_no", "n_messages",
                      F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"),
                      F.size("mask").cast("long").alias("n_masked"), F.array_join(spans, ",").alias("mask"))
