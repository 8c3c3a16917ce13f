"""Chat formatting by multi-party perspective rotation; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.llm.common import table

SYSTEM = "system"
NOBODY = "unknown"
#: Turns whose offsets are summed in one go; the sums of such blocks are then summed.
BLOCK_TURNS = 64


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv_id, perspective, turn, role_out, name, rendered, loss_mask, start_char, mask_start, mask_end, end_char.

    For every participant of a conversation its dialogue, one row for each turn: that speaker is
    the assistant, all others are users under their names, and a system turn stays one. Joined in
    the order of start_char, `rendered` is the dialogue; loss_mask is 1 on the speaker's own turns,
    whose trained characters (text and end mark) are [mask_start, mask_end). A null role is the
    participant `unknown`, a null text is empty, a null conv_id is a conversation of its own. Turns are
    ordered by turn (nulls first), role and text; repeated rows are said again. A conversation with
    system turns only has no perspective. Extra columns are left out. An empty table gives an empty result.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(NOBODY)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    people = said.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("role") == F.col("perspective")
    role_out = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    seen = seen.select(
        "*", role_out.alias("role_out"), F.when(role_out == "user", F.col("role")).alias("name"), own.cast("int").alias("loss_mask"), F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).alias("block")
    )
    head = F.concat(F.lit("<|"), "role_out", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("|>\n"))
    seen = seen.select("*", head.alias("head"), F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered")).withColumn("n", F.length("rendered").cast("long"))
    # Offsets in two steps, so that a very long conversation is not summed in one task.
    dialogue = ["conv_id", "perspective"]
    blocks = seen.groupBy(*dialogue, "block").agg(F.sum("n").alias("block_n"))
    before = F.coalesce(F.sum("block_n").over(W.partitionBy(*dialogue).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("conv_id").alias("of"), F.col("perspective").alias("by"), F.col("block").alias("nth"), before.alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("perspective") == F.col("by")) & (F.col("block") == F.col("nth"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy(*dialogue, "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = seen.join(blocks, same).withColumn("start_char", F.col("before") + inside)
    mask_start = F.when(F.col("loss_mask") == 1, F.col("start_char") + F.length("head"))
    mask_end = F.when(F.col("loss_mask") == 1, F.col("start_char") + F.col("n") - 1)
    return placed.select(
        "conv_id", "perspective", "turn", "role_out", "name", "rendered", "loss_mask", "start_char", mask_start.alias("mask_start"), mask_end.alias("mask_end"), (F.col("start_char") + F.col("n")).alias("end_char")
    )


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ROTATION_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS of_conv, role AS perspective FROM said WHERE role <> 'system'
), seen AS (
  SELECT s.*, p.perspective,
    CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS role_out,
    CASE WHEN role <> perspective AND role <> 'system' THEN role END AS name,
    CASE WHEN role = perspective THEN 1 ELSE 0 END AS loss_mask
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.of_conv
), shown AS (
  SELECT *, '<|' || role_out || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM seen
), full_text AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM shown
), placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char
  FROM full_text
)
SELECT conv_id, perspective, turn, role_out, name, rendered, CAST(loss_mask AS INTEGER) AS loss_mask,
  CAST(start_char AS BIGINT) AS start_char,
  CAST(CASE WHEN loss_mask = 1 THEN start_char + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN loss_mask = 1 THEN start_char + length(rendered) - 1 END AS BIGINT) AS mask_end,
  CAST(start_char + length(rendered) AS BIGINT) AS end_char
FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_perspective_rotation": op6_perspective_rotation}
ORACLES: dict[str, str] = {"op6_perspective_rotation": ROTATION_SQL}
