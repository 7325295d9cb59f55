"""Chat formatting by perspective rotation. DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask lists the character spans that the assistant's turns take, their end mark included. System
turns are shown to every perspective and are never a participant.

A conversation is rendered whole, in one row a perspective. The one exit is for a conversation that no row could hold:
beyond PART_TURNS turn numbers it comes out in parts of so many, each with a mask of its own (at 400 characters a turn
a part has 6.5 million), so no task gathers an unbounded dialogue and one that holds a third of all rows is spread over
many. Defined cases: turns are ordered by number (nulls first), then role, then text; turns of one number, or of none,
are in one part; repeated rows are rendered as often as they occur; a null role is the speaker "unknown"; a null text is
empty, a very long one stays whole; the format's marks get a space within, "<|" in texts and names and "|>" in names,
and a line break in a name becomes a space, so neither can forge a turn or end a header; a conversation of system turns
only has no perspective; null conversation ids are one conversation; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandql.llm import common

PART_TURNS = 1 << 14
END = "<|end|>\n"


def rotate(turns: DataFrame, *, part_turns: int = PART_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, mask ("start-end,start-end"), n_chars, n_mask_chars."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = lambda c: F.translate(F.replace(safe(c), F.lit("|>"), F.lit("| >")), "\r\n", "  ")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        name(F.coalesce(F.col(role_col), F.lit("unknown"))).alias("role"),
        safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long"))
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == "system", F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n")))
    seen = seen.withColumn("head", head).withColumn("own", own).withColumn("said", F.concat("head", "text", F.lit(END)))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "role", "text")
    seen = seen.withColumn("at", F.row_number().over(within)).withColumn("to", F.sum(F.length("said")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("to") - F.length("said") + F.length("head")
    span = F.when(F.col("own"), F.struct(F.col("at"), F.concat(begin.cast("string"), F.lit("-"), F.col("to").cast("string")).alias("span")))
    done = seen.groupBy("conv_id", "perspective", "block").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "").alias("rendered"),
        F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["span"]), ",").alias("mask"),
        F.sum(F.length("said")).cast("long").alias("n_chars"),
        F.coalesce(F.sum(F.when(F.col("own"), F.length("said") - F.length("head"))), F.lit(0)).cast("long").alias("n_mask_chars"),
    )
    return done.withColumnRenamed("block", "part")


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(common.table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH rows AS (
  SELECT conv_id, turn, translate(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text, coalesce(floor(turn / 16384), 0)::BIGINT AS part
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM rows WHERE role <> 'system'
), seen AS (
  SELECT r.*, s.perspective, r.role = s.perspective AS own,
    CASE WHEN r.role = 'system' THEN '<|system|>' WHEN r.role = s.perspective THEN '<|assistant|>' ELSE '<|user name=' || r.role || '|>' END || chr(10) AS head
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), turns AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS said FROM seen
), placed AS (
  SELECT *, row_number() OVER w AS pos, sum(length(said)) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, part, count(*)::BIGINT AS n_turns, string_agg(said, '' ORDER BY pos) AS rendered,
  coalesce(string_agg((upto - length(said) + length(head))::BIGINT::VARCHAR || '-' || upto::BIGINT::VARCHAR, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask,
  sum(length(said))::BIGINT AS n_chars, coalesce(sum(length(said) - length(head)) FILTER (WHERE own), 0)::BIGINT AS n_mask_chars
FROM placed GROUP BY conv_id, perspective, part
"""
