"""Dialogues of several parties, rendered once from the view of each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import only
from cohortlens.session import pin

#: Speaker that gives instructions and is nobody's view.
SYSTEM = "system"
#: Speaker of turns without a name.
UNKNOWN = "unknown"
#: Marker after the text of every turn.
END = "<|end|>\n"


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for every turn of a conversation and every participant as the view it is rendered from.

    Columns: conv_id, perspective, seq (place in the conversation from 0), turn, speaker, role, name, rendered,
    start, stop (characters of ``rendered`` within the whole rendered dialogue), loss, loss_start, loss_stop
    (characters that are trained on: the own turns' text and end marker; null for others). The rendered dialogue
    of a view is its rows' ``rendered`` in the order of ``seq``. The view's own turns have role
    assistant, ``system`` turns stay system, all others are user turns with the speaker's name.

    Turns are ordered by turn (null first), speaker and text; turns that are equal in all are all kept. A null or
    blank speaker is called unknown; a null text is empty; rows with a null conversation form one
    conversation. A conversation of system turns only has no view and no row.

    A conversation need not fit a task: rows are dealt by ranges of (conversation, view, turn), offsets are summed up
    within each range and carried on by one row for each range and view.
    """
    rows = only(turns, conv_id=conv_col, turn=turn_col, speaker=speaker_col, text=text_col)
    blank = F.col("speaker").isNull() | (F.trim("speaker") == "")
    rows = rows.withColumn("speaker", F.when(blank, UNKNOWN).otherwise(F.col("speaker")))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    views = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(views, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user name="), "name", F.lit("|>\n"))).otherwise(
        F.concat(F.lit("<|"), "role", F.lit("|>\n"))
    )
    seen = seen.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", F.lit(END)))
    order = ["turn", "speaker", "text"]
    dealt = seen.repartitionByRange("conv_id", "perspective", *order, F.monotonically_increasing_id())
    parts = pin(dealt.withColumn("part", F.spark_partition_id()))

    inside = Window.partitionBy("part", "conv_id", "perspective").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("rendered").cast("bigint")
    local = parts.withColumn("rows_to", F.count("*").over(inside)).withColumn("chars_to", F.sum(size).over(inside))
    totals = parts.groupBy("part", "conv_id", "perspective").agg(F.count("*").alias("n"), F.sum(size).alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("part").alias("p"),
        F.col("conv_id").alias("c"),
        F.col("perspective").alias("v"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )
    same = (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("v"))
    out = local.join(carried, same)
    stop = F.col("chars_before") + F.col("chars_to")
    start = stop - size
    return out.select(
        "conv_id",
        "perspective",
        (F.col("rows_before") + F.col("rows_to") - 1).alias("seq"),
        "turn",
        "speaker",
        "role",
        "name",
        "rendered",
        start.alias("start"),
        stop.alias("stop"),
        own.alias("loss"),
        F.when(own, start + F.col("head")).alias("loss_start"),
        F.when(own, stop).alias("loss_stop"),
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN role IS NULL OR trim(role) = '' THEN '{UNKNOWN}' ELSE role END AS speaker,
         coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS seq FROM t
), v AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'
), s AS (
  SELECT n.*, v.perspective, n.speaker = v.perspective AS loss,
         CASE WHEN n.speaker = v.perspective THEN 'assistant' WHEN n.speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role
  FROM n JOIN v ON n.conv_id IS NOT DISTINCT FROM v.conv_id
), r AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         CASE WHEN role = 'user' THEN '<|user name=' || speaker || '|>' || chr(10) ELSE '<|' || role || '|>' || chr(10) END AS head
  FROM s
), x AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM r
), o AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY seq) AS BIGINT) AS stop FROM x
)
SELECT conv_id, perspective, seq, turn, speaker, role, name, rendered, stop - length(rendered) AS start, stop, loss,
       CASE WHEN loss THEN stop - length(rendered) + length(head) END AS loss_start, CASE WHEN loss THEN stop END AS loss_stop
FROM o
"""
