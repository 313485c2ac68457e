"""Chat formatting by multi-party perspective rotation.

Each dialogue is rendered once for every participant: that speaker's turns become ``assistant``, all others' become
``user`` turns under the speaker's name, system turns stay. Training masks follow: only the assistant's text and its
end mark are trained on. The result has a row for each (dialogue, perspective, turn) with the rendered segment and its
character offsets in the rendered dialogue, so no dialogue is gathered in one row or task: offsets are prefix sums over
runs of ``RUN`` turns, then within a run.

Edge cases: a null or empty role is the speaker ``unknown``; a null text is empty; the marks' strings inside a text are
broken up (``<|`` becomes ``< |``), and those inside a speaker's name, with its line ends, in the header; turns are ordered by number (null first), then speaker and text, repeated rows stay;
a dialogue of system turns alone has no perspective and no row; a null conv_id is a dialogue like any other; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = 512
SYSTEM = "system"


def perspectives(turns: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, start, stop, train_start, train_stop (null where not trained on)."""
    speaker = F.when(F.coalesce(F.col("role"), F.lit("")) == "", "unknown").otherwise(F.col("role"))
    said = turns.select("conv_id", "turn", speaker.alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"))
    said = said.withColumn("run", F.floor(F.coalesce("turn", F.lit(-1)) / run))
    # the speakers go to every run of their dialogue, so that turns meet them by run: a giant dialogue is many keys
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("dialogue"), F.col("speaker").alias("perspective")).distinct()
    stretches = said.select(F.col("conv_id").alias("own"), F.col("run").alias("stretch")).distinct()
    people = people.join(stretches, F.col("dialogue").eqNullSafe(F.col("own"))).drop("own")
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("dialogue")) & (F.col("run") == F.col("stretch"))).drop("dialogue", "stretch")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    plain = F.translate(F.replace("name", F.lit("<|"), F.lit("< |")), "\r\n", "  ")
    head = F.concat(F.lit("<|im_start|>"), "role", F.coalesce(F.concat(F.lit(" name="), plain), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "said", F.lit("<|im_end|>\n")))
    seen = seen.withColumn("n", F.length("segment").cast("long")).drop("said")

    runs = seen.groupBy("conv_id", "perspective", "run").agg(F.sum("n").alias("run_n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("run").alias("r"), F.coalesce(F.sum("run_n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv_id", "perspective", "run").orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("run") == F.col("r")))
    start = F.col("base") + F.col("inside")
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"), (start + F.col("n")).alias("stop"),
        F.when(trained, start + F.col("head")).alias("train_start"), F.when(trained, start + F.col("n") - 1).alias("train_stop"),
    )


SQL = """
WITH said AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id AS dialogue, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT conv_id, perspective, turn, speaker, said,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM dialogue),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate(replace(speaker, '<|', '< |'), chr(13) || chr(10), '  ') ELSE '' END || chr(10) AS head FROM seen),
segments AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM segments)
SELECT conv_id, perspective, turn, role, name, segment, start, (start + length(segment))::BIGINT AS stop,
  CASE WHEN role = 'assistant' THEN (start + length(head))::BIGINT END AS train_start,
  CASE WHEN role = 'assistant' THEN (start + length(segment) - 1)::BIGINT END AS train_stop
FROM placed
"""
