"""Operator 2: chat formatting by perspective rotation.

Each participant of a conversation (each role but system) is the assistant of one rendering of it: that speaker's turns are
assistant turns and are trained on, all others are user turns under their names, system turns stay. A rendering comes in parts of
the turns numbered from k * part_turns on, so a conversation that holds a third of all turns is many bounded groups;
the parts of a rendering in order are the whole dialogue. The mask is the list of character spans that are trained on: the
assistant's words and the end mark.

A part whose turn numbers more than `crowd` rows share is cut after every `crowd` rows, in order: sub-part k has the rows from k * crowd
on, so it's a bounded stretch of the dialogue too. A later part or sub-part begins where the one before it ends, without its turns.

Defined results: turns are in order of turn (null in a part of its own, -1), then role, then text; repeated rows are turns of their own;
null text is empty; a null role is
"unknown"; null conv_id is a conversation; marks inside texts are broken up with a blank; a conversation with system turns only
has no rendering; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PART_TURNS = 256
CROWD = 4096
START, END = "<|im_start|>", "<|im_end|>\n"


def _head(role: Column, me: Column) -> Column:
    name = F.when(role == "system", F.lit("system")).when(role == me, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), name, F.lit("\n"))


def _stretches(rows: DataFrame, crowd: int) -> DataFrame:
    """The distinct rows with the sub-parts that they are in, and how often there, by their places in order: running sums within ranges of rows, on top of the sums of the ranges before."""
    order = ["turn", "role", "text"]
    counted = rows.groupBy("conv_id", "part", *order).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counted.repartitionByRange("conv_id", "part", *order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("conv_id", "part", "range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy("range")) - F.col("n")
    before = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("range").alias("r"), upto.alias("before"))
    placed = ranged.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("range") == F.col("r")))
    first = F.col("before") + F.sum("n").over(Window.partitionBy("conv_id", "part", "range").orderBy(*order)) - F.col("n")
    placed = placed.withColumn("first", first).withColumn("sub", F.explode(F.sequence(F.floor(F.col("first") / crowd), F.floor((F.col("first") + F.col("n") - 1) / crowd))))
    copies = F.least(F.col("first") + F.col("n"), (F.col("sub") + 1) * crowd) - F.greatest(F.col("first"), F.col("sub") * crowd)
    return placed.select("conv_id", "part", *order, F.col("sub").cast("long").alias("sub"), copies.cast("long").alias("copies"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, crowd: int = CROWD) -> DataFrame:
    """A row per conversation, participant and part: conv_id, participant, part, sub, n_turns, n_trained, text, mask ("from-to,...", to exclusive)."""
    role = F.replace(F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), part.alias("part"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    crowded = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    crowded = stored(crowded.select(F.col("conv_id").alias("c"), F.col("part").alias("p")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    dealt = rows.join(crowded, same, "left_anti").select("*", F.lit(0).cast("long").alias("sub"), F.lit(1).cast("long").alias("copies"))
    if crowded.limit(1).count():  # elsewhere all rows are within the first sub-part
        dealt = dealt.unionByName(_stretches(rows.join(crowded, same, "left_semi"), crowd))
    order = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies")))
    turns_of = F.flatten(F.transform(order, lambda t: F.array_repeat(F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")), t["copies"].cast("int"))))
    parts = dealt.groupBy("conv_id", "part", "sub").agg(turns_of.alias("turns"))
    people = rows.filter(F.col("role") != "system").select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    me = F.col("participant")
    size = lambda t: F.char_length(_head(t["role"], me)) + F.char_length(t["text"]) + len(END)

    def step(a: Column, t: Column) -> Column:
        begin, end = a["at"] + F.char_length(_head(t["role"], me)), a["at"] + size(t)
        span = F.concat_ws("-", begin, end)
        return F.struct(end.alias("at"), F.when(t["role"] == me, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return each.select(
        "conv_id",
        "participant",
        "part",
        "sub",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["role"] == me)).cast("long").alias("n_trained"),
        F.array_join(F.transform("turns", lambda t: F.concat(_head(t["role"], me), t["text"], F.lit(END))), "").alias("text"),
        F.array_join(F.aggregate("turns", start, step, lambda a: a["spans"]), ",").alias("mask"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(floor(turn / 256.0), -1)::BIGINT AS part, turn,
         replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
n AS (
  SELECT *, ((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // 4096)::BIGINT AS sub FROM t),
p AS (SELECT DISTINCT conv_id AS c, role AS participant FROM t WHERE role <> 'system'),
r AS (
  SELECT n.*, participant,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = participant THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM n JOIN p ON conv_id IS NOT DISTINCT FROM c),
s AS (
  SELECT *, (sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, participant, part, sub ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM r)
SELECT conv_id, participant, part, sub, count(*) AS n_turns, count(*) FILTER (role = participant) AS n_trained,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text, upto) AS text,
       coalesce(string_agg((upto - length(text) - 11)::VARCHAR || '-' || upto::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, text, upto) FILTER (role = participant), '') AS mask
FROM s GROUP BY conv_id, participant, part, sub
"""
