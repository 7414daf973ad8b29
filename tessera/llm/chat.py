"""Preference formatting, in DataFrame functions only.

Conversations with the same opening turn are paired; the longest common prefix of turns is rendered once as the prompt, and what follows in
each is a completion whose assistant texts alone are unmasked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.pii import let, running
from tessera.llm.shared import range_bounds, range_bucket

#: How a turn is written: head, text, tail.
HEAD, HEAD_END, TAIL = "<|", "|>\n", "\n<|end|>\n"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (role, text) by turn, ties by role and text. A null role reads `unknown`, a null text is empty."""
    row = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def pair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, opening, pair_no, turns): conversations of one opening turn, two by two in order of conv_id.

    The rank within an opening is a rank within (opening, range of conv_id) plus the counts of the ranges before it, so no task holds an
    opening's conversations together, however many share it.
    """
    spark = conversations.sparkSession
    opened = conversations.withColumn("opening", F.xxhash64(F.get("turns", F.lit(0))))
    bounds = range_bounds(conversations, "conv_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    opened = opened.withColumn("range", range_bucket("conv_id", bounds))
    counts = opened.groupBy("opening", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("opening").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("opening", "range").orderBy("conv_id")) - 1
    return opened.withColumn("place", place).join(before, ["opening", "range"]).withColumn("pair_no", F.floor((F.col("place") + F.col("before")) / 2)).select("conv_id", "opening", "pair_no", "turns")


def written(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(HEAD_END), turn["text"], F.lit(TAIL))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, written), "")


def unmasked(turns: Column) -> Column:
    """start:end (code points, end exclusive) of each assistant text within the rendered turns, comma-joined."""

    def spans(before: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            start = F.element_at(before, i + 1) + F.length(t["role"]) + len(HEAD + HEAD_END)
            return F.when(t["role"] == "assistant", F.concat_ws(":", start.cast("string"), (start + F.length(t["text"])).cast("string")))

        return F.array_join(F.filter(F.transform(turns, one), lambda s: s.isNotNull()), ",")

    return let(running(F.transform(turns, lambda t: F.length(written(t))), F.lit(0), lambda a, b: a + b), spans)


def preference_rows(pairs: DataFrame) -> DataFrame:
    """One row a pair: chosen_id, rejected_id, prompt_turns, prompt, and both completions with their unmasked spans.

    pairs: (chosen_id, chosen, rejected_id, rejected), the conversations as arrays of (role, text). Equal conversations, or one that is the
    other's beginning, leave an empty completion. Without a rejected one (null) the prompt ends before the last assistant turn, and the
    rejected columns are null.
    """
    a, b = F.col("chosen"), F.col("rejected")
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    last = F.array_max(F.filter(F.transform(a, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()))
    common = F.when(b.isNotNull(), F.when(differ > 0, differ - 1).otherwise(F.size(a))).otherwise(F.coalesce(last, F.size(a))).cast("int")
    rows = pairs.withColumn("prompt_turns", common)
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.lit(0), F.size(c)))
    rows = rows.withColumns({"after_a": rest(a), "after_b": rest(b), "prompt": render(F.slice(a, F.lit(1), F.col("prompt_turns")))})
    return rows.select("chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", render(F.col("after_a")).alias("chosen"), unmasked(F.col("after_a")).alias("chosen_unmasked"), render(F.col("after_b")).alias("rejected"), unmasked(F.col("after_b")).alias("rejected_unmasked"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """Every conversation in exactly one row: chosen is the pair's conversation with more assistant text, ties the smaller conv_id.

    Rows with the same conv_id and turn are all kept; a null conv_id is a conversation like others; an empty table gives no rows; other
    columns are not read.
    """
    pairs = pair_conversations(conversations_of(turns))
    said = F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    both = pairs.withColumn("said", -said).groupBy("opening", "pair_no").agg(F.sort_array(F.collect_list(F.struct("said", "conv_id", "turns"))).alias("two"))
    one = lambda i, c: F.get("two", F.lit(i))[c]
    return preference_rows(both.select(one(0, "conv_id").alias("chosen_id"), one(0, "turns").alias("chosen"), one(1, "conv_id").alias("rejected_id"), one(1, "turns").alias("rejected")))


def op7_preferences(spark, sf_dir: str) -> DataFrame:
    return format_preferences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_TURN = "'<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10)"
OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT *, {_TURN} AS whole FROM t),
c AS (SELECT conv_id, count(*) AS n, max(CASE WHEN i = 1 THEN whole END) AS opening,
             coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS said,
             max(CASE WHEN role = 'assistant' THEN i END) AS last FROM w GROUP BY conv_id),
k AS (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY conv_id) - 1 AS r FROM c),
p AS (
  SELECT CASE WHEN b.conv_id IS NULL OR a.said >= b.said THEN a.conv_id ELSE b.conv_id END AS chosen_id,
         CASE WHEN b.conv_id IS NULL OR a.said >= b.said THEN b.conv_id ELSE a.conv_id END AS rejected_id,
         greatest(a.n, coalesce(b.n, 0)) AS longest, a.n AS a_n, a.last AS a_last
  FROM k a LEFT JOIN k b ON a.opening = b.opening AND b.r = a.r + 1 WHERE a.r % 2 = 0),
g AS (SELECT p.chosen_id, p.rejected_id, p.a_n, p.a_last, s.i, x.whole AS xw, y.whole AS yw
      FROM p, LATERAL (SELECT unnest(range(1, p.longest + 1)) AS i) s
      LEFT JOIN w x ON x.conv_id = p.chosen_id AND x.i = s.i
      LEFT JOIN w y ON y.conv_id = p.rejected_id AND y.i = s.i),
m AS (SELECT chosen_id, rejected_id,
             CASE WHEN rejected_id IS NULL THEN coalesce(max(a_last) - 1, max(a_n))
                  ELSE coalesce(min(CASE WHEN xw IS DISTINCT FROM yw THEN i END) - 1, max(i)) END AS prompt_turns
      FROM g GROUP BY chosen_id, rejected_id),
r AS (SELECT m.chosen_id, m.prompt_turns, w.conv_id, w.i, w.role, w.text, w.whole, w.i > m.prompt_turns AS after,
             coalesce(sum(CASE WHEN w.i > m.prompt_turns THEN length(w.whole) END) OVER (PARTITION BY w.conv_id ORDER BY w.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM m JOIN w ON w.conv_id = m.chosen_id OR w.conv_id = m.rejected_id),
s AS (SELECT conv_id, coalesce(string_agg(CASE WHEN NOT after THEN whole END, '' ORDER BY i), '') AS prompt,
             coalesce(string_agg(CASE WHEN after THEN whole END, '' ORDER BY i), '') AS said,
             coalesce(string_agg(CASE WHEN after AND role = 'assistant' THEN CAST(CAST(off + length(role) + 5 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(off + length(role) + 5 + length(text) AS BIGINT) AS VARCHAR) END, ',' ORDER BY i), '') AS spans
      FROM r GROUP BY conv_id)
SELECT m.chosen_id, m.rejected_id, CAST(m.prompt_turns AS BIGINT) AS prompt_turns, a.prompt, a.said AS chosen, a.spans AS chosen_unmasked, b.said AS rejected, b.spans AS rejected_unmasked
FROM m JOIN s a ON a.conv_id = m.chosen_id LEFT JOIN s b ON b.conv_id = m.rejected_id
"""
