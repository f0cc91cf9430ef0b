"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time with some more turns. Turns are sorted once by range, so
that a conversation of any length may span tasks; their places and rolling prefix hashes are prefix sums in two
levels (within a task, then over the few rows per conversation and task). A prefix hash adds up, over the turns so
far, 128 bits hashed from the turn's place, role and text. Prefixes are grouped by (length, hash) with
aggregation before the shuffle; a conversation goes when its whole hash is also a proper prefix of another, or
the whole of one with a smaller id. An anti-join keeps the rest, which are rendered in segments of
``SEGMENT`` turns, so that no group is unbounded.

Defined results: turns sort by (turn, role, text), nulls first; a null role or text counts as empty; rows without
a conversation id form one conversation with a null id, which loses ties; repeated rows are turns of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import join_side, staged

SEGMENT = 512
START, END = "<|im_start|>", "<|im_end|>"


def _placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a global sort number, per conversation and task: first number, count, place of the first)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("g")), "turns")
    spans = rows.groupBy("conv_id", F.shiftright("g", 33).alias("part")).agg(F.min("g").alias("g0"), F.count("*").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("conv_id").orderBy(F.desc("part"))
    spans = spans.select("conv_id", "part", "g0", "c", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"), (F.row_number().over(later) == 1).alias("ends"))
    return rows.withColumn("part", F.shiftright("g", 33)), staged(spans, "spans")


def _with_span(rows: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.withColumnsRenamed({"conv_id": "s_conv", "part": "s_part"})
    return rows.join(s, rows["conv_id"].eqNullSafe(s["s_conv"]) & (rows["part"] == s["s_part"])).withColumn("pos", F.col("before") + F.col("g") - F.col("g0")).drop("s_conv", "s_part")


def _prefixes(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(conv_id, pos, last, s0..s3): the rolling hash after every turn."""
    hashed = rows.select("conv_id", "part", "g", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"))
    at = _with_span(hashed, spans)
    t1, t2, low = F.xxhash64("pos", "h1", "h2"), F.xxhash64("h2", F.lit(3), "pos", "h1"), 0xFFFFFFFF
    at = at.select("conv_id", "part", "pos", "g", (F.col("ends") & (F.col("g") == F.col("g0") + F.col("c") - 1)).alias("last"), t1.bitwiseAND(F.lit(low)).alias("t0"), F.shiftrightunsigned(t1, 32).alias("t1"), t2.bitwiseAND(F.lit(low)).alias("t2"), F.shiftrightunsigned(t2, 32).alias("t3"))
    within = Window.partitionBy("conv_id", "part").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    running = at.select("conv_id", "part", "pos", "last", *[F.sum(f"t{i}").over(within).alias(f"r{i}") for i in range(4)])
    # what the earlier tasks of a conversation add; most conversations lie in one
    totals = at.groupBy("conv_id", "part").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(4)])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("conv_id").alias("b_conv"), F.col("part").alias("b_part"), *[F.sum(f"t{i}").over(earlier).alias(f"b{i}") for i in range(4)]).where("b0 is not null")
    joined = running.join(bases, running["conv_id"].eqNullSafe(bases["b_conv"]) & (running["part"] == bases["b_part"]), "left")
    return joined.select("conv_id", "pos", "last", *[(F.col(f"r{i}") + F.coalesce(f"b{i}", F.lit(0))).alias(f"s{i}") for i in range(4)])


def collapsed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(gone): ids of the conversations that another one contains as a prefix."""
    prefixes = staged(_prefixes(rows, spans), "prefixes")
    key = ["pos", "s0", "s1", "s2", "s3"]
    seen = prefixes.groupBy(key).agg(F.max((~F.col("last")).cast("int")).alias("goes_on"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("first"), F.count("*").alias("n"))
    ends = prefixes.where("last").join(seen.where("n > 1"), key)
    return ends.where((F.col("goes_on") == 1) | ~F.col("conv_id").eqNullSafe(F.col("first"))).select(F.col("conv_id").alias("gone"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of the conversations that are no prefix of another."""
    rows, spans = _placed(turns)
    gone = join_side(staged(collapsed(rows, spans), "gone"), 64)
    placed = _with_span(rows, spans)
    return placed.join(gone, placed["conv_id"].eqNullSafe(gone["gone"]), "left_anti").select("conv_id", "pos", "role", "text")


def render(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, n_turns, rendered): maximal conversations as text, ``segment`` turns a row."""
    kept = maximal_conversations(turns).select("conv_id", F.floor(F.col("pos") / segment).cast("int").alias("segment"), "pos", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n")).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return kept.groupBy("conv_id", "segment").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op9_chat_formatting": op9_chat_formatting}
SQL = {
    "op9_chat_formatting": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations),
h AS (SELECT *, sha256(string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS prefix FROM t),
e AS (SELECT pos, prefix, bool_or(pos < n - 1) AS goes_on, min(CASE WHEN pos = n - 1 THEN conv_id END) AS first_id FROM h GROUP BY pos, prefix),
k AS (SELECT h.conv_id FROM h JOIN e ON h.pos = e.pos AND h.prefix = e.prefix WHERE h.pos = h.n - 1 AND NOT goes_on AND h.conv_id IS NOT DISTINCT FROM first_id)
SELECT t.conv_id, (t.pos // 512)::INTEGER AS segment, count(*)::BIGINT AS n_turns,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY t.conv_id, t.pos // 512
"""
}
