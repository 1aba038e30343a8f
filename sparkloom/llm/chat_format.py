"""Multi-party chat formatting by perspective rotation, in DataFrame operations only.

Every participant of a dialogue gets a rendering of it: their own turns are the
assistant's, the others' are named users', system turns stay the system's. The
mask lists the character ranges of the assistant's contents with their end
marks, which is what a model is to learn from that perspective.

A dialogue is rendered in parts: turns of the same ``PART_TURNS`` turn numbers
(a span), and of these ``PART_ROWS`` in order at a time (a piece). The parts of
a perspective, in the order of span and piece, follow each other without gap or
overlap, so joined they are the rendering of the whole dialogue; a system turn
stands in the part where it was said. So no dialogue, however long, becomes one
row or one task's group, and dialogues shorter than that are one part.

Spans of more rows than a piece holds are found by a count. Only their rows are
dealt out by ranges of the order, numbered within each range and moved on by
the rows of the ranges before; all others go into their part as they are.
Participants join by dialogue; nothing is collected per dialogue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

PART_TURNS, PART_ROWS = 256, 1024
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNNAMED = "system", "~unknown"


def _escaped(text: Column) -> Column:
    """Text that can't be taken for a mark."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(?=im_(?:start|end)\|>)", "< |")


def _speaker(role: Column) -> Column:
    """The role as a name without blanks; names that this changes get a digest behind ~, so that unlike roles stay unlike."""
    plain = F.trim(F.coalesce(role, F.lit("")))
    name = F.regexp_replace(plain, r"[^\p{L}\p{N}_.\-]+", "_")
    return F.when(plain == "", UNNAMED).when(name == plain, name).otherwise(F.concat(name, F.lit("~"), F.substring(F.md5(plain), 1, 16)))


def _in_pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of large spans with their piece: positions in the order, from ranges of bounded size."""
    order = ["turn", "role", "text"]
    tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    equal = rows.groupBy(*keys, *order).agg(F.count("*").alias("n"))
    ranged = stored(equal.repartitionByRange(tasks, *keys, *order).withColumn("task", F.spark_partition_id()))
    held = ranged.groupBy(*keys, "task").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "task")], F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "task")])
    within = Window.partitionBy(*keys, "task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(held, same).withColumn("at", F.col("at") + F.col("first"))
    pieces = F.sequence(F.expr(f"at div {PART_ROWS}"), F.expr(f"(at + n - 1) div {PART_ROWS}"))
    last, first = F.least(F.col("at") + F.col("n"), (F.col("piece") + 1) * PART_ROWS), F.greatest(F.col("at"), F.col("piece") * PART_ROWS)
    return placed.withColumn("piece", F.explode(pieces)).select(*keys, *order, "piece", (last - first).cast("int").alias("times"))


def rotated(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask) for every participant of every dialogue.

    Turns are ordered by number (null first), then role, then text; repeated
    rows are rendered repeatedly. Null and blank roles speak as ``~unknown``,
    null texts are empty, texts of any length stay whole. ``system`` takes no
    perspective, so a dialogue of system turns alone gives no rows. Rows with a
    null dialogue id form one dialogue of null id. part is "span.piece", both
    counted from 0 (null and negative turns: span -1); mask holds [start, end)
    ranges, counted from the start of the part's text. Other columns are
    ignored, so their names can't clash. An empty table gives an empty result.
    """
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _speaker(F.col(role_col)).alias("role"), _escaped(F.col(text_col)).alias("text"))
    rows = rows.withColumn("span", F.when(F.coalesce("turn", F.lit(-1)) < 0, -1).otherwise(F.expr(f"turn div {PART_TURNS}")).cast("long"))
    keys = ["conv_id", "span"]
    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS).select(F.col("conv_id").alias("_conv_id"), F.col("span").alias("_span")))
    one = rows.withColumns({"piece": F.lit(0).cast("long"), "times": F.lit(1)})
    if not large.isEmpty():
        is_large = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("span") == F.col("_span"))
        one = one.join(large, is_large, "left_anti").unionByName(_in_pieces(rows.join(large, is_large, "left_semi"), keys))
    parts = one.groupBy(*keys, "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "times"))).alias("turns"))
    people = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    both = parts.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["times"])))).join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def header(t: Column) -> Column:
        return F.when(t["role"] == F.col("perspective"), F.lit(f"{START}assistant\n")).when(t["role"] == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), t["role"], F.lit("\n")))

    pieces = F.transform("turns", lambda t: F.struct(header(t).alias("head"), F.concat(t["text"], F.lit(f"{END}\n")).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    shown = both.select("conv_id", "perspective", F.concat_ws(".", "span", "piece").alias("part"), pieces.alias("pieces"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        mask = F.when(p["own"], F.concat(s["mask"], F.array(F.struct(begin.cast("long").alias("start"), (end - 1).cast("long").alias("end"))))).otherwise(s["mask"])
        return F.struct(end.cast("long").alias("at"), mask.alias("mask"))

    mask = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), none.alias("mask")), step, lambda s: s["mask"])
    return shown.select(
        "conv_id", "perspective", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), mask.alias("mask"),
    )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    shown = rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    written = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return shown.withColumn("mask", written)


OP4_SQL = r"""
WITH n AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, trim(coalesce(role, '')) AS plain, regexp_replace(trim(coalesce(role, '')), '[^\p{L}\p{N}_.\-]+', '_', 'g') AS name,
         replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text
  FROM conversations
), r AS (
  SELECT conv_id, turn, CASE WHEN plain = '' THEN '~unknown' WHEN name = plain THEN name ELSE name || '~' || substr(md5(plain), 1, 16) END AS role, text,
         CASE WHEN coalesce(turn, -1) < 0 THEN -1 ELSE turn // 256 END AS span
  FROM n
), q AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, span ORDER BY turn NULLS FIRST, role, text) - 1) // 1024 AS piece FROM r
), p AS (
  SELECT DISTINCT conv_id AS c, role AS perspective FROM r WHERE role <> 'system'
), s AS (
  SELECT conv_id, perspective, span, piece, role = perspective AS own, turn, role, text,
         CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || role || chr(10) END AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM q JOIN p ON q.conv_id IS NOT DISTINCT FROM p.c
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, span, piece ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop,
         row_number() OVER (PARTITION BY conv_id, perspective, span, piece ORDER BY turn NULLS FIRST, role, text) AS k
  FROM s
)
SELECT conv_id, perspective, span || '.' || piece AS part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ',' ORDER BY k) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, span, piece
"""
