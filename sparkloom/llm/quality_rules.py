"""Quality rules with host-level verdicts, in DataFrame operations only.

Each text is measured and judged by itself; the share of failing texts of each
host is then shrunk towards the mean of all hosts by a beta prior fitted to the
hosts' rates (method of moments), so that hosts with few texts aren't judged by
chance. Hosts whose shrunk rate exceeds ``max_rate`` are rejected with all
their texts.

Texts are measured inside their rows (no word or line leaves its row), only
counts per host are shuffled, and the moments are one row of aggregates. The
join back is on the host; a host with a large share of all rows is split by
adaptive execution like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_SPLIT, stored

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, WORD_SPLIT), lambda w: w != ""), F.array().cast("array<string>"))


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null text measures as an empty one: all zero.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(*[F.col(f"`{c}`") for c in others], text.alias("_text"), words_of(text).alias("_words"), lines.alias("_lines"))
    windows = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    b = a.select(
        *[F.col(f"`{c}`") for c in others],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    c = b.withColumn("_some", F.size(F.array_distinct("_windows")) < F.size("_windows")).withColumn(
        "_sorted", F.when(F.col("_some"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    twice = F.filter(
        "_sorted",
        lambda x, j: (F.get("_sorted", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", j + 1)["h"].eqNullSafe(x["h"])),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return c.withColumn("n_repeat_words", F.when(F.col("_some"), covered).otherwise(0).cast("long")).drop("_windows", "_some", "_sorted")


def base_failure(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(measured: DataFrame, host_col: str, max_rate: float) -> DataFrame:
    """(host, host_rows, host_rate, host_failed) for every host of ``measured``, null included."""
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_rows"), F.sum(F.col("base_failed").cast("long")).alias("host_fails"))
    rate = F.col("host_fails") / F.col("host_rows")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = float(m["mean"] or 0.0), float(m["var"] or 0.0)
    strength = 1e6 if var <= 0 else min(1e6, max(1.0, mean * (1 - mean) / var - 1))
    shrunk = (F.col("host_fails") + mean * strength) / (F.col("host_rows") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_failed", shrunk > max_rate)


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", max_rate: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, measures, base_failed, host_rate, kept.

    A text fails by itself with under 50 words or with over half of its words
    in repeated three-word windows. Null texts are empty and fail. A null host
    is a host of its own. Repeated rows are judged and counted one by one. An
    empty table gives an empty result. Other columns are ignored.
    """
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = stored(text_measures(frame).withColumn("base_failed", base_failure()))
    hosts = host_verdicts(measured, "host", max_rate).select(F.col("host").alias("_host"), "host_rate", "host_failed")
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid
), m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS f FROM b GROUP BY source
), p AS (
  SELECT avg(f / n) AS mean, var_pop(f / n) AS v FROM h
), k AS (
  SELECT mean, CASE WHEN v <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, mean * (1 - mean) / v - 1)) END AS s FROM p
), verdict AS (
  SELECT source, (f + mean * s) / (n + s) > 0.5 AS bad FROM h, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM b JOIN verdict v ON b.source IS NOT DISTINCT FROM v.source
"""
