"""The shared test tables seen as a code index and a project memory.

``SQL`` holds the same views as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.sha2("text", 256).alias("file_hash"),
        F.col("n_chars").alias("file_size"),
        (F.col("doc_id") + 1_700_000_000).alias("file_mtime"),
        F.col("lang").alias("language"),
        line_count(F.col("text")).alias("line_count"),
        F.lit("symbol").alias("index_level"),
    )


def symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("symbol_id"),
        (F.col("p_partkey") % 200).alias("file_id"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("scope"),
        F.when(F.col("p_partkey") % 5 == 0, "class").otherwise("function").alias("symbol_type"),
        (F.expr("p_partkey div 200") * 10 + 1).cast("int").alias("line_start"),
        (F.expr("p_partkey div 200") * 10 + 1 + F.col("p_size")).cast("int").alias("line_end"),
    )
    return rows.withColumn("qualified_name", F.concat_ws("::", "scope", "name")).drop("scope")


def calls(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_suppkey"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return line.join(part, "l_suppkey").select(
        F.col("l_partkey").alias("caller_id"),
        F.concat(F.when(F.col("l_suppkey") % 10 == 0, "ext_").otherwise(""), F.col("name")).alias("callee_name"),
        F.col("l_linenumber").alias("call_line"),
    )


def memos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity"),
        F.col("props").alias("act"),
        F.col("props").alias("content"),
        F.col("ts").alias("timestamp"),
    )


def chat_memos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("role").alias("category"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("entity"),
        F.lit("said").alias("act"),
        F.col("text").alias("content"),
    )


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("bench").alias("type"), F.col("text").alias("summarize"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks: what is asked is their priority, how they went their state and sum."""
    return table(spark, d, "orders").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("task_id"), F.col("o_orderpriority").alias("description"),
        F.concat(F.lit("state "), F.col("o_orderstatus"), F.lit(" of customer "), F.col("o_custkey").cast("string")).alias("summary"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def chain_events(spark: SparkSession, d: str) -> DataFrame:
    names = {"view": "start", "click": "complete", "purchase": "pass", "error": "fail", "signup": "init"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("task_id"), kind.alias("event_type"), F.col("ts").alias("created_at")
    )


def text_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        "text",
    )


def stored_files(spark: SparkSession, d: str) -> DataFrame:
    """An older state of the index: some rows changed, some unknown, some since deleted."""
    f = files(spark, d).where("file_id % 17 <> 0")
    old = f.withColumn("file_hash", F.when(F.col("file_id") % 13 == 0, "old").otherwise(F.col("file_hash"))).withColumn(
        "file_mtime", F.when((F.col("file_id") % 13 == 0) | (F.col("file_id") % 7 == 0), F.col("file_mtime") - 60).otherwise(F.col("file_mtime"))
    )
    gone = files(spark, d).where("file_id % 19 = 0").withColumns(
        {"file_id": -F.col("file_id") - 1, "file_path": F.concat(F.lit("gone/"), F.col("file_path"))}
    )
    return old.unionByName(gone)


def snapshot_symbols(spark: SparkSession, d: str, target: bool) -> DataFrame:
    s = symbols(spark, d)
    if not target:
        return s.where("symbol_id % 10 <> 0")
    flipped = F.when(F.col("symbol_type") == "class", "function").otherwise("class")
    return s.where("symbol_id % 10 <> 1").withColumn("symbol_type", F.when(F.col("symbol_id") % 7 == 0, flipped).otherwise(F.col("symbol_type")))


SQL = r"""
files AS (
  SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path, sha256(text) AS file_hash, n_chars AS file_size,
         doc_id + 1700000000 AS file_mtime, lang AS language,
         CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS INTEGER) AS line_count,
         'symbol' AS index_level
  FROM documents
), symbols AS (
  SELECT p_partkey AS symbol_id, p_partkey % 200 AS file_id, replace(p_name, ' ', '_') AS name,
         CASE WHEN p_partkey % 5 = 0 THEN 'class' ELSE 'function' END AS symbol_type,
         CAST((p_partkey // 200) * 10 + 1 AS INTEGER) AS line_start, CAST((p_partkey // 200) * 10 + 1 + p_size AS INTEGER) AS line_end,
         replace(p_brand, '#', '_') || '::' || replace(p_name, ' ', '_') AS qualified_name
  FROM part
), calls AS (
  SELECT l_partkey AS caller_id, CASE WHEN l_suppkey % 10 = 0 THEN 'ext_' ELSE '' END || replace(p_name, ' ', '_') AS callee_name, l_linenumber AS call_line
  FROM lineitem JOIN part ON p_partkey = l_suppkey
), own AS (
  SELECT name, file_id, min(symbol_id) AS symbol_id FROM symbols GROUP BY name, file_id
), anywhere AS (
  SELECT name, min(symbol_id) AS symbol_id FROM symbols GROUP BY name
), linked AS (
  SELECT c.caller_id, c.callee_name, c.call_line, coalesce(o.symbol_id, a.symbol_id) AS callee_id
  FROM calls c JOIN symbols s ON s.symbol_id = c.caller_id
  LEFT JOIN own o ON o.name = c.callee_name AND o.file_id = s.file_id LEFT JOIN anywhere a ON a.name = c.callee_name
), edges AS (
  SELECT caller_id AS src, callee_id AS dst, count(*) AS n FROM linked WHERE callee_id IS NOT NULL GROUP BY ALL
), fan AS (
  SELECT symbol_id, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in FROM symbols
  LEFT JOIN (SELECT caller_id, count(*) AS n FROM linked GROUP BY 1) o ON o.caller_id = symbol_id
  LEFT JOIN (SELECT callee_id, count(*) AS n FROM linked GROUP BY 1) i ON i.callee_id = symbol_id
), complexity AS (
  SELECT name, max(fan_out) AS fan_out, max(fan_in) AS fan_in, 1.0 * max(fan_out) + 0.5 * max(fan_in) AS score FROM symbols JOIN fan USING (symbol_id) GROUP BY name
), memos AS (
  SELECT event_id AS id, event_type AS category, 'user_' || user_id AS entity, props AS act, props AS content, ts AS timestamp FROM events
), chat_memos AS (
  SELECT conv_id * 1000 + turn AS id, role AS category, 'conv_' || conv_id AS entity, 'said' AS act, text AS content FROM conversations
), facts AS (
  SELECT item_id AS id, 'bench' AS type, text AS body FROM benchmark
), chain_events AS (
  SELECT event_id AS id, 'task_' || user_id AS task_id,
         CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'init' END AS event_type,
         ts AS created_at
  FROM events
), stored AS (
  SELECT file_id, file_path, CASE WHEN file_id % 13 = 0 THEN 'old' ELSE file_hash END AS file_hash, file_size,
         CASE WHEN file_id % 13 = 0 OR file_id % 7 = 0 THEN file_mtime - 60 ELSE file_mtime END AS file_mtime, index_level
  FROM files WHERE file_id % 17 <> 0
  UNION ALL SELECT -file_id - 1, 'gone/' || file_path, file_hash, file_size, file_mtime, index_level FROM files WHERE file_id % 19 = 0
), tasks AS (
  SELECT 'order_' || o_orderkey AS task_id, o_orderpriority AS description, 'state ' || o_orderstatus || ' of customer ' || o_custkey AS summary, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders
), lines AS (
  SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS file_path, CAST(i AS INTEGER) AS line, string_split(text, chr(10))[i] AS content
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
)
"""
