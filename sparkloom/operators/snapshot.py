"""Snapshots of the index and their difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(canonical_id, name, qualified_name, file_path, symbol_type, line_start, calls); of equal ids the largest symbol stays."""
    prefix = F.when(F.col("symbol_type") == "class", "class").otherwise("func")
    rows = symbols.join(files.select("file_id", "file_path"), "file_id").withColumn("canonical_id", F.concat(prefix, F.lit(":"), "file_path", F.lit("::"), "name"))
    last = rows.groupBy("canonical_id").agg(F.max(F.struct("symbol_id", "name", "qualified_name", "file_path", "symbol_type", "line_start")).alias("s"))
    made = calls.groupBy(F.col("caller_id").alias("symbol_id")).agg(F.sort_array(F.collect_list("callee_name")).alias("calls"))
    flat = last.select("canonical_id", "s.*").join(made, "symbol_id", "left")
    return flat.drop("symbol_id").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))


def diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """(canonical_id, change, message): removed, added, and what of path, type or set of calls was modified."""
    a, b = base.alias("a"), target.alias("b")
    both = a.join(b, F.col("a.canonical_id") == F.col("b.canonical_id"), "full_outer")
    lost = F.array_size(F.array_except("a.calls", "b.calls"))
    new = F.array_size(F.array_except("b.calls", "a.calls"))
    what = F.concat_ws(
        "; ",
        F.when(F.col("a.file_path") != F.col("b.file_path"), "moved"),
        F.when(F.col("a.symbol_type") != F.col("b.symbol_type"), "type"),
        F.when((lost > 0) | (new > 0), F.concat(F.lit("calls +"), new.cast("string"), F.lit(" -"), lost.cast("string"))),
    )
    change = F.when(F.col("b.canonical_id").isNull(), "removed").when(F.col("a.canonical_id").isNull(), "added").when(what != "", "modified")
    message = F.when(change == "modified", what).otherwise(change)
    return both.select(F.coalesce("a.canonical_id", "b.canonical_id").alias("canonical_id"), change.alias("change"), message.alias("message")).where("change is not null")
