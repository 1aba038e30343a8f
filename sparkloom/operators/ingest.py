"""Incremental ingest: what changed, what to parse, merging, deletion, equal contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension

THRESHOLD, BUDGET = 50_000, 5_000


def classify(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """``scan`` with action: skip_meta (size and time unchanged), skip_hash (content unchanged), parse or new."""
    s = stored.select("file_path", F.col("file_hash").alias("_h"), F.col("file_size").alias("_s"), F.col("file_mtime").alias("_m"), F.col("index_level").alias("_l"))
    same = (F.col("_l") == "symbol") & (F.col("file_size") == F.col("_s")) & (F.col("file_mtime") == F.col("_m"))
    action = F.when(F.col("_l").isNull(), "new").when(same, "skip_meta").when((F.col("_l") == "symbol") & (F.col("file_hash") == F.col("_h")), "skip_hash").otherwise("parse")
    return scan.join(s, "file_path", "left").withColumn("action", action).drop("_h", "_s", "_m", "_l")


def budgeted(classified: DataFrame, initial: bool, threshold: int = THRESHOLD, budget: int = BUDGET, force: bool = False) -> DataFrame:
    """Beyond ``threshold`` files only the first ``budget`` by path are parsed at first; the others become meta rows."""
    if force or not initial or classified.count() <= threshold:
        return classified
    todo = classified.where(F.col("action").isin("new", "parse"))
    first = todo.select("file_path").orderBy("file_path").limit(budget).withColumn("_now", F.lit(True))
    out = classified.join(first, "file_path", "left")
    waits = F.col("action").isin("new", "parse") & F.col("_now").isNull()
    meta = F.concat_ws(":", F.lit("meta"), F.col("file_size").cast("string"), F.col("file_mtime").cast("string"))
    return out.withColumns({"action": F.when(waits, "meta").otherwise(F.col("action")), "file_hash": F.when(waits, meta).otherwise(F.col("file_hash"))}).drop("_now")


def counters(classified: DataFrame) -> DataFrame:
    return classified.groupBy("action").agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of equal keys; ``keep`` columns stay as stored."""
    if keep:
        old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(old, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*[f"_{c}" for c in keep])
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_children(stored: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows of ``parents(key)`` give way to those of ``new``."""
    return stored.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def deleted(stored: DataFrame, scan: DataFrame) -> DataFrame:
    return stored.join(scan.select("file_path"), "file_path", "left_anti")


def equal_contents(files: DataFrame) -> DataFrame:
    """(file_hash, n, first_id) of contents that several files share."""
    return files.groupBy("file_hash").agg(F.count("*").alias("n"), F.min("file_id").alias("first_id")).where("n > 1")


def last_written(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key."""
    value = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(value.alias("r")).select("r.*")


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of ``over`` whose key it lacks: the base wins."""
    return base.unionByName(over.join(base.select(key), key, "left_anti"))


def by_precedence(levels: list[DataFrame], key: str) -> DataFrame:
    """Union of catalogs; of equal keys the last catalog's row stays."""
    rows = levels[0].withColumn("_level", F.lit(0))
    for i, more in enumerate(levels[1:], 1):
        rows = rows.unionByName(more.withColumn("_level", F.lit(i)))
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*levels[0].columns), "_level").alias("r"))
    return best.select("r.*")


def broken_references(rows: DataFrame, refs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(references without a row, rows without a reference)."""
    return refs.join(rows.select(key), key, "left_anti"), rows.join(refs.select(key).distinct(), key, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def relationship_problems(declared: DataFrame, used: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(file, rid, problem) of relationships (file, rid, type) and the elements (file, element, rid) that use them.

    An id declared twice in a file, one that isn't declared, or one whose type
    isn't the one expected of the element. Files without declarations aren't judged.
    """
    kind = F.element_at(F.split("type", "/"), -1)
    twice = declared.groupBy("file", "rid").agg(F.count("*").alias("n")).where("n > 1").select("file", "rid", F.lit("duplicate").alias("problem"))
    last = declared.groupBy("file", "rid").agg(F.max(kind).alias("kind"))
    judged = used.join(declared.select("file").distinct(), "file", "left_semi").join(last, ["file", "rid"], "left")
    names = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    want = F.element_at(names, F.col("element"))
    problem = F.when(F.col("kind").isNull(), "missing").when(want.isNotNull() & (F.lower("kind") != F.lower(want)), "type")
    return twice.unionByName(judged.select("file", "rid", problem.alias("problem")).where("problem is not null").distinct())


def undeclared_parts(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """Paths of ``parts(path)`` that neither ``overrides(path)`` names nor ``defaults(extension)`` covers."""
    named = overrides.select(F.regexp_replace("path", "^/+", "").alias("path"))
    rows = parts.withColumn("extension", extension(F.col("path"))).join(named, "path", "left_anti")
    return rows.join(defaults.select(F.lower("extension").alias("extension")).distinct(), "extension", "left_anti").select("path")


def without_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows, of chains or of their events, whose task isn't deleted."""
    return rows.join(tasks.select("task_id").distinct(), "task_id", "left_anti")
