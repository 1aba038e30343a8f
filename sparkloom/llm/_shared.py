"""Helpers that several operators share: durable storage, text hashing, components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every other character belongs to a word.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a single machine) a temporary folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        held, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not held.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = held.get() if held.isDefined() else os.path.join(tempfile.gettempdir(), "checkpoints")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: no lineage, survives lost executors."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored(df)`` and its path, for ``removed``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more, and lets Spark drop the shuffles of finished plans."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def made(column: Column, make: Callable[[pd.Series], pd.DataFrame | Iterator[pd.DataFrame]], schema: str) -> Column:
    """A struct column that ``make`` computes from batches of ``column``, at once or part by part.

    Only that column goes through pandas; the others, such as nullable ids, stay as they are.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = make(batch)
            if isinstance(done, pd.DataFrame):
                yield done
            else:
                yield from done

    return F.pandas_udf(run, schema)(column)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores before them until they differ from all columns of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small, iterated table."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that their high bits are evenly spread."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the whole text.

    A-Z count as a-z. With fewer than k words the whole sequence is the only
    shingle; without words the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter((digest(x) for x in words), np.uint64, len(words))
    n = min(k, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(words) - n + 1 + i]
    return np.unique(mixed(h))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node of its component.

    Contraction: each node hangs below its smallest smaller neighbour, chains are
    halved by pointer jumping, and edges between the remaining roots go on to the
    next round. Rounds are logarithmic; no group of edges is ever collected.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    found = None
    while True:
        parent = cut(e.groupBy("u").agg(F.min("v").alias("p")))
        if parent.isEmpty():
            break
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            if parent.join(up, "p", "left_semi").isEmpty():
                break
            parent = cut(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")))
        if found is None:
            found = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("u").alias("root"), F.col("p").alias("up"))
            found = found.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            found = found.unionByName(
                step.join(found.select(F.col("node").alias("root")), "root", "left_anti").select(
                    F.col("root").alias("node"), F.col("up").alias("root")
                )
            )
        found = cut(found)
        a = parent.select("u", F.col("p").alias("pu"))
        b = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = cut(
            e.join(a, "u", "left")
            .join(b, "v", "left")
            .select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
            .distinct()
        )
    if found is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return found.unionByName(roots)
