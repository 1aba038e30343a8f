"""Structured Streaming over the append-only event logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import shared_dir
from ..operators.taskchain import STATE, Fold

EVENTS = "id long, task_id string, event_type string, created_at timestamp"


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(day, event_type, n) in tumbling windows; events later than ``late`` are dropped."""
    w = F.window("created_at", window)
    return events.withWatermark("created_at", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def chain_states(events: DataFrame, protocol: str = "develop") -> DataFrame:
    """The state of every task after each batch that brings it events; ``events`` is a stream.

    Events of a batch are applied by time and id, so batches must follow time.
    """
    saved = T.StructType().add("state", "string")

    def run(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        fold = Fold(key[0], protocol)
        if held.exists:
            fold = Fold.resumed(tuple(json.loads(held.get[0])))
        rows = pd.concat(list(batches))  # the task's events of one batch; its size is bounded by the source's options
        rows = rows.sort_values(["created_at", "id"])
        given = [rows[c] if c in rows else [None] * len(rows) for c in ("phase_id", "sub_id", "payload")]
        for kind, *more in zip(rows["event_type"], *given, strict=True):
            fold.add(kind, *[None if x is None or x != x else x for x in more])
        held.update((json.dumps(fold.row()),))
        yield pd.DataFrame([fold.row()], columns=[f.split()[0] for f in STATE.split(", ")])

    return events.groupBy("task_id").applyInPandasWithState(run, STATE, saved, "update", "NoTimeout")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of its file."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    names = {"view": "start", "click": "complete", "purchase": "pass", "error": "fail", "signup": "init"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type"))
    return raw.select(F.col("event_id").alias("id"), F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("task_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("created_at"))


def _collected(df: DataFrame, mode: str) -> DataFrame:
    """The rows that a stream gives for what is there now: each batch is written to the shared folder; of whole results the last one counts."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    kept: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        kept.append(f"{folder}/rows/{number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(*(kept[-1:] if mode == "complete" else kept)) if kept else spark.createDataFrame([], df.schema)


def stream_event_counts(s: SparkSession, d: str) -> DataFrame:
    return _collected(windowed_counts(_stream(s, d)), "complete").select(F.col("day").cast("string").alias("day"), "event_type", "n")


def stream_task_chain(s: SparkSession, d: str) -> DataFrame:
    return _collected(chain_states(_stream(s, d)), "update").select("task_id", "status", "current_phase", "n_events", "n_errors", "reinit_count", "phases_json")


QUERIES = {"stream_event_counts": stream_event_counts, "stream_task_chain": stream_task_chain}
