"""Results as JSON files: written where executors share them, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_dir
from ..functions.text import json_or_raw

SNAPSHOT = "canonical_id string, name string, qualified_name string, file_path string, symbol_type string, line_start int, calls array<string>"


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/result-{uuid.uuid4().hex}"


def write_result(df: DataFrame, path: str) -> str:
    """``df`` as JSON lines below ``path``, in place of what was there."""
    df.write.mode("overwrite").json(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot from JSON: rows a line, or files that hold one list or object each."""
    lines = spark.read.schema(SNAPSHOT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.where("canonical_id is not null").drop("_bad")


MATCH = (
    "type string, data struct<path:struct<text:string>,lines:struct<text:string>,line_number:long,submatches:array<struct<match:struct<text:string>,start:int,end:int>>>"
)


def matches(messages: Column) -> Column:
    """A struct (file_path, line, content, spans) of a search tool's message, as JSON, if it is a match; null for context, counts and what isn't JSON.

    Spans are the starts and ends of the matches in the line, in turn.
    """
    m = F.from_json(messages, MATCH)
    spans = F.flatten(F.transform(F.coalesce(m["data"]["submatches"], F.array().cast("array<struct<match:struct<text:string>,start:int,end:int>>")), lambda x: F.array(x["start"], x["end"])))
    found = F.struct(
        F.translate(m["data"]["path"]["text"], "\\", "/").alias("file_path"), m["data"]["line_number"].alias("line"),
        F.regexp_replace(m["data"]["lines"]["text"], r"[\r\n]+$", "").alias("content"), spans.alias("spans"),
    )
    return F.when((m["type"] == "match") & m["data"]["path"]["text"].isNotNull(), found)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line, content, spans) of the matches in files of such messages, a line each."""
    return spark.read.text(path).select(matches(F.col("value")).alias("m")).where("m is not null").select("m.*")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(path, held, raw) of status files: what each holds by key, or its text if it is no JSON object."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), json_or_raw(F.col("value")).alias("j"))
    return rows.select("path", "j.held", "j.raw")
