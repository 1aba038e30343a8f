"""Versioned Parquet tables: changes are written beside the tables and take effect together.

A commit is a small file that names the folders which make up every table; it is
written last, so readers see all tables of a change or none. A table is one
folder, or is cut into buckets of a hash: then a change writes the buckets it
touches, and the commit goes on naming the folders of the others. Commits can
carry marks, such as the number of the last batch of a stream that they hold.
A version being read is never overwritten; folders that none of the newest
commits names are deleted. Paths go through Hadoop's file systems, so any store
will do. One writer at a time: of two commits with one number the later fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store; a bucket of a table should come to some 100 MB.
BUCKETS = 16


@dataclass(frozen=True)
class Part:
    """New contents of some buckets: rows with their ``bucket``. Buckets listed without rows become empty."""

    rows: DataFrame
    buckets: tuple[int, ...]


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2, buckets: int = BUCKETS):
        self.spark, self.root, self.keep, self._new_buckets = spark, root.rstrip("/"), keep, buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commits(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self._names(f"{self.root}/_commits") if x.endswith(".json"))

    def _state_of(self, number: int) -> dict:
        return json.loads(self._text(f"{self.root}/_commits/{number:012d}.json"))

    def _state(self) -> tuple[int, dict]:
        """The newest commit's number, and what it says."""
        commits = self._commits()
        return (commits[-1], self._state_of(commits[-1])) if commits else (-1, {"buckets": self._new_buckets, "tables": {}, "marks": {}})

    @property
    def buckets(self) -> int:
        return self._state()[1]["buckets"]

    def bucket(self, *columns: str | Column) -> Column:
        """The bucket that a key's hash falls into."""
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def mark(self, name: str) -> int | None:
        return self._state()[1]["marks"].get(name)

    def paths(self, name: str, buckets: Iterable[int] | None = None) -> list[str]:
        """The folders that hold a table now, or some buckets of it."""
        held = self._state()[1]["tables"].get(name)
        if not isinstance(held, dict):
            return [] if held is None else [f"{self.root}/{name}/{held}"]
        chosen = held if buckets is None else [str(b) for b in buckets]
        return [f"{self.root}/{name}/{held[b]}" for b in chosen if b in held]

    def read(self, name: str, schema: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The newest version of a table, or of some buckets; empty where there is none."""
        paths = self.paths(name, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, name: str, df: DataFrame) -> None:
        self.commit({name: df})

    def commit(self, tables: dict[str, DataFrame | Part], marks: dict[str, int] | None = None) -> None:
        """New versions of several tables, or of buckets of them, visible together."""
        number, state = self._state()
        held = dict(state["tables"])
        for name, change in tables.items():
            version = f"v{number + 1:06d}-{uuid.uuid4().hex[:8]}"
            folder = f"{self.root}/{name}/{version}"
            if isinstance(change, DataFrame):
                change.write.parquet(folder)
                held[name] = version
                continue
            own = dict(held.get(name) or {})
            for b in change.buckets:
                own.pop(str(b), None)
            if change.buckets:
                change.rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
                own |= {x.split("=")[1]: f"{version}/{x}" for x in self._names(folder) if x.startswith("bucket=")}
            held[name] = own
        fs, p = self._fs(f"{self.root}/_commits/{number + 1:012d}.json")
        out = fs.create(p, False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps({"buckets": state["buckets"], "tables": held, "marks": state["marks"] | (marks or {})}).encode()))
        finally:
            out.close()
        self._tidy(list(tables))

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _tidy(self, names: list[str]) -> None:
        """Deletes old commits, and of the tables named what none of the others mentions."""
        commits = self._commits()
        kept = [self._state_of(n)["tables"] for n in commits[-self.keep - 1 :]]
        for old in commits[: -self.keep - 1]:
            self._delete(f"{self.root}/_commits/{old:012d}.json")
        for name in names:
            said = [x[name] for x in kept if name in x]
            used = {p for x in said for p in (x.values() if isinstance(x, dict) else [x])}
            whole = {p.split("/")[0] for p in used}
            for version in self._names(f"{self.root}/{name}"):
                if version not in whole:
                    self._delete(f"{self.root}/{name}/{version}")
                elif version not in used:
                    for x in self._names(f"{self.root}/{name}/{version}"):
                        if x.startswith("bucket=") and f"{version}/{x}" not in used:
                            self._delete(f"{self.root}/{name}/{version}/{x}")

    def append(self, name: str, df: DataFrame, schema: str) -> None:
        """Rows are added to the newest version in place; appends don't disturb readers, nor each other. For tables of one folder."""
        rows = df.select(*[f.split()[0] for f in schema.split(", ")])
        held = self.paths(name)
        if held:
            rows.write.mode("append").parquet(held[0])
        else:
            self.commit({name: rows})

    def sizes(self) -> dict[str, int]:
        """Bytes of the newest version of each table."""
        out = {}
        for name in self._state()[1]["tables"]:
            found = [self._fs(x) for x in self.paths(name)]
            out[name] = sum(int(fs.getContentSummary(p).getLength()) for fs, p in found)
        return out

    def put_text(self, name: str, text: str) -> None:
        """A small file beside the tables; it is written aside and renamed, so readers see the old text or the new one."""
        jvm = self.spark.sparkContext._jvm
        conf, hadoop = self.spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs
        fs, aside = self._fs(f"{self.root}/_new-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        at = fs.makeQualified(hadoop.Path(f"{self.root}/{name}"))
        fs.mkdirs(at.getParent())
        hadoop.FileContext.getFileContext(at.toUri(), conf).rename(fs.makeQualified(aside), at, over)

    def make_text(self, name: str, text: str) -> bool:
        """A small file that only one of several writers can make; whether it was this one."""
        fs, p = self._fs(f"{self.root}/{name}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def get_text(self, name: str) -> str | None:
        """A small file's text, or None; one that is being replaced is tried again, as a local disk replaces text and checksum in turn."""
        for pause in (0.02, 0.05, 0.1, 0.2, None):
            try:
                return self._text(f"{self.root}/{name}")
            except Py4JJavaError:
                if pause is None:
                    raise
                time.sleep(pause)
        return None

    def drop_text(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")
