"""Keeps the index tables in step with a tree, at the price of what changed.

``files``, ``symbols``, ``calls`` and ``edges`` are cut into buckets by file,
``names`` (who defines a name) and ``callers`` (which buckets call a name) by
name, and ``grams`` (the names by their pairs of characters) by pair. A change writes the buckets of the changed files. Calls are linked anew
only if their file changed, or if their name gained or lost a definition:
``callers`` tells which buckets hold such calls, ``names`` what they link to, so
neither all calls nor all symbols are read. What the driver collects are bucket
numbers and counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schemas
from .durable import cut
from .operators import grams, ingest
from .sources import files as source_files
from .sources import parser
from .sources.store import Part, Store

CALLS = f"{schemas.CALLS}, file_id long"
NAMES = "name string, file_id long, symbol_id long"
CALLERS = "callee_name string, file_bucket int"
EDGES = "src long, dst long, n long"
#: Files that a parsing task reads.
PER_TASK = 200


def _numbers(*rows: DataFrame) -> tuple[int, ...]:
    """The distinct buckets of some rows; there are as many as the store has, at most."""
    return tuple(sorted({r["bucket"] for df in rows for r in df.select("bucket").distinct().collect()}))


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def linked(calls: DataFrame, names: DataFrame) -> DataFrame:
    """``calls(..., callee_name, file_id)`` with callee_id from ``names``: the namesake in the caller's file, else the smallest id, else null."""
    own = names.groupBy(F.col("name").alias("callee_name"), "file_id").agg(F.min("symbol_id").alias("_own"))
    anywhere = names.groupBy(F.col("name").alias("callee_name")).agg(F.min("symbol_id").alias("_any"))
    both = calls.drop("callee_id").join(own, ["callee_name", "file_id"], "left").join(anywhere, "callee_name", "left")
    return both.withColumn("callee_id", F.coalesce("_own", "_any")).drop("_own", "_any")


def planned(found: DataFrame, old: DataFrame, force: bool, threshold: int, budget: int) -> DataFrame:
    """What to do with each file by size and time alone: skip_meta, new, parse, or meta for those beyond the budget."""
    known = old.where("false") if force else old
    rows = ingest.classify(found.withColumn("file_hash", F.lit(None).cast("string")), known)
    behind = not force and (old.isEmpty() or not old.where("index_level = 'meta'").isEmpty())
    return ingest.budgeted(rows, behind, threshold, budget, force)


class Refresh:
    """One step from the index to the state of some files."""

    def __init__(
        self, store: Store, root: str, force: bool = False, threshold: int = ingest.THRESHOLD, budget: int = ingest.BUDGET, until: float | None = None, said: Callable[[int, int], None] | None = None
    ):
        self.store, self.root, self.force, self.threshold, self.budget, self.until, self.said = store, root, force, threshold, budget, until, said
        n = F.lit(store.buckets)
        self.by_file = F.pmod(F.col("file_id"), n).cast("int")
        self.by_name = lambda c: F.pmod(F.xxhash64(c), n).cast("int")

    def old_files(self) -> DataFrame:
        return self.store.read("files", schemas.FILES)

    def run(self, found: DataFrame, gone: DataFrame, marks: dict[str, int] | None = None) -> dict[str, int]:
        """Brings the index to ``found(file_path, file_size, file_mtime, extension)`` and drops ``gone(file_id)``; the number of files by action.

        All tables change together, with ``marks``. Where nothing changed nothing is written.
        """
        old = self.old_files()
        plan = cut(planned(found, old, self.force, self.threshold, self.budget).withColumn("file_id", F.xxhash64("file_path")))
        wanted = plan.where("action in ('new', 'parse')")
        hashes = old.where("index_level = 'symbol'").select("file_path", F.col("file_hash").alias("known_hash"))
        todo = wanted.join(hashes.where("false") if self.force else hashes, "file_path", "left").select("file_path", "extension", "known_hash")
        n = wanted.count()
        if self.said:
            self.said(0, n)
        dealt = todo.repartition(max(1, min(n, max(-(-n // PER_TASK), 4 * self.store.spark.sparkContext.defaultParallelism))))
        read = cut(parser.read_changed(dealt, self.root).withColumn("file_id", F.xxhash64("file_path")))
        if self.said:
            self.said(n, n)
        done = plan.drop("file_hash").join(read.where("kind in ('file', 'same')").select("file_id", "kind", "file_hash", "line_count"), "file_id")
        done = done.withColumn("action", F.when(F.col("kind") == "same", "skip_hash").otherwise(F.col("action"))).drop("kind")
        stale = plan.where("action = 'meta'").withColumn("line_count", F.lit(0))
        stale = stale.join(old.select("file_id", "file_hash"), ["file_id", "file_hash"], "left_anti")
        judged = cut(done.unionByName(stale))
        gone = cut(gone.select("file_id").distinct())
        tables = self._tables(old, judged, read, gone)
        if self.until and time.time() > self.until:
            raise TimeoutError("the ingest took too long")
        if tables or marks:
            self.store.commit(tables, marks)
        actions = judged.where("action <> 'meta'").select("action").unionByName(plan.where("action in ('skip_meta', 'meta')").select("action"))
        counted = actions.unionByName(gone.select(F.lit("removed").alias("action"))).groupBy("action").agg(F.count("*").alias("n"))
        return {r["action"]: r["n"] for r in counted.collect()}

    def _tables(self, old: DataFrame, judged: DataFrame, read: DataFrame, gone: DataFrame) -> dict[str, Part]:
        store, bucket = self.store, self.by_file
        own = _numbers(judged.select(bucket.alias("bucket")), gone.select(bucket.alias("bucket")))
        if not own:
            return {}
        dropped = cut(judged.where("action <> 'skip_hash'").select("file_id").unionByName(gone).distinct())
        written = _numbers(dropped.select(bucket.alias("bucket")))
        out = {"files": Part(self._files(own, judged, gone), own)}
        if not written:
            return out
        # definitions
        symbols = self._symbols(read)
        before = store.read("symbols", schemas.SYMBOLS, written)
        lost = before.join(dropped, "file_id", "left_semi")
        out["symbols"] = Part(before.join(dropped, "file_id", "left_anti").unionByName(symbols).withColumn("bucket", bucket), written)
        # names that gained or lost a definition
        columns = _columns(NAMES)
        both = lost.select(*columns).unionByName(symbols.select(*columns))
        moved = cut(both.groupBy("name", "symbol_id").agg(F.count("*").alias("n")).where("n = 1").select("name").distinct().withColumn("bucket", self.by_name("name")))
        name_buckets = _numbers(moved)
        names = store.read("names", NAMES, name_buckets).join(lost.select("symbol_id"), "symbol_id", "left_anti").select(*columns)
        names = names.unionByName(symbols.select(*columns)).withColumn("bucket", self.by_name("name")).where(F.col("bucket").isin(*name_buckets))
        out["names"] = Part(names, name_buckets)
        out["grams"] = self._grams(store.read("names", NAMES, name_buckets), names, moved)
        # calls to link: of changed files, and of such names anywhere
        calls = self._calls(read)
        far = store.read("callers", CALLERS, name_buckets).join(moved.select(F.col("name").alias("callee_name")), "callee_name", "left_semi")
        touched = tuple(sorted({*written, *_numbers(far.select(F.col("file_bucket").alias("bucket")))}))
        held = store.read("calls", CALLS, touched)
        kept = held.join(dropped, "file_id", "left_anti")
        is_moved = moved.select(F.col("name").alias("callee_name"))
        to_link = calls.unionByName(kept.join(is_moved, "callee_name", "left_semi"))
        needed = _numbers(calls.select(self.by_name("callee_name").alias("bucket")))
        others = store.read("names", NAMES, [b for b in needed if b not in name_buckets])
        whole = linked(to_link, names.select(*columns).unionByName(others)).select(*_columns(CALLS)).unionByName(kept.join(is_moved, "callee_name", "left_anti").select(*_columns(CALLS)))
        whole = cut(whole.withColumn("bucket", bucket))
        out["calls"] = Part(whole, touched)
        edges = whole.where("callee_id is not null").groupBy("bucket", F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).agg(F.count("*").alias("n"))
        out["edges"] = Part(edges, touched)
        # which buckets call a name
        pair = lambda df: df.select("callee_name", bucket.alias("file_bucket")).where(F.col("file_bucket").isin(*written)).distinct()
        was, now = pair(held), pair(whole)
        changed = cut(was.exceptAll(now).withColumn("gain", F.lit(False)).unionByName(now.exceptAll(was).withColumn("gain", F.lit(True))).withColumn("bucket", self.by_name("callee_name")))
        caller_buckets = _numbers(changed)
        rows = store.read("callers", CALLERS, caller_buckets).join(changed.where("not gain").select("callee_name", "file_bucket"), ["callee_name", "file_bucket"], "left_anti")
        rows = rows.unionByName(changed.where("gain").select("callee_name", "file_bucket"))
        out["callers"] = Part(rows.withColumn("bucket", self.by_name("callee_name")), caller_buckets)
        return out

    def _grams(self, before: DataFrame, after: DataFrame, moved: DataFrame) -> Part:
        """The index of names, with those that came into being or went."""
        only = lambda df: df.select("name").distinct().join(moved.select("name"), "name", "left_semi")
        lost, made = cut(only(before).exceptAll(only(after))), cut(only(after).exceptAll(only(before)))
        bucket = self.by_name("gram")
        new = cut(grams.table(made).withColumn("bucket", bucket))
        touched = _numbers(new, grams.table(lost).select(bucket.alias("bucket")))
        kept = self.store.read("grams", grams.TABLE, touched).join(lost, "name", "left_anti").withColumn("bucket", bucket)
        return Part(kept.unionByName(new), touched)

    def _files(self, own: tuple[int, ...], judged: DataFrame, gone: DataFrame) -> DataFrame:
        now = F.unix_timestamp()
        names = F.create_map(*[F.lit(x) for kv in source_files.LANGUAGES.items() for x in kv])
        rows = judged.select(
            "file_id", "file_path", "file_hash", "file_size", "file_mtime", F.coalesce(F.element_at(names, F.col("extension")), F.lit("unknown")).alias("language"),
            F.col("line_count").cast("int").alias("line_count"), F.when(F.col("action") == "meta", "meta").otherwise("symbol").alias("index_level"), now.alias("indexed_at"), now.alias("updated_at"),
        )
        kept = self.store.read("files", schemas.FILES, own).join(gone, "file_id", "left_anti")
        return ingest.upsert(kept, rows, ["file_path"], keep=("indexed_at",)).withColumn("bucket", self.by_file)

    def _symbols(self, read: DataFrame) -> DataFrame:
        prefix = F.when(F.col("symbol_type") == "class", "class").otherwise("func")
        return read.where("kind = 'symbol'").select(
            parser.symbol_id(F.col("file_path"), F.col("ordinal")).alias("symbol_id"), "file_id", "name", F.col("scope_path").alias("qualified_name"),
            F.concat(prefix, F.lit(":"), "file_path", F.lit("::"), "name").alias("canonical_id"), "scope_path", "symbol_type", "line_start", "line_end", "signature", F.lit(None).cast("long").alias("parent_id"),
        )

    def _calls(self, read: DataFrame) -> DataFrame:
        return read.where("kind = 'call'").select(
            F.xxhash64("file_path", F.lit("call"), "ordinal").alias("call_id"), parser.symbol_id(F.col("file_path"), F.col("caller")).alias("caller_id"),
            F.col("name").alias("callee_name"), "call_line", F.lit(None).cast("long").alias("callee_id"), "file_id",
        )
