"""Lines that many documents share, found by a sorted stream of hashes; the result is a keep bitmap per document.

A line's key is the line without white space at its ends and with A-Z as a-z.
Keys of at least ``min_chars`` characters that at least ``min_docs`` documents
hold lose their lines, except in the document with the largest id.

Rows (two 64-bit hashes of the key, document, position) are range-partitioned
and sorted by hashes, then document from the largest id down, then position.
Each task streams over its range: the first document of a key is the one that
keeps it, and rows of the next documents wait until ``min_docs`` documents are
seen, so a task holds the rows of fewer than that many documents, whatever the
size of a key. Ranges are cut by hashes and document, so a line of a third of
all documents is spread over many tasks. A key that a cut divides is the last
of one range and the first of the next: for these the tasks give one row of
count and largest id each, and leave the few rows open that depend on other
tasks. They are decided by a join with the sums of those rows, of which there
are two a task at most.

What comes out is run lengths of lines kept and dropped in turn, a bitmap in
compressed form; only documents that lose a line have a row. Texts are joined
with it once, where the lines are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import made, stored, unused

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAST_ID = -(2**63)
_DROPPED, _OPEN, _SUM = 0, 1, 2


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc, th, pos) for every line that is long enough."""
    text = F.col(text_col)
    keys = F.transform(lines_of(text), lambda x, i: F.struct(line_key(x).alias("k"), i.cast("long").alias("pos")))
    long = F.filter(keys, lambda x: F.char_length(x["k"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(1), x["k"]).alias("h2"), x["pos"].alias("pos")))
    own = docs.select(_id(id_col).alias("doc"), F.xxhash64(text).alias("th"), hashed.alias("rows"))
    return own.select("doc", "th", F.inline("rows")).select("h1", "h2", "doc", "th", "pos")


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID))


def first_occurrences(min_docs: int):
    """Streams one sorted range; see the module. Gives rows (kind, h1, h2, doc, th, pos).

    Kinds: a line to drop; a line left open, as its key may go on in another
    range; a sum, with the key's largest document as doc and its number of
    documents in this range as pos.
    """
    names = ("h1", "h2", "doc", "th", "pos")

    def batch_of(kind: np.ndarray | int, rows: np.ndarray) -> pa.RecordBatch:
        kinds = np.broadcast_to(np.asarray(kind, np.int32), rows.shape[1:])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (kinds, *rows)], names=["kind", *names])

    def sum_of(key: tuple, n: int, first: int) -> pa.RecordBatch:
        return batch_of(_SUM, np.array([[key[0]], [key[1]], [first], [0], [n]], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = np.empty((5, 0), np.int64)  # rows of the last key, while fewer than min_docs documents hold it
        first_key = common = None  # the range's first key; the last key, once min_docs documents hold it
        n = largest = last = 0  # of the common key: documents, the first and the newest of them
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.int64, copy=False)
            if not rows.shape[1]:
                continue
            if common is not None:
                other = np.flatnonzero((rows[0] != common[0]) | (rows[1] != common[1]))
                stop = int(other[0]) if len(other) else rows.shape[1]
                more, rows = rows[:, :stop], rows[:, stop:]
                if stop:
                    n += int(np.count_nonzero(np.diff(more[2], prepend=last)))
                    last = int(more[2, -1])
                    yield batch_of(_DROPPED, more[:, more[2] != largest])
                    if common == first_key and (more[2] == largest).any():
                        yield batch_of(_OPEN, more[:, more[2] == largest])
                if not rows.shape[1]:
                    continue
                if common == first_key:
                    yield sum_of(common, n, largest)
                common = None
            rows = np.concatenate([waiting, rows], axis=1)
            if first_key is None:
                first_key = (int(rows[0, 0]), int(rows[1, 0]))
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            start = np.flatnonzero(new)
            new[1:] |= rows[2, 1:] != rows[2, :-1]
            docs = np.add.reduceat(new.astype(np.int64), start)
            size = np.diff(start, append=rows.shape[1])
            later = rows[2] != np.repeat(rows[2, start], size)
            drop = later & np.repeat(docs >= min_docs, size)
            if (int(rows[0, 0]), int(rows[1, 0])) == first_key:
                stop = int(size[0])
                still = ~drop[:stop]
                if len(start) > 1:
                    yield sum_of(first_key, int(docs[0]), int(rows[2, 0]))
                if len(start) > 1 or docs[0] >= min_docs:
                    yield batch_of(_OPEN, rows[:, :stop][:, still])
            yield batch_of(_DROPPED, rows[:, drop])
            at = int(start[-1])
            if docs[-1] >= min_docs:
                common, n, largest, last = (int(rows[0, -1]), int(rows[1, -1])), int(docs[-1]), int(rows[2, at]), int(rows[2, -1])
                waiting = np.empty((5, 0), np.int64)
            else:
                waiting = rows[:, at:].copy()
        if common is not None:
            yield sum_of(common, n, largest)
        elif waiting.shape[1]:
            yield sum_of((int(waiting[0, 0]), int(waiting[1, 0])), int(np.count_nonzero(np.diff(waiting[2]))) + 1, int(waiting[2, 0]))
            yield batch_of(_OPEN, waiting)

    return run


def _runs(positions: pd.Series) -> pd.DataFrame:
    """Lengths of the runs of kept and dropped lines in turn, from the dropped positions of each document."""
    out = []
    for at in positions:
        p = np.sort(np.asarray(at, np.int64))
        cut = np.flatnonzero(np.diff(p) > 1) + 1
        begin, end = p[np.concatenate([[0], cut])], p[np.concatenate([cut - 1, [len(p) - 1]])] + 1
        edge = np.stack([begin, end], axis=1).ravel()
        out.append(np.diff(edge, prepend=0).astype(np.int32))
    return pd.DataFrame({"runs": out, "n_dropped": [len(x) for x in positions]})


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, runs, n_dropped) of the documents that lose lines.

    ``runs`` holds the numbers of lines kept, dropped, kept and so on, from the
    text's start to its last dropped line; all lines after that are kept. doc
    is the id, with the least long in place of null, and th the hash of the
    text: rows that repeat an id are one document when holders are counted, and
    all of them keep the lines of the largest id, but a row for each of their
    texts is given. Null and empty texts have no line that is long enough.
    Texts of any length are read whole. Other columns are ignored. An empty
    table gives an empty result.
    """
    rows = stored(_line_rows(docs, min_chars, id_col, text_col))  # else texts are cut into lines twice, for the ranges and for the rows
    order = ["h1", "h2", F.desc("doc")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "th", "pos")
    found = stored(ranged.mapInArrow(first_occurrences(min_docs), "kind int, h1 long, h2 long, doc long, th long, pos long"))
    cut_keys = found.where(f"kind = {_SUM}").groupBy("h1", "h2").agg(F.sum("pos").alias("docs"), F.max("doc").alias("largest")).where(F.col("docs") >= min_docs)
    decided = found.where(f"kind = {_OPEN}").join(cut_keys, ["h1", "h2"]).where("doc <> largest")
    dropped = found.where(f"kind = {_DROPPED}").unionByName(decided.select(found.columns))
    by_doc = dropped.groupBy("doc", "th").agg(F.collect_set("pos").alias("positions"))
    return by_doc.select("doc", "th", made(F.col("positions"), _runs, "runs array<int>, n_dropped long").alias("made")).select("doc", "th", "made.*")


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines taken out that ``bitmaps`` (see ``keep_bitmaps``) drops, and n_lines (before) and n_dropped.

    A row for each row; null texts become empty. Columns called n_lines or
    n_dropped are replaced; other columns are kept, whatever their names.
    """
    own_id, own_hash, doc, th, runs, lost = unused(docs, "own_id", "own_hash", "doc", "th", "runs", "lost")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c.lower() not in ("n_lines", "n_dropped")]
    keyed = docs.withColumns({own_id: _id(id_col), own_hash: F.xxhash64(F.col(text_col))})
    marks = bitmaps.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("runs").alias(runs), F.col("n_dropped").alias(lost))
    both = keyed.join(marks, (F.col(own_id) == F.col(doc)) & (F.col(own_hash) == F.col(th)), "left")
    lines = lines_of(F.col(text_col))
    flags = F.flatten(F.transform(F.col(runs), lambda n, i: F.array_repeat(i % 2 == 0, n)))
    left = F.array_join(F.zip_with(lines, flags, lambda x, kept: F.when(F.coalesce(kept, F.lit(True)), x)), "\n")
    text = F.when(F.col(runs).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(left)
    return both.select(*others, text.alias(text_col), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.col(lost), F.lit(0)).cast("long").alias("n_dropped"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = with_kept_lines(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), u AS (
  SELECT rid, doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u
), c AS (
  SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS largest FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5
), m AS (
  SELECT k.*, c.key IS NOT NULL AND coalesce(doc_id, -9223372036854775808) <> largest AS lost FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
