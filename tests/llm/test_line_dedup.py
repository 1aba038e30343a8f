import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import line_dedup as m

SCHEMA = "doc_id long, text string, doc int, th string, runs string, n_lines string, own_id int"
LEAST = -(2**63)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


def plain(rows, min_chars, min_docs):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(LEAST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = LEAST if i is None else i
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, min_chars, min_docs, parts=3):
    docs = spark.createDataFrame([(i, t, 1, "a", "b", "c", 2) for i, t in rows], SCHEMA).repartition(parts)
    out = m.with_kept_lines(docs, m.keep_bitmaps(docs, min_chars, min_docs))
    assert sorted(out.columns) == sorted([*docs.columns, "n_dropped"])
    assert out.where("doc <> 1 or th <> 'a' or runs <> 'b' or own_id <> 2").isEmpty()
    return sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=repr)


def texts(n, seed, words):
    rng = random.Random(seed)
    ends = ["", " ", "\t", "\r", "\x0b "]
    rows = []
    for i in range(n):
        lines = [rng.choice(ends) + (w.upper() if rng.random() < 0.3 else w) + rng.choice(ends) for w in rng.choices(words, k=rng.randrange(12))]
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    return rows


def test_equals_plain_lines(spark):
    words = ["", "a", "éé", "abcd", "abcé", "xyzzy", "common line", "rare one", "\xa0abc\xa0"]
    rows = texts(150, 1, words) + [(None, None), (None, "common line\nabcd"), (7, ""), (7, "common line\nxyzzy"), (-5, "rare one"), (10**6, "common line\n" * 4000 + "xyzzy")]
    rows += rows[-2:]
    assert got(spark, rows, 4, 5) == plain(rows, 4, 5)


def test_few_holders_and_ties(spark):
    line = "x" * 40
    for holders in (4, 5):
        rows = [(i, f"{line}\nown {i}\n{line.upper()} ") for i in range(holders)]
        assert got(spark, rows, 40, 5) == plain(rows, 40, 5)
    short = [(i, "y" * 39) for i in range(9)]
    assert got(spark, short, 40, 5) == plain(short, 40, 5)


def test_empty_table(spark):
    assert got(spark, [], 40, 5) == []


def test_ranges_cut_anywhere():
    """However rows are cut into ranges and batches, the streams and their sums decide as the whole does."""
    rng = random.Random(5)
    for trial in range(300):
        rows = sorted({(rng.randrange(3), rng.randrange(2), -rng.randrange(12), rng.randrange(2), p) for p in range(rng.randrange(1, 60))})
        rows = [(a, b, -d, t, p) for a, b, d, t, p in rows]
        holders = {}
        for a, b, d, _, _ in rows:
            holders.setdefault((a, b), set()).add(d)
        want = {r for r in rows if len(holders[r[:2]]) >= 3 and r[2] != max(holders[r[:2]])}
        # a cut never divides the rows of a key and document, as these are the range's columns
        cuts = sorted({0, len(rows), *(i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3] and rng.random() < 0.25)})
        found, sums, open_ = set(), {}, set()
        for lo, hi in zip(cuts, cuts[1:]):
            at, batches = lo, []
            while at < hi:
                to = min(hi, at + rng.randrange(1, 9))
                batches.append(pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at:to]], pa.int64()) for c in range(5)], names=["h1", "h2", "doc", "th", "pos"]))
                at = to
            for out in m.first_occurrences(3)(iter(batches)):
                for kind, *r in zip(*(c.to_pylist() for c in out.columns)):
                    if kind == m._DROPPED:
                        assert tuple(r) not in found
                        found.add(tuple(r))
                    elif kind == m._OPEN:
                        assert tuple(r) not in open_
                        open_.add(tuple(r))
                    else:
                        n, top = sums.get((r[0], r[1]), (0, LEAST))
                        sums[r[0], r[1]] = (n + r[4], max(top, r[2]))
        late = {r for r in open_ if sums[r[:2]][0] >= 3 and r[2] != sums[r[:2]][1]}
        assert found | late == want and not found & late, trial


def test_tasks_hold_few_rows():
    """A line of very many documents flows through: no batch that leaves is larger than one that came."""
    def batches():
        for lo in range(100_000, 0, -1000):
            n = np.arange(lo, lo - 1000, -1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n * 0 + 1, n * 0 + 2, n, n * 0, n * 0)], names=["h1", "h2", "doc", "th", "pos"])

    out = list(m.first_occurrences(5)(batches()))
    assert max(b.num_rows for b in out) <= 1000 + 5 and sum(b.num_rows for b in out) == 100_000 + 1


def test_runs():
    made = m._runs([[0], [3], [0, 1, 5, 6, 9]])
    assert [list(x) for x in made["runs"]] == [[0, 1], [3, 1], [0, 2, 3, 2, 2, 1]] and list(made["n_dropped"]) == [1, 1, 5]


def test_hot_line_is_dealt_out(spark):
    """A line of every document goes to all ranges."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat(repeat('z', 50), '\n', id) AS text")
    rows = m._line_rows(docs, 40, "doc_id", "text").repartitionByRange(8, "h1", "h2", F.desc("doc"))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    out = m.with_kept_lines(docs, m.keep_bitmaps(docs))
    assert [r.doc_id for r in out.where("n_dropped = 0").collect()] == [3999] and re.fullmatch("z{50}\n3999", out.where("n_dropped = 0").first().text)
