import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle_manifest as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at int, proof string, grp int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = r[4] if r[4] is None else r[4] + more
    return H(*map(field, (r[0], r[3], r[2], n, r[1])))


def tree(nodes, arity):
    """(root, proof of every node), a proof being [(left, right), ...]."""
    proofs, spans, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, over = [], []
        for i in range(0, len(level), arity):
            run = level[i : i + arity]
            for j in range(len(run)):
                for k in spans[i + j]:
                    proofs[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            over.append([k for s in spans[i : i + arity] for k in s])
        level, spans = up, over
    return level[0], proofs


def plain(rows, arity=2):
    """Rows of the whole result, by the definition."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs, low = [], {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, proofs = tree([leaf(r) for r in own], arity)
        subs.append(top)
        low[lang] = (own, proofs)
    root, high = tree(subs, arity)
    out = []
    for i, lang in enumerate(langs):
        for r, p in zip(*low[lang], strict=True):
            steps = p + high[i]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, int(bad))
            for left, right in steps:
                node = H(left, node, right)
            out.append((r[0], leaf(r), subs[i], root, H(*[a + b for a, b in steps]), node, node == root))
    return sorted(out, key=repr)


def got(spark, rows, arity=2):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = m.documents_manifest(docs, arity, {"n_chars": more})
    out = out.select("doc_id", "leaf", "subroot", "root", m.proof_digest(F.col("proof")), "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def rows_of(n, seed, langs=("en", "de", None, "é", "")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "ü" * rng.randrange(5), "word " * rng.randrange(2000)])
        rows.append((i * 3 if rng.random() < 0.95 else None, text, rng.choices(langs, [9, 3, 1, 1, 1][: len(langs)])[0], rng.choice([None, "s", "é"]), rng.choice([None, i])))
    return rows + rows[:4] + [(5, "other", "en", None, 1), (5, "text", "en", None, 1)]


def test_equals_plain_tree(spark, monkeypatch):
    """Blocks of 4 nodes, so that groups have several tables of blocks; null and repeated ids, null and long texts."""
    monkeypatch.setattr(m, "STRIDE", 2)
    rows = rows_of(90, 1)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("arity", [2, 3])
def test_sizes(spark, monkeypatch, arity):
    monkeypatch.setattr(m, "STRIDE", 1)
    for sizes in ([1], [2, 1], [5, 4, 1], [arity**2, arity**2 + 1, 1, 1]):
        rows = [(100 * g + i, f"t{i}", f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
        assert got(spark, rows, arity) == plain(rows, arity)


def test_default_stride(spark):
    rows = rows_of(700, 2, ("en", "de"))
    assert got(spark, rows) == plain(rows)


def test_every_tampering_shows(spark):
    rows = rows_of(60, 3)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    changed = m.documents_manifest(docs, tampered={"text": F.concat(F.coalesce("text", F.lit("")), F.lit("!"))})
    assert changed.where("verified").isEmpty() and m.documents_manifest(docs).where("not verified").isEmpty()


def test_empty_table(spark):
    assert got(spark, []) == []


def test_no_group_is_one_task(spark):
    """Places of a single group are numbered by many tasks."""
    nodes = spark.range(2000).selectExpr("'a' AS grp", "id AS ord", "cast(id AS string) AS hash").repartition(3)
    out = m.placed(nodes)
    assert [(r["ord"], r["n"]) for r in out.orderBy("at").collect()] == [(i, 2000) for i in range(2000)]
    assert out.select("at").distinct().count() == 2000
