"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources get targets in words: a share of the total by weight, capped at
``max_repeat`` times their size, the excess reshared by weight until none is
above. A source's documents fall into blocks by a hash of their id; passes over
the source take its blocks in a keyed order until the target is met, and the
block in which it is met gives just the documents that still fit.

Blocks go to output shards by a splitting tree: a node holds the exact number
of blocks of every source, and draws how many of each go left by a multivariate
hypergeometric distribution, with sizes in proportion to the shards below. At
the leaves each shard has its exact quotas; the permuted blocks of a source are
dealt out in that order, so shards get disjoint blocks. Within a shard
documents are ordered by a keyed hash.

Rows that repeat id, source and text are copies of one document. They are
counted, and taken by number: up to ``COPIES`` of them form a unit that goes to
a block as a whole, so that many copies spread over many blocks, and in the
block in which the target is met as many copies are taken as still fit.

Every draw of the tree is keyed by its node, so tasks expand their own shards
from the root without communication and reruns agree. Tables: one row per
source is all that reaches the driver. Blocks are bounded in words, so a source
with a third of all documents is many blocks; sums per block are partial
aggregates, running sums stream over the blocks of a source (a row for every
million words), and only the documents with words of a source's two last blocks
are ordered one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored, unused

WEIGHTS = (5.0, 2.0, 1.0)
#: Copies of a document that are drawn together, and those that one row unfolds into at once.
COPIES, UNFOLD = 64, 1 << 16
#: Sources up to this many are broadcast, 10 MB at most; more are joined by shuffle.
FEW_SOURCES = 50_000
#: Words of an output shard, about, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 1 << 24, 16


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, max_repeat: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``max_repeat`` times its size; the excess is reshared."""
    target = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > max_repeat * sizes[i]]
        if not over:
            for i in free:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(max_repeat * sizes[i])
            left -= target[i]
            free.remove(i)
    return target


def split_quotas(quotas: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, offsets, counts) of the shards first..last-1 from the tree with ``quotas`` blocks at its root.

    Offsets count a source's blocks in the shards to the left.
    """
    total = int(quotas.sum())

    def down(lo: int, hi: int, have: np.ndarray, before: np.ndarray):
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, before, have
            return
        mid = (lo + hi) // 2
        room = total * mid // shards - total * lo // shards
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, room, method="marginals") if have.sum() else have
        yield from down(lo, mid, left, before)
        yield from down(mid, hi, have - left, before + left)

    yield from down(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of the units of one block, in keyed order, that still fit into ``room`` words; one more if that comes nearer."""
    pdf = pdf.sort_values(["place", "doc_id", "th", "chunk"], kind="stable", na_position="first")
    room, size, held = int(pdf["room"].iloc[0]), pdf["size"].to_numpy(np.int64), pdf["held"].to_numpy(np.int64)
    take = np.zeros(len(pdf), np.int64)
    for i in range(len(pdf)):
        take[i] = min(held[i], room // size[i])
        room -= int(take[i]) * int(size[i])
    rest = np.where(take < held, size, np.iinfo(np.int64).max)
    least = int(np.argmin(rest))
    if take[least] < held[least] and int(size[least]) - room < room:
        take[least] += 1
    return pdf.assign(take=take)[["unit", "round", "take"]]


def _units(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, th, size, chunk, held, place): a row for every ``COPIES`` copies of a document; ``held`` of them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("th"))
    counted = rows.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("copies"))
    # two steps, so that no row unfolds into very many
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {UNFOLD * COPIES}")))
    first = F.col("part") * UNFOLD
    chunks = F.explode(F.sequence(first, F.least(first + UNFOLD - 1, F.expr(f"(copies - 1) div {COPIES}"))))
    held = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("chunk") * COPIES)
    units = counted.withColumn("part", part).withColumn("chunk", chunks).withColumn("held", held)
    return units.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "th", "chunk")).drop("part", "copies")


def _drawn(
    docs: DataFrame, share: float, max_repeat: int, weights, shards: int | None, block_words: int, seed: int, id_col: str, text_col: str, source_col: str
) -> tuple[DataFrame, int]:
    """Units with s, source_size, target and takes, an array of (round, take, shard); and the number of shards."""
    spark = docs.sparkSession
    rows = stored(_units(docs, seed, id_col, text_col, source_col))
    sources = sorted(
        rows.groupBy("source").agg(F.sum(F.col("size") * F.col("held")).alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass"))
    )
    sizes = [int(r["n"]) for r in sources]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), max_repeat)
    shards = shards or max(LEAST_SHARDS, -(-round(sum(target)) // SHARD_WORDS))
    schema = "source string, s int, source_size long, target double, goal long, n_blocks long"
    table = spark.createDataFrame([(r["source"], i, sizes[i], target[i], round(target[i]), max(1, -(-sizes[i] // block_words))) for i, r in enumerate(sources)], schema)
    few = F.broadcast(table) if len(sources) <= FEW_SOURCES else table
    with_source = rows.withColumnRenamed("source", "_source").join(few, F.col("_source").eqNullSafe(F.col("source")))
    placed = with_source.withColumn("block", F.pmod(F.col("place"), F.col("n_blocks")))
    # permuted blocks of each source, and the words before each
    blocks = placed.groupBy("s", "block").agg(F.sum(F.col("size") * F.col("held")).alias("words"), F.first("goal").alias("goal"), F.first("source_size").alias("source_size"))
    in_order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "s", "block"), "block")
    blocks = blocks.withColumn("start", F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.withColumns({"start": F.coalesce("start", F.lit(0)), "at": F.row_number().over(in_order) - 1, "of": F.count("*").over(Window.partitionBy("s"))})
    rounds = blocks.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))).withColumn("room", F.col("goal") - F.col("round") * F.col("source_size") - F.col("start"))
    drawn = stored(
        rounds.where("room > 0").select("s", "block", "round", "words", "room", (F.col("round") * F.col("of") + F.col("at")).alias("turn"), (F.col("words") > F.col("room")).alias("last"))
    )
    shard = drawn_shards(drawn, len(sources), shards, seed)
    # all copies of whole blocks, and those of the last block that fit
    unit = F.struct("doc_id", "th", "chunk", "s", "block")
    whole = placed.join(drawn.where("not last").select("s", "block", "round"), ["s", "block"]).select(unit.alias("unit"), "round", F.col("held").alias("take"))
    part = placed.where("size > 0").join(drawn.where("last").select("s", "block", "round", "room"), ["s", "block"])
    part = part.select(unit.alias("unit"), "doc_id", "th", "chunk", "place", "size", "held", "s", "round", "room")
    # one block a source and round
    fit = part.groupBy("s", "round").applyInPandas(_fill, "unit struct<doc_id long, th long, chunk long, s int, block long>, round int, take long").where("take > 0")
    taken = whole.unionByName(fit).select("unit.*", "round", "take").join(shard, ["s", "block", "round"])
    taken = taken.groupBy("doc_id", "th", "chunk", "s").agg(F.sort_array(F.collect_list(F.struct("round", "take", "shard"))).alias("takes"))
    a, b = placed.alias("a"), taken.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.th").eqNullSafe(F.col("b.th")) & (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.s") == F.col("b.s"))
    takes = F.coalesce("b.takes", F.array().cast("array<struct<round:int,take:bigint,shard:int>>"))
    return a.join(b, same, "left").select("a.doc_id", "a.th", "a.chunk", "a.held", "a.size", "a._source", "a.source_size", "a.target", takes.alias("takes")), shards


def mix_plan(
    docs: DataFrame, share: float = 1.5, max_repeat: int = 2, weights=WEIGHTS, shards: int | None = None, block_words: int = 1 << 20, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, shards) for every row of ``docs``.

    taken is copies times size: whole documents are taken, once per pass over
    their source, never more than ``max_repeat`` times. ``shards`` lists the
    shard of each copy; there are ``shards`` of them, or if that is not given
    as many as the words of the mix need. Null texts have size 0; documents
    without words go with their block, if that is taken whole. Very long texts
    are taken whole or not at all. A null source is a source of its own,
    ordered last. Rows with equal id, source and text are counted and taken one
    by one, so some of them may be taken and others not; a null id counts as an
    id of its own. Other columns are ignored. An empty table gives an empty
    result.
    """
    units, _ = _drawn(docs, share, max_repeat, weights, shards, block_words, seed, id_col, text_col, source_col)
    own = F.filter("takes", lambda t: t["take"] >= F.col("copy"))
    each = units.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("held")))).withColumn("own", own)
    return each.select(
        "doc_id", "size", "source_size", "target", (F.size("own") * F.col("size")).cast("long").alias("taken"), F.size("own").alias("copies"), F.transform("own", lambda t: t["shard"]).alias("shards"), "_source"
    )


def drawn_shards(drawn: DataFrame, n_sources: int, shards: int, seed: int) -> DataFrame:
    """(s, block, round, shard) for the drawn blocks: each source's blocks in turn, as the tree deals them."""
    spark = drawn.sparkSession
    turned = drawn.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("turn")) - 1)
    quota = np.zeros(n_sources, np.int64)
    for r in drawn.groupBy("s").count().collect():
        quota[r["s"]] = r["count"]
    root = spark.sparkContext.broadcast(quota)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            first, last = int(pdf["id"].min()), int(pdf["id"].max()) + 1
            for shard, offset, count in split_quotas(root.value, shards, first, last, seed):
                s = np.flatnonzero(count)
                yield pd.DataFrame({"s": s.astype(np.int32), "shard": np.int32(shard), "lo": offset[s], "hi": offset[s] + count[s]})

    dealt = spark.range(shards).mapInPandas(leaves, "s int, shard int, lo long, hi long")
    each = dealt.select("s", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("k"))
    return turned.join(each, ["s", "k"]).select("s", "block", "round", "shard")


def mixed(
    docs: DataFrame, share: float = 1.5, max_repeat: int = 2, weights=WEIGHTS, shards: int | None = None, block_words: int = 1 << 20, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each copy as often as ``mix_plan`` takes it, shard by shard.

    Of rows that repeat id, source and text one stands for all, whatever their
    other columns. Shards are ranges of the output's partitions; within a shard
    the order is that of a keyed hash. Other columns are kept, whatever their
    names. An empty table gives an empty result.
    """
    units, shards = _drawn(docs, share, max_repeat, weights, shards, block_words, seed, id_col, text_col, source_col)
    m_id, m_th, m_source, d_id, d_th, shard, place, chunk, take, copy = unused(docs, "m_id", "m_th", "m_source", "d_id", "d_th", "shard", "place", "chunk", "take", "copy")
    plan = units.withColumn("t", F.explode("takes")).select(F.col("doc_id").alias(m_id), F.col("th").alias(m_th), F.col("_source").alias(m_source), F.col("chunk").alias(chunk), F.col("t.round").alias(copy), F.col("t.take").alias(take), F.col("t.shard").alias(shard))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({d_id: F.col(id_col).cast("long"), d_th: F.xxhash64(F.col(text_col))})
    repeated = keyed.groupBy(d_id, d_th, source_col).agg(F.count("*").alias("n")).where("n > 1").select(d_id, d_th, F.col(source_col).alias(m_source))
    twice = stored(repeated)
    same = lambda x: keyed[d_id].eqNullSafe(x[d_id]) & keyed[d_th].eqNullSafe(x[d_th]) & keyed[source_col].eqNullSafe(x[m_source])
    once = keyed
    if not twice.isEmpty():
        once = keyed.join(twice, same(twice), "left_anti").unionByName(keyed.join(twice, same(twice), "left_semi").dropDuplicates([d_id, d_th, source_col]))
    found = F.col(d_id).eqNullSafe(F.col(m_id)) & F.col(d_th).eqNullSafe(F.col(m_th)) & F.col(source_col).eqNullSafe(F.col(m_source))
    out = once.join(plan, found).select(*columns, m_id, m_th, chunk, copy, shard, F.explode(F.sequence(F.lit(1).cast("long"), F.col(take))).alias(take))
    out = out.withColumn(place, F.xxhash64(F.lit(seed + 2), m_id, m_th, chunk, copy, take))
    return out.repartitionByRange(shards, shard, place).sortWithinPartitions(shard, place).select(*columns)


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
