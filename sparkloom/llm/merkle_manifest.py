"""A Merkle manifest of a dataset: digests built bottom up, proofs pushed top down.

Each row is a leaf. The leaves of a group (a language) ascend by id; while a
group has several nodes, every ``arity`` consecutive ones become the digest of
their digests, so each group ends in one subroot. The subroots, ordered by
group, become the root in the same way.

Places within a group come from a range partitioning by group and id: each
task numbers its sorted rows, and only a count per task and group is summed, so
a group of any share of all rows is spread over the tasks. Levels go up in
blocks of ``arity ** STRIDE`` nodes: a block is one row, its levels are worked
out within it, and its top node is a child of the block above. The blocks of
every ``STRIDE`` levels are persisted.

Proofs go down the same tables: a block inherits the proof of its top node,
each child prepends its own siblings within the block, level by level, and hands
the result to the block below by a join on its number. A table of blocks holds
``arity ** -STRIDE`` times as many rows as the one below, so only the lowest
join has the size of the leaves' blocks. The driver sees the largest number of
nodes in a group, the folders of the levels, and the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

#: Levels that a block spans: 2 ** 8 nodes are a row of 16 KB of digests.
STRIDE = 8
_PROOF = "array<struct<left:string,right:string>>"
_ABSENT = "-"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as the manifest writes it: UTF-8 byte count, colon, value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(_ABSENT))


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def placed(nodes: DataFrame) -> DataFrame:
    """``nodes(grp, ord, hash, ...)`` with at, the place in the group by ord and hash, and n, the group's size.

    Null groups are one group; equal rows take neighbouring places.
    """
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("ord"), F.asc("hash")]
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(ranged.withColumn("_task", F.shiftright("_row", 33)))
    parts = rows.groupBy("grp", "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_held"))
    in_order = Window.partitionBy("grp").orderBy("_task")
    before = F.sum("_held").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("grp").alias("_grp"), F.col("_task").alias("_part"), "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_held").over(Window.partitionBy("grp")).alias("n"))
    both = rows.join(parts, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_task") == F.col("_part")))
    return both.select(*[c for c in nodes.columns], (F.col("_row") - F.col("_first") + F.col("_before")).alias("at"), "n")


@dataclass
class Tree:
    """Persisted blocks, lowest first, and (grp, ord, hash) of every group's subroot."""

    levels: list[DataFrame]
    tops: DataFrame
    arity: int


def _levels_within(blocks: DataFrame, arity: int) -> DataFrame:
    """``blocks(grp, at, n, kids)`` with the digests of each level of the block in l0, l1, ... and its height.

    A group of one block ends with its subroot; the blocks of a larger one all go up ``STRIDE`` levels.
    """
    one_block = F.col("n") <= arity**STRIDE
    own = F.lit(0)
    for i in range(STRIDE):
        own = F.when(F.col("n") > arity**i, i + 1).otherwise(own)
    out = blocks.withColumns({"height": F.when(one_block, own).otherwise(STRIDE), "l0": F.transform("kids", lambda k: k["hash"])})
    for i in range(STRIDE):
        out = out.withColumn(f"l{i + 1}", F.when(F.col("height") > i, _run_digests(f"l{i}", arity)).otherwise(F.col(f"l{i}")))
    return out


def _run_digests(level: str, arity: int) -> Column:
    runs = F.sequence(F.lit(0), F.expr(f"(size({level}) - 1) div {arity}").cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(F.col(level), r * arity + 1, F.lit(arity)), "")))


def build(nodes: DataFrame, arity: int = 2) -> Tree:
    """The tree over ``nodes(grp, at, n, ord, hash)``; ``at`` counts from 0 within a group of n. Other columns go with the leaves."""
    if arity < 2:
        raise ValueError("a run needs two nodes at least")
    wide, levels = arity**STRIDE, []
    extra = [c for c in nodes.columns if c not in ("grp", "n")]
    while True:
        kids = F.sort_array(F.collect_list(F.struct("at", *[c for c in extra if c != "at"])))
        blocks = nodes.groupBy("grp", F.expr(f"at div {wide}").alias("block")).agg(F.first("n").alias("n"), kids.alias("kids"))
        level = stored(blocks.withColumnRenamed("block", "at"))
        levels.append(level)
        tops = _levels_within(level, arity).select("grp", "at", F.expr(f"(n + {wide - 1}) div {wide}").alias("n"), F.element_at(f"l{STRIDE}", 1).alias("hash"))
        if (level.agg(F.max("n")).first()[0] or 0) <= wide:
            return Tree(levels, stored(tops.select(F.col("grp").alias("ord"), "hash")), arity)
        nodes, extra = tops, ["at", "hash"]


def _own_siblings(arity: int) -> Column:
    """The siblings of the child ``_kid`` (numbered within its block) on each level of the block."""
    steps = []
    for i in range(STRIDE):
        here = F.expr(f"cast(_kid div {arity**i} as int)")
        first = here - here % arity
        left = F.array_join(F.slice(f"l{i}", first + 1, here % arity), "")
        right = F.array_join(F.slice(f"l{i}", here + 2, arity - 1 - here % arity), "")
        steps.append(F.when(F.col("height") > i, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def push_proofs(tree: Tree, inherited: DataFrame) -> DataFrame:
    """The leaves of ``tree`` with grp, at, their own columns, proof, subroot: from ``inherited(grp, proof, subroot)``, a row per group.

    A proof lists, from the leaf up, what stands left and right of the node in its run.
    """
    down = inherited.select(F.col("grp").alias("_grp"), F.lit(0).cast("long").alias("_at"), "proof", "subroot")
    for i, level in reversed(list(enumerate(tree.levels))):
        blocks = _levels_within(level, tree.arity)
        both = blocks.join(down, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("at") == F.col("_at")))
        each = both.select("*", F.posexplode("kids").alias("_kid", "_child"))
        proof = F.concat(_own_siblings(tree.arity), F.col("proof")).cast(_PROOF)
        if i:
            down = stored(each.select(F.col("grp").alias("_grp"), F.col("_child.at").alias("_at"), proof.alias("proof"), "subroot"))
        else:
            down = each.select("grp", "_child.*", proof.alias("proof"), "subroot")
    return down


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(proof: Column) -> Column:
    """One digest over all siblings from the leaf up to the root, left to right on each level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(leaves: DataFrame, arity: int = 2) -> DataFrame:
    """``leaves(grp, ord, hash, ...)`` with proof, subroot and root.

    grp orders the subroots (null first, then by UTF-8 bytes for strings), ord
    the leaves of a group (null first), equal ords go by hash. A single leaf is
    its group's subroot, a single subroot the root; their proofs have no steps
    on those levels. Rows that repeat are leaves of their own. An empty table
    gives an empty result. Names that start with ``_`` and at, n, proof, subroot
    and root are taken.
    """
    below = build(placed(leaves), arity)
    groups = below.tops.select(F.lit(0).alias("grp"), "ord", "hash")
    above = build(placed(groups), arity)
    root = above.tops.first()
    top = F.lit(root["hash"] if root else None).cast("string")
    steps = F.array().cast(_PROOF)
    over_groups = push_proofs(above, above.tops.select(F.col("ord").alias("grp"), steps.alias("proof"), F.col("hash").alias("subroot")))
    inherited = over_groups.select(F.col("ord").alias("grp"), "proof", F.col("hash").alias("subroot"))
    return push_proofs(below, stored(inherited)).withColumn("root", top)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def documents_manifest(docs: DataFrame, arity: int = 2, tampered=None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) for every row of ``docs``, by language.

    ``tampered`` maps column names to columns that stand for what a reader finds
    instead; the leaf is then computed from these, folded with the original
    siblings, and verified says whether the root is met. Null values in any
    column and empty and long texts have leaves of their own. Rows without id
    come first in their language; repeated rows are leaves side by side. Other
    columns are ignored.
    """
    found = {c: F.col(c) for c in FIELDS} | (tampered or {})
    leaves = docs.select(
        F.col("lang").cast("string").alias("grp"), F.col("doc_id").alias("ord"), leaf_digest(*[F.col(c) for c in FIELDS]).alias("hash"),
        F.when(F.lit(bool(tampered)), leaf_digest(*[found[c] for c in FIELDS])).alias("found"),
    )
    out = manifest(stored(leaves), arity)
    folded = fold(F.coalesce("found", "hash"), F.col("proof"))
    return out.select(F.col("ord").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "proof", folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seventh = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(seventh, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    out = documents_manifest(docs, tampered={"n_chars": more})
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda b: list_prepend(b, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    ) AS crc
  FROM documents
), leaves AS (
  SELECT rid, doc_id, lang, sha256(head || chars || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || chars || tail) END AS found
  FROM fields
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), low AS (
  SELECT lang, 0 AS l, i, n, leaf AS h FROM ranked
  UNION ALL
  SELECT lang, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, l, i // 2, n
), subroots AS (
  SELECT lang, h AS subroot, l AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS l, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 2, n
), steps AS (
  SELECT r.rid, a.l, CASE WHEN (r.i >> a.l) % 2 = 1 THEN b.h ELSE '' END AS lft, CASE WHEN (r.i >> a.l) % 2 = 0 THEN coalesce(b.h, '') ELSE '' END AS rgt
  FROM ranked r JOIN (SELECT DISTINCT lang, l FROM low WHERE n > 1) a ON r.lang IS NOT DISTINCT FROM a.lang
  LEFT JOIN low b ON b.lang IS NOT DISTINCT FROM r.lang AND b.l = a.l AND b.i = xor(r.i >> a.l, 1)
  UNION ALL
  SELECT r.rid, s.height + a.l, CASE WHEN (s.i >> a.l) % 2 = 1 THEN b.h ELSE '' END, CASE WHEN (s.i >> a.l) % 2 = 0 THEN coalesce(b.h, '') ELSE '' END
  FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT l FROM high WHERE n > 1) a ON true
  LEFT JOIN high b ON b.l = a.l AND b.i = xor(s.i >> a.l, 1)
), folded AS (
  SELECT rid, 0 AS l, found AS h FROM ranked
  UNION ALL
  SELECT f.rid, f.l + 1, sha256(s.lft || f.h || s.rgt) FROM folded f JOIN steps s ON s.rid = f.rid AND s.l = f.l
), ends AS (
  SELECT rid, arg_max(h, l) AS h FROM folded GROUP BY rid
), proofs AS (
  SELECT rid, sha256(string_agg(lft || rgt, '' ORDER BY l)) AS p FROM steps GROUP BY rid
), root AS (
  SELECT h FROM high WHERE n = 1
)
SELECT r.doc_id, r.leaf, s.subroot, root.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON e.rid = r.rid LEFT JOIN proofs p ON p.rid = r.rid, root
"""
