"""N-gram Jaccard join over a count-vector R-tree.

Every text becomes its set of k-word shingles. Texts with the same set form one
class. A class is a point: its shingles are dealt into hash groups, and the
number of shingles in each group is a coordinate. The overlap of two sets is at
most the sum over the groups of the smaller coordinate, and the same sum over
the upper corners of two boxes bounds every pair of points in them, so an
R-tree over the points discards boxes and pairs before any set is compared.

A tree over all points can't be shared out: boxes of unlike texts don't prune.
Its top level is therefore a directory with an exact guarantee. A union is at
least as large as the larger set, so two sets of a similarity of percent/100
overlap in percent/100 of either at least; under any order of all shingles,
that both share, they have one in common among the first n - ceil(percent * n /
100) + 1 of each. The order puts rare shingles first, by counts over all texts
in a table of fixed size; a count that is too high through hash collisions
changes the cost, never the result. Classes with a directory key in common meet
in a bucket; of keys that the very same classes share one is enough. Those whose
bound reaches the threshold belong to one family, so links never leave a family.
Each family is indexed and joined by itself, large ones in blocks of bounded
size. Unless links are to be counted, pairs that are already connected are not
verified again: the members of a large family are first verified against a few
of them, its pivots; most of a family of copies is one component after that. Only members outside a family's
largest component meet all others in pairs of blocks, so a family costs about as
many rows as it has, and every pair that could connect two components is seen.

Signatures and shingles are 64-bit hashes; apart from collisions of these the
join is exact. Skew: each task sends the keys of a class once, however many of
its rows repeat it, so a class arrives as often as there are tasks at most;
large buckets and families are cut into blocks; everything else that is grouped
is a partial aggregate, and joins are such that Spark can split a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import connected_components, removed, shingle_set, stored, stored_at, unused

#: Hash groups of a point; its coordinates.
GROUPS = 256
#: Counters in each of the two rows of the table of counts, as a power of two; slices in which it travels; tables added up by a task.
COUNTER_BITS, SLICES, FAN_IN = 16, 32, 256
#: Rows of small buckets that share a task's group, about.
SLICE = 2000
#: Points of a tree leaf, and leaves of an inner box.
FANOUT = 16
#: Points and shingles of a block at most (a single point may exceed the latter).
BLOCK_POINTS, BLOCK_SHINGLES = 512, 1 << 21
#: Members of a large family that all others are verified against first.
PIVOTS = 24

_POINTS = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.string()), ("n", pa.int64()), ("node", pa.int64()), ("vec", pa.binary()), ("extra", pa.int64()), ("task", pa.int64()), ("slice", pa.int64()), ("counts", pa.binary())]
)


def _texts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[str | None]:
    """The texts of a batch, few of them in Python's memory at once."""
    column = batch.column("text")
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _counters(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of every shingle in either row of the table."""
    return (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), (s & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)


def directory_keys(s: np.ndarray, percent: int, counts: np.ndarray) -> np.ndarray:
    """The keys of a set: as many of its rarest shingles as the guarantee asks for; none if only an equal set can be similar."""
    n = len(s)
    if 100 * n < percent * (n + 1):
        return s[:0]
    a, b = _counters(s)
    return s[np.argsort(np.minimum(counts[0, a], counts[1, b]), kind="stable")[: n - -(-percent * n // 100) + 1]]


def _points(k: int):
    """A row for every text, and behind them the task's table of counts, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << COUNTER_BITS), np.int64)
        for batch in batches:
            n, node, vec, extra = [], [], [], []
            for text in _texts(batch):
                s = shingle_set(text, k)
                for row, at in zip(counts, _counters(s), strict=True):
                    np.add.at(row, at, 1)
                count = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                vec.append(np.minimum(count, 255).astype(np.uint8).tobytes() if len(s) else None)
                extra.append(int(np.maximum(count - 255, 0).sum()))
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), *(pa.array(x, f.type) for x, f in zip((n, node, vec, extra, none, none, none), list(_POINTS)[2:], strict=True))], schema=_POINTS
            )
        task, none = TaskContext.get().partitionId(), [None] * SLICES
        parts = [x.tobytes() for x in counts.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*[none] * 6, [task] * SLICES, range(SLICES), parts), _POINTS, strict=True)], schema=_POINTS)

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0)
    return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) // FAN_IN], "slice": [int(pdf["slice"].iloc[0])], "counts": [total.tobytes()]})


def _count_table(found: DataFrame) -> np.ndarray:
    """Counts over all texts: the tasks' tables added up, ``FAN_IN`` at a time; a table of fixed size reaches the driver."""
    tables = found.where("slice is not null").select("task", "slice", "counts")
    tasks = int(tables.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tables = tables.groupBy("slice", F.expr(f"task div {FAN_IN}")).applyInPandas(_added, "task long, slice long, counts binary")
        tasks = -(-tasks // FAN_IN)
        tables = stored(tables) if tasks > 1 else tables
    out = np.zeros((SLICES, (2 << COUNTER_BITS) // SLICES), np.int64)
    for r in tables.collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(2, -1)


def _keys(k: int, percent: int, counts):
    """(node, key) of every class that a task meets, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, keys = [], []
            for text in _texts(batch):
                s = shingle_set(text, k)
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    keys.append(directory_keys(s, percent, counts.value))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(keys).view(np.int64))], names=["node", "key"])

    return run


def _texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, text) of every text that a task meets, once."""
    seen: set[str] = set()
    for batch in batches:
        at = []
        for i, th in enumerate(batch.column("th").to_pylist()):
            if th not in seen:
                seen.add(th)
                at.append(i)
        yield batch.take(pa.array(at, pa.int64()))


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["shingles"] = [shingle_set(t, k).tobytes() for t in pdf.pop("text")]
            yield pdf

    return run


class CountTree:
    """Two-level R-tree, packed by set size and then by the leading coordinates."""

    def __init__(self, sets: list[np.ndarray]):
        self.counts = np.stack([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS) for s in sets])
        self.counts = self.counts.astype(np.uint8 if self.counts.max() < 256 else np.int32)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((*self.counts[:, :4].T, self.size))
        self.leaves = [self.order[i : i + FANOUT] for i in range(0, len(sets), FANOUT)]
        self.hi = np.stack([self.counts[x].max(0) for x in self.leaves])
        self.least = np.array([self.size[x].min() for x in self.leaves])
        self.most = np.array([self.size[x].max() for x in self.leaves])
        self.boxes = [range(i, min(i + FANOUT, len(self.leaves))) for i in range(0, len(self.leaves), FANOUT)]
        self.box_hi = np.stack([self.hi[list(b)].max(0) for b in self.boxes])
        self.box_least = np.array([self.least[list(b)].min() for b in self.boxes])
        self.box_most = np.array([self.most[list(b)].max() for b in self.boxes])


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of every row of a with every row of b."""
    return np.minimum(a[:, None, :], b[None, :, :]).sum(-1, dtype=np.int64)


def _reaches(overlap, size_a, size_b, percent: int):
    return (100 + percent) * overlap >= percent * (size_a + size_b)


def tree_pairs(a: CountTree, b: CountTree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i of a, j of b, bound) whose bound lets them reach the threshold; each pair once."""

    def fits(hi_a, hi_b, least_a, most_a, least_b, most_b):
        sizes = (100 * most_a >= percent * least_b) & (100 * most_b >= percent * least_a)
        return sizes and _reaches(_bound(hi_a[None], hi_b[None])[0, 0], least_a, least_b, percent)

    for x, box in enumerate(a.boxes):
        for y in range(x if same else 0, len(b.boxes)):
            if not fits(a.box_hi[x], b.box_hi[y], a.box_least[x], a.box_most[x], b.box_least[y], b.box_most[y]):
                continue
            for p in box:
                for q in b.boxes[y]:
                    if same and q < p:
                        continue
                    if not fits(a.hi[p], b.hi[q], a.least[p], a.most[p], b.least[q], b.most[q]):
                        continue
                    i, j = a.leaves[p], b.leaves[q]
                    bound = _bound(a.counts[i], b.counts[j])
                    keep = _reaches(bound, a.size[i][:, None], b.size[j][None, :], percent)
                    if same and p == q:
                        keep &= np.triu(np.ones(keep.shape, bool), 1)
                    r, c = np.nonzero(keep)
                    if len(r):
                        yield i[r], j[c], bound[r, c]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _block_links(percent: int, every: bool):
    """Links between two blocks of a family: a spanning forest (a, b) and, if ``every`` pair is verified, (a, null, copies of the classes linked with it)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        node, copies = pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        mine = pdf["block"].to_numpy()
        left, right = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
        tree: list[tuple[int, int]] = []
        linked = np.zeros(len(node), np.int64)
        if len(left) and len(right) and len(node) > 1:
            ta = CountTree([sets[x] for x in left])
            tb = ta if bi == bj else CountTree([sets[x] for x in right])
            up = np.arange(len(node))
            if "comp" in pdf:  # members of a component are connected already
                _, first, of = np.unique(pdf["comp"].to_numpy(np.int64), return_index=True, return_inverse=True)
                up = first[of]

            def root(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for i, j, bound in tree_pairs(ta, tb, percent, bi == bj):
                for at in np.argsort(-bound, kind="stable"):
                    x, y = left[i[at]], right[j[at]]
                    rx, ry = root(x), root(y)
                    if (every or rx != ry) and _reaches(overlap(sets[x], sets[y]), len(sets[x]), len(sets[y]), percent):
                        linked[x] += copies[y]
                        linked[y] += copies[x]
                        if rx != ry:
                            up[max(rx, ry)] = min(rx, ry)
                            tree.append((node[x], node[y]))
        has = np.flatnonzero(linked) if every else np.empty(0, np.int64)
        return pd.DataFrame({
            "a": np.concatenate([np.array([x for x, _ in tree], np.int64), node[has]]), "b": pd.array([y for _, y in tree] + [None] * len(has), "Int64"),
            "links": np.concatenate([np.zeros(len(tree), np.int64), linked[has]]),
        })

    return run


def _pivot_links(percent: int):
    """Links (root, a, b) of the members a of a block with the pivots b of their family; a pivot has one with itself."""

    def run(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
        leads = [np.frombuffer(x, np.uint64) for x in pivots["shingles"]]
        found = []
        for p, lead in zip(pivots["node"].tolist(), leads, strict=True):
            for m, own in zip(members["node"].tolist(), sets, strict=True):
                near = _reaches(min(len(own), len(lead)), len(own), len(lead), percent)
                if m == p or (near and _reaches(overlap(own, lead), len(own), len(lead), percent)):
                    found.append((m, p))
        out = pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        out.insert(0, "root", np.int64(members["root"].iloc[0]) if len(members) else np.int64(0))
        return out

    return run


def _joined_pivots(pdf: pd.DataFrame) -> pd.DataFrame:
    """(root, pivot, comp) of one family from its edges (x, y) between pivots: PIVOTS * PIVOTS at most."""
    up = {v: v for v in [*pdf["x"].tolist(), *pdf["y"].tolist()]}

    def root(v: int) -> int:
        while up[v] != v:
            v = up[v]
        return v

    for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return pd.DataFrame({"root": pdf["root"].iloc[0], "pivot": list(up), "comp": [root(v) for v in up]})


def _by_pivots(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of the large families' ``sets`` with pivots, and ``sets`` with comp, the component that those make, and whether it is its family's largest (main)."""
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node"), "node"))
    chosen = sets.select("root", "node", "n_blocks").withColumn("place", place).where(F.col("place") <= PIVOTS).select("root", "node")
    chosen = stored(sets.select("root", "node", "n_blocks", "shingles").join(chosen, ["root", "node"]))
    pivots = chosen.select("root", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "node", "shingles")
    found = sets.select("root", "block", "node", "shingles").groupBy("root", "block").cogroup(pivots.groupBy("root", "block")).applyInPandas(_pivot_links(percent), "root long, a long, b long")
    found = stored(found)
    near = found.groupBy("root", F.col("a").alias("node")).agg(F.sort_array(F.collect_set("b")).alias("ps"))  # PIVOTS at most
    steps = F.transform("ps", lambda p, i: F.struct(F.get("ps", F.greatest(i - 1, F.lit(0))).alias("x"), p.alias("y")))
    edges = near.select("root", F.inline(steps)).distinct()
    label = edges.groupBy("root").applyInPandas(_joined_pivots, "root long, pivot long, comp long")
    linked = near.select("root", "node", F.get("ps", F.lit(0)).alias("pivot")).join(label, ["root", "pivot"]).select("root", "node", "comp")
    comp = sets.select("root", "node").join(linked, ["root", "node"], "left").select("root", "node", F.coalesce("comp", "node").alias("comp"))
    main = comp.groupBy("root", "comp").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("largest"))
    state = stored(comp.join(main, "root").select("root", "node", "comp", (F.col("comp") == F.col("largest")).alias("main")))
    return found.where("a <> b").select("a", "b"), sets.join(state, ["root", "node"])


def _pairs_left(sets: DataFrame) -> DataFrame:
    """The rows of the pairs of blocks that may still connect components: members outside their family's largest one against all others.

    Those outside have blocks of their own before the others' blocks.
    """
    outside = sets.where("not main")
    counts = outside.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_POINTS), F.ceil(F.sum(F.length("shingles")) / 8 / BLOCK_SHINGLES)).cast("int").alias("u"))
    both = sets.join(counts, "root")  # families that are one component are done
    block = F.when(F.col("main"), F.col("u") + F.col("block")).otherwise(F.pmod(F.xxhash64(F.lit(1), "node"), F.col("u"))).cast("int")
    last = F.when(F.col("main"), F.col("u") - 1).otherwise(F.col("u") + F.col("n_blocks") - 1)
    own = both.withColumns({"block": block, "other": F.explode(F.sequence(F.lit(0), last))})
    return own.select("root", "node", "copies", "comp", "block", "shingles", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))


def _families(keys: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(node, root): classes connected by directory keys and bounds that reach the threshold.

    Most keys belong to one class and go with the first aggregate. Copies of a
    text differ in a few shingles, so most of their keys have the same classes;
    one key stands for all of those. Large buckets are cut into blocks, which
    meet in pairs.
    """
    spark = points.sparkSession
    keys, keys_path = stored_at(keys)
    shared = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key")
    met, met_path = stored_at(keys.join(shared, "key"))
    removed(spark, keys_path)
    h = F.xxhash64("node")
    sums = (F.sum(F.shiftright(h, 32)).alias("h1"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("h2"))
    alike = met.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("z"), *sums)
    chosen = alike.groupBy("n", "a", "z", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    kept, kept_path = stored_at(met.join(chosen, "key").distinct())
    buckets = kept.groupBy("key").agg(F.count("*").alias("n")).select("key", F.ceil(F.col("n") / BLOCK_POINTS).cast("int").alias("n_blocks"))
    slices = max(1, kept.count() // SLICE)
    part = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(slices))).otherwise(F.col("key"))
    placed = kept.join(buckets, "key").withColumns({"part": part, "block": F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")})
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "part", "key", "n_blocks", "node", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")
    )
    vectors = points.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("vec").alias("vec"), F.first("extra").alias("extra"))
    near = paired.join(vectors.hint("merge"), "node").groupBy("part", F.col("n_blocks") > 1, "bi", "bj").applyInPandas(_bucket_edges(percent), "a long, b long")
    family = connected_components(near)
    removed(spark, met_path, kept_path)
    return family


def _bucket_edges(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        node, key, mine, size, extra = (pdf[c].to_numpy(np.int64) for c in ("node", "key", "block", "n", "extra"))
        vec = np.stack([np.frombuffer(v, np.uint8) for v in pdf["vec"]])
        few, found = [], []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            bound = np.minimum(vec[i], vec[j]).sum(-1, dtype=np.int64) + np.minimum(extra[i], extra[j])
            ok = _reaches(bound, size[i], size[j], percent)
            found.append((i[ok], j[ok]))

        order = np.argsort(key, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            a = rows[mine[rows] == bi]
            b = a if bi == bj else rows[mine[rows] == bj]
            if len(a) * len(b) < 1024:
                i, j = np.triu_indices(len(a), 1) if bi == bj else np.indices((len(a), len(b))).reshape(2, -1)
                few.append((a[i], b[j]))
            else:
                for x in range(len(a)):
                    right = b[x + 1 :] if bi == bj else b
                    keep(np.full(len(right), a[x]), right)
        if few:
            i, j = (np.concatenate(v) for v in zip(*few, strict=True))
            for at in range(0, len(i), 16384):
                keep(i[at : at + 16384], j[at : at + 16384])
        up, name = {}, node.tolist()

        def root(x: int) -> int:
            while (p := up.get(x, x)) != x:
                up[x] = up.get(p, p)
                x = p
            return x

        links = []
        for i, j in found:
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                rx, ry = root(name[x]), root(name[y])
                if rx != ry:
                    up[max(rx, ry)] = min(rx, ry)
                    links.append((name[x], name[y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _joined(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, count_links: bool) -> DataFrame:
    """(doc_id, th, n_shingles, root, component_id, n_links) for every row.

    th is the digest of the text, root stands for the component (null without
    shingles), n_links is null unless counted.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent lies above 0, up to 100")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.md5(F.col(text_col)).alias("th"))
    found, path = stored_at(rows.mapInArrow(_points(k), "doc_id long, th string, n long, node long, vec binary, extra long, task long, slice long, counts binary"))
    counts = spark.sparkContext.broadcast(_count_table(found))
    points = found.where("slice is null")
    classes = points.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("copies"), F.min("th").alias("th"))
    texts = docs.select(F.col(text_col).alias("text"))
    family = _families(texts.mapInArrow(_keys(k, percent, counts), "node long, key long"), points, percent)
    sized = stored(family.join(classes.select("node", "n", "copies", "th"), "node"))
    blocks = sized.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_POINTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("n_blocks")
    )
    members = sized.join(blocks, "root").select("root", "node", "copies", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"), "th")
    own = ("root", "node", "copies", "n_blocks", "block")
    once = rows.where("th is not null").select("th", "text").mapInArrow(_texts_once, "th string, text string")
    first = once.join(members.hint("merge"), "th").groupBy("th").agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in own])
    sets = first.select(*own, "text").mapInPandas(_sets(k), "root long, node long, copies long, n_blocks int, block int, shingles binary")
    by_pairs = count_links or blocks.where("n_blocks > 1").isEmpty()
    sets = sets if by_pairs else stored(sets)
    pairs = lambda x: x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "root", "node", "copies", "block", "shingles", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")
    )
    joined = lambda x: x.groupBy("root", "bi", "bj").applyInPandas(_block_links(percent, count_links), "a long, b long, links long")
    if by_pairs:
        links = stored(joined(pairs(sets)))
    else:
        near, known = _by_pivots(sets.where("n_blocks > 1"), percent)
        links = joined(pairs(sets.where("n_blocks = 1"))).unionByName(joined(_pairs_left(known)))
        links = stored(links.unionByName(near.withColumn("links", F.lit(0).cast("long"))))
    linked = connected_components(links.where("b is not null").select("a", "b"))
    least = linked.join(classes, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    others = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    each = classes.join(linked, "node", "left").join(least, "root", "left").join(others, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1 if count_links else F.lit(None).cast("long")
    each = stored(each.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "least").alias("component_id"), n_links.alias("n_links")))
    out = stored(
        points.select("doc_id", "th", F.col("n").alias("n_shingles"), "node").join(each, "node", "left").select(
            "doc_id", "th", "n_shingles", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(F.col("node").isNull(), F.lit(0) if count_links else F.lit(None)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        )
    )
    removed(spark, path)
    return out


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; with ``count_links`` also n_links, the number of other rows it links with.

    Two rows link when the Jaccard similarity of their shingle sets is at least
    ``percent``/100, for any percent above 0; component_id is the smallest
    doc_id that links reach. Null and word-free texts have no shingles, link
    with nothing and are their own component. Repeated rows stay and share a
    component. Rows with a null id link like others; the component takes the
    smallest id that is not null. Texts of any length count in whole; one very
    long text is a block by itself. Other columns are ignored, so their names
    can't clash. An empty table gives an empty result.
    """
    out = _joined(docs, k, percent, id_col, text_col, count_links)
    return out.select("doc_id", "n_shingles", "component_id", *["n_links"] * count_links)


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, of several with this id the one whose text has the smallest digest.

    Rows are told apart by id and text, so rows of one id with unlike texts are
    judged each by its own text. Texts without words are all kept; of rows that
    repeat an id and its text one stays. Rows with a null id stay only if their
    whole group has none. Other columns are kept, whatever their names; of
    repeated rows that differ in other columns any one may stay. An empty table
    gives an empty result.
    """
    comp = _joined(docs, k, percent, id_col, text_col, False).where("n_shingles > 0")
    row_id, row_th, stay_id, stay_th = unused(docs, "row_id", "row_th", "stay_id", "stay_th")
    named = (F.col("doc_id").alias(stay_id), F.col("th").alias(stay_th))
    stays = comp.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("best")).select("best.*").select(*named)
    often = comp.groupBy("doc_id", "th").agg(F.count("*").alias("rows")).where("rows > 1").select(*named)
    keyed = docs.withColumns({row_id: F.col(id_col).cast("long"), row_th: F.md5(F.col(text_col))})
    same = F.col(row_id).eqNullSafe(F.col(stay_id)) & (F.col(row_th) == F.col(stay_th))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    wordless = docs.where(~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    kept = keyed.join(stays, same, "left_semi")
    if not often.isEmpty():
        kept = kept.join(often, same, "left_anti").unionByName(kept.join(often, same, "left_semi").dropDuplicates([row_id, row_th]))
    return kept.select(*columns).unionByName(wordless.select(*columns))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
