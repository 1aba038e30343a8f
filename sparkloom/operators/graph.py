"""Call linking, the call graph, bounded traversal, degrees and scores.

Edges are kept once per pair with their multiplicity ``n``; sums of it stand
for the multigraph. Traversal is breadth first, a join and an anti-join per
hop over distinct nodes, so it never enumerates walks; the nodes of a hop are
checkpointed, so no hop plans the ones before it again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import cut


def link_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` with callee_id: the namesake in the caller's file, else the smallest id, else null.

    Both candidates come from one row per name, so calls never meet all their namesakes.
    """
    caller = symbols.select(F.col("symbol_id").alias("caller_id"), F.col("file_id").alias("_file"))
    own = symbols.groupBy(F.col("name").alias("callee_name"), F.col("file_id").alias("_file")).agg(F.min("symbol_id").alias("_own"))
    anywhere = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.min("symbol_id").alias("_any"))
    return (
        calls.join(caller, "caller_id").join(own, ["callee_name", "_file"], "left").join(anywhere, "callee_name", "left")
        .withColumn("callee_id", F.coalesce("_own", "_any")).drop("_own", "_any", "_file")
    )


def expand_unresolved(linked: DataFrame, symbols: DataFrame, tile: int = 4096) -> DataFrame:
    """(src, dst, n): calls without callee meet every symbol of their name.

    Symbols of the same names form a class. Calls are summed by class before they meet symbols, so each pair is made once,
    last, and is never shuffled. Callers and symbols of a class meet in tiles of some ``tile`` of either, so no task makes all
    pairs of a common name. The size of a tile tells nothing of its pairs, so neither side is broadcast and partitions stay as many
    as Spark is set to shuffle into.
    """
    open_ = linked.where("callee_id is null").groupBy("caller_id", "callee_name").agg(F.count("*").alias("n"))
    names = symbols.where("name is not null").groupBy(F.col("symbol_id").alias("dst")).agg(F.sort_array(F.collect_list("name")).alias("_names"))
    classes = names.select("_names").distinct().select("_names", F.explode("_names").alias("callee_name"))
    callers = open_.join(classes, "callee_name").groupBy(F.col("caller_id").alias("src"), "_names").agg(F.sum("n").alias("n"))
    # count("n") keeps n, so the callers are shuffled once for their number and themselves
    rows, columns = (df.groupBy("_names").agg(F.ceil(F.count(c) / tile).alias(k)) for df, c, k in ((callers, "n", "_rows"), (names, "dst", "_columns")))
    grid = rows.join(columns, "_names")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    a = callers.join(grid, "_names").select("_names", F.pmod(F.xxhash64("src"), "_rows").alias("_row"), every("_columns").alias("_column"), "src", "n")
    b = names.join(grid, "_names").select("_names", every("_rows").alias("_row"), F.pmod(F.xxhash64("dst"), "_columns").alias("_column"), "dst")
    key, n = ["_names", "_row", "_column"], int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(n, *key).join(b.repartition(n, *key).hint("merge"), key).select("src", "dst", "n")


def build_edges(linked: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(src, dst, n). With ``symbols``, unresolved calls are expanded by name."""
    edges = linked.where("callee_id is not null").groupBy(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).agg(F.count("*").alias("n"))
    if symbols is None:
        return edges
    return edges.unionByName(expand_unresolved(linked, symbols)).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def edges_at(calls: DataFrame, symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, n): the edges that begin or end at ``roots(root)``; only calls by them or of their names are linked."""
    ids = roots.select("root").distinct()
    names = symbols.join(ids.withColumnRenamed("root", "symbol_id"), "symbol_id", "left_semi").select("name").distinct()
    by = calls.join(ids.select(F.col("root").alias("caller_id"), F.lit(True).alias("_by")), "caller_id", "left")
    near = by.join(names.select(F.col("name").alias("callee_name"), F.lit(True).alias("_of")), "callee_name", "left").where("_by or _of").drop("_by", "_of")
    edges = build_edges(link_calls(near.select(calls.columns), symbols))
    either = edges.join(ids.select(F.col("root").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("root").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    return either.where("_s or _d").select("src", "dst", "n")


def callers_of(linked: DataFrame, symbols: DataFrame, symbol_id: int, name: str) -> DataFrame:
    """Calls of a symbol: resolved to it, or unresolved with its name."""
    hit = linked.where((F.col("callee_id") == symbol_id) | (F.col("callee_id").isNull() & (F.col("callee_name") == name)))
    return hit.select("caller_id", "call_line").join(symbols.withColumnRenamed("symbol_id", "caller_id"), "caller_id")


def resolve(symbols: DataFrame, query: str) -> DataFrame:
    """One symbol: by exact name, else by a name or qualified name that contains the query."""
    hit = F.when(F.col("name") == query, 0).when(F.lower("name").contains(query.lower()) | F.lower("qualified_name").contains(query.lower()), 1)
    return symbols.withColumn("tier", hit).where("tier is not null").orderBy("tier", "symbol_id").limit(1)


def _steps(edges: DataFrame, directions: tuple[str, ...]) -> DataFrame:
    """(direction, node, next, n): where each direction goes on from a node."""
    ways = [edges.select(F.lit(d).alias("direction"), F.col(a).alias("node"), F.col(b).alias("next"), "n") for d, a, b in (("forward", "src", "dst"), ("backward", "dst", "src")) if d in directions]
    return reduce(DataFrame.unionByName, ways)


def reach(edges: DataFrame, roots: DataFrame, direction: str = "backward", depth: int = 3) -> DataFrame:
    """(root, node, hop, edge_count) for ``roots(root)``: every node within ``depth`` hops, once, at its least hop.

    edge_count is the number of calls between root and node for direct
    neighbours, null beyond. A root is listed only if it calls itself.
    ``both`` gives either direction, in one traversal, with a direction column.
    """
    directions = ("forward", "backward") if direction == "both" else (direction,)
    step = _steps(edges, directions)
    from_ = ["root", "direction"]
    start = roots.select("root", F.explode(F.array(*[F.lit(d) for d in directions])).alias("direction"), F.col("root").alias("node"))
    first = start.join(step, ["direction", "node"]).groupBy(*from_, F.col("next").alias("node")).agg(F.lit(1).alias("hop"), F.sum("n").alias("edge_count"))
    first = cut(first)
    found, frontier = [first], first.where("node <> root")
    seen = first.select(*from_, "node").unionByName(start)
    for hop in range(2, depth + 1):
        new = frontier.select(*from_, "node").join(step.select("direction", "node", "next"), ["direction", "node"]).select(*from_, F.col("next").alias("node")).distinct()
        frontier = new.join(seen, [*from_, "node"], "left_anti").select(*from_, "node", F.lit(hop).alias("hop"), F.lit(None).cast("long").alias("edge_count"))
        if hop < depth:
            frontier = cut(frontier)
        found.append(frontier)
        seen = seen.unionByName(frontier.select(*from_, "node"))
    out = reduce(DataFrame.unionByName, found)
    return out.select("root", "node", "hop", "edge_count", "direction") if direction == "both" else out.select("root", "node", "hop", "edge_count")


def degrees(linked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, fan_out, fan_in) in calls; unresolved calls count for the caller."""
    out = linked.groupBy(F.col("caller_id").alias("symbol_id")).agg(F.count("*").alias("fan_out"))
    into = linked.where("callee_id is not null").groupBy(F.col("callee_id").alias("symbol_id")).agg(F.count("*").alias("fan_in"))
    zero = {"fan_out": 0, "fan_in": 0}
    return symbols.select("symbol_id", "name").join(out, "symbol_id", "left").join(into, "symbol_id", "left").fillna(zero)


def complexity(linked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, fan_out, fan_in, score, reasons): the largest degrees among namesakes, weighed 1 and 0.5."""
    return _scored(degrees(linked, symbols).groupBy("name").agg(F.max("fan_out").alias("fan_out"), F.max("fan_in").alias("fan_in")))


def complexity_of(linked: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """``complexity`` of the names of ``wanted(symbol_id)`` alone: only calls of and to their namesakes are counted."""
    names = symbols.join(wanted.select("symbol_id").distinct(), "symbol_id", "left_semi").select("name").distinct()
    same = symbols.join(names, "name", "left_semi").select("symbol_id", "name")
    out = linked.join(same.select(F.col("symbol_id").alias("caller_id")), "caller_id", "left_semi")
    into = linked.join(same.select(F.col("symbol_id").alias("callee_id")), "callee_id", "left_semi")
    counts = out.groupBy(F.col("caller_id").alias("symbol_id")).agg(F.count("*").alias("fan_out")), into.groupBy(F.col("callee_id").alias("symbol_id")).agg(F.count("*").alias("fan_in"))
    d = same.join(counts[0], "symbol_id", "left").join(counts[1], "symbol_id", "left").fillna(0, ["fan_out", "fan_in"])
    return _scored(d.groupBy("name").agg(F.max("fan_out").alias("fan_out"), F.max("fan_in").alias("fan_in")))


def _scored(d: DataFrame) -> DataFrame:
    score = F.col("fan_out") * 1.0 + F.col("fan_in") * 0.5
    reasons = F.concat_ws("; ", F.when(F.col("fan_out") > 10, "high fan-out"), F.when(F.col("fan_in") > 20, "high fan-in"))
    return d.withColumns({"score": score.cast("double"), "reasons": reasons})


def risk(affected: Column) -> Column:
    return F.when(affected <= 3, "low").when(affected <= 10, "medium").otherwise("high")


def complexity_score(coverage: Column, fan_out: Column, fan_in: Column) -> Column:
    return F.least(F.lit(100.0), 0.5 * coverage + 2.0 * fan_out + 1.0 * fan_in)


def score_level(score: Column) -> Column:
    return F.when(score < 20, "Simple").when(score < 50, "Medium").when(score < 80, "High").otherwise("Extreme")


def impact(edges: DataFrame, roots: DataFrame, direction: str = "backward") -> DataFrame:
    """(root, direct_edges, direct_nodes, indirect_nodes, risk); risk counts calls and indirect nodes."""
    near = reach(edges, roots, direction)
    sums = near.groupBy("root").agg(
        F.sum(F.when(F.col("hop") == 1, F.col("edge_count"))).alias("direct_edges"),
        F.count(F.when(F.col("hop") == 1, 1)).alias("direct_nodes"),
        F.count(F.when(F.col("hop") > 1, 1)).alias("indirect_nodes"),
    )
    full = roots.select("root").join(sums, "root", "left").fillna(0)
    return full.withColumn("risk", risk(F.col("direct_edges") + F.col("indirect_nodes")))


def random_walks(edges: DataFrame, root: int, walks: int = 1000, steps: int = 10, go_on: float = 0.85, seed: int = 1) -> DataFrame:
    """(node, visits) of seeded walks along calls from ``root``; a walk ends by chance or at a sink.

    Out-edges of a node are laid on a line by multiplicity, and a walker's
    hash picks a place on it; every step is one join of the walkers with that.
    """
    spark = edges.sparkSession
    w = Window.partitionBy("src").orderBy("dst")
    lots = edges.withColumns({"hi": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy("src"))})
    lots = lots.select("src", "dst", (F.col("hi") - F.col("n")).alias("lo"), "hi", "all")
    at = spark.range(walks).select(F.col("id").alias("walk"), F.lit(root).cast("long").alias("node"))
    seen = at
    for step in range(steps):
        chance = F.pmod(F.xxhash64(F.lit(seed), "walk", F.lit(2 * step)), F.lit(1 << 20)) / float(1 << 20)
        pick = F.pmod(F.xxhash64(F.lit(seed), "walk", F.lit(2 * step + 1)), F.col("all"))
        live = at if step == 0 else at.where(chance <= go_on)
        at = cut(live.join(lots, F.col("node") == F.col("src")).where((pick >= F.col("lo")) & (pick < F.col("hi"))).select("walk", F.col("dst").alias("node")))
        seen = seen.unionByName(at)
    return seen.groupBy("node").agg(F.count("*").alias("visits"))


def shown(near: DataFrame, symbols: DataFrame, direct: int = 10, indirect: int = 20) -> DataFrame:
    """(root, hop, node, name, place, of): the nearest nodes that an answer lists, by hop and id; ``of`` counts all, direct or not."""
    kind = F.when(F.col("hop") == 1, "direct").otherwise("indirect")
    named = near.withColumn("kind", kind).join(symbols.select(F.col("symbol_id").alias("node"), "name"), "node")
    place = F.row_number().over(Window.partitionBy("root", "kind").orderBy("hop", "node"))
    few = named.withColumn("place", place).where(F.col("place") <= max(direct, indirect))  # a plain bound, which tasks apply before they shuffle
    ranked = few.where(F.col("place") <= F.when(F.col("kind") == "direct", direct).otherwise(indirect))
    all_ = named.groupBy("root", "kind").agg(F.count("*").alias("of"))
    return ranked.join(all_, ["root", "kind"]).select("root", "kind", "hop", "node", "name", "place", "of")


def checklist(near: DataFrame, symbols: DataFrame, files: DataFrame, direction: str = "backward") -> DataFrame:
    """(root, place, line): the target, then a line for every direct node of a traversal."""
    where = symbols.join(files.select("file_id", "file_path"), "file_id").select("symbol_id", "name", "qualified_name", "symbol_type", "file_path")
    roots = near.select("root").distinct().join(where, F.col("root") == F.col("symbol_id"))
    target = roots.select("root", F.lit(0).alias("place"), F.format_string("Target: %s (%s)", "qualified_name", "file_path").alias("line"))
    label = "Dependency" if direction == "forward" else "Caller"
    direct = near.where("hop = 1").join(where, F.col("node") == F.col("symbol_id"))
    line = F.format_string(f"Check {label}: %s:%s (%s)", "symbol_type", "name", "file_path")
    return target.unionByName(direct.select("root", F.row_number().over(Window.partitionBy("root").orderBy("node")).alias("place"), line.alias("line")))
