"""Flow tracing: edges inside and across files, scores, entries, critical paths, output budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kind, kind_priority, side_effects, stages
from .graph import complexity_of, reach

# Entries kept and candidates looked at, by mode.
MODES = {"brief": (1, 6), "standard": (2, 8), "deep": (4, 12)}


def edge_classes(edges: DataFrame, symbols: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(symbol_id, int_in, ext_in, int_out, ext_out): calls within its file and across; of ``wanted(symbol_id)`` alone, if given."""
    if wanted is not None:
        near = edges.join(wanted.select(F.col("symbol_id").alias("src")), "src", "left_semi").select("src", "dst", "n")
        edges = near.unionByName(edges.join(wanted.select(F.col("symbol_id").alias("dst")), "dst", "left_semi").select("src", "dst", "n")).distinct()
    where = symbols.select("symbol_id", "file_id")
    a = where.select(F.col("symbol_id").alias("src"), F.col("file_id").alias("fs"))
    b = where.select(F.col("symbol_id").alias("dst"), F.col("file_id").alias("fd"))
    e = edges.join(a, "src").join(b, "dst").withColumn("inside", F.col("fs") == F.col("fd"))

    def sums(key: str, side: str) -> DataFrame:
        return e.groupBy(F.col(key).alias("symbol_id")).agg(
            F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias(f"int_{side}"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias(f"ext_{side}")
        )

    base = symbols.select("symbol_id") if wanted is None else symbols.select("symbol_id").join(wanted, "symbol_id", "left_semi")
    return base.join(sums("dst", "in"), "symbol_id", "left").join(sums("src", "out"), "symbol_id", "left").fillna(0)


def flow_scores(edges: DataFrame, symbols: DataFrame, linked: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ext_in, ext_out, b_dir, b_ind, f_dir, f_ind, complexity, flow_score) of ``roots(root)``."""
    way, direct = F.col("direction"), F.col("hop") == 1
    near = reach(edges, roots, "both").groupBy("root").agg(
        F.sum(F.when((way == "backward") & direct, F.col("edge_count"))).alias("b_dir"), F.count(F.when((way == "backward") & ~direct, 1)).alias("b_ind"),
        F.sum(F.when((way == "forward") & direct, F.col("edge_count"))).alias("f_dir"), F.count(F.when((way == "forward") & ~direct, 1)).alias("f_ind"),
    )
    out = roots.select("root").join(near, "root", "left")
    wanted = roots.select(F.col("root").alias("symbol_id")).distinct()
    own = symbols.join(wanted, "symbol_id", "left_semi")
    scores = own.select("symbol_id", "name").join(complexity_of(linked, symbols, wanted).select("name", "score"), "name").select(F.col("symbol_id").alias("root"), F.col("score").alias("complexity"))
    classes = edge_classes(edges, symbols, wanted).withColumnRenamed("symbol_id", "root")
    out = out.join(classes, "root", "left").join(scores, "root", "left").fillna(0)
    value = (
        50 * F.col("ext_in") + F.col("ext_out") + 8 * F.col("b_dir") + 2 * F.col("b_ind") + 2 * F.col("f_dir") + F.col("f_ind")
        + F.least(F.col("complexity"), F.lit(40.0)) / 8.0
    )
    return out.withColumn("flow_score", value.cast("double"))


def candidates(symbols: DataFrame, mode: str = "standard") -> DataFrame:
    """Symbols in order of kind, line and name, as many as the mode looks at."""
    ranked = symbols.withColumn("priority", kind_priority(kind(F.col("symbol_type"))))
    return ranked.orderBy("priority", "line_start", "name", "symbol_id").limit(MODES[mode][1])


def entries(scored: DataFrame, symbols: DataFrame, mode: str = "standard") -> DataFrame:
    rows = scored.join(symbols.select(F.col("symbol_id").alias("root"), "line_start"), "root")
    order = (F.desc("ext_in"), F.desc("b_dir"), F.desc("b_ind"), F.desc("flow_score"), "line_start", "root")
    return rows.orderBy(*order).limit(MODES[mode][0])


def labels(symbols: DataFrame, related: DataFrame, files: DataFrame, most: int = 8) -> DataFrame:
    """(root, side_effects, stages) from the words of a symbol and of up to ``most`` neighbours each way.

    ``related(root, direction, symbol_id)`` lists the neighbours. Side effects
    are told by names, qualified names and file paths, stages by names alone.
    """
    near = related.withColumn("place", F.row_number().over(Window.partitionBy("root", "direction").orderBy("symbol_id"))).where(F.col("place") <= most)
    bag = F.concat_ws(" ", "name", "qualified_name")
    words = near.select("root", "symbol_id").unionByName(near.select("root", F.col("root").alias("symbol_id")).distinct())
    placed = words.join(symbols.select("symbol_id", "file_id", bag.alias("bag")), "symbol_id").join(files.select("file_id", "file_path"), "file_id", "left")
    joined = lambda c: F.concat_ws(" ", F.sort_array(F.collect_list(c)))
    both = placed.groupBy("root").agg(joined("bag").alias("bag"), joined(F.concat_ws(" ", "bag", "file_path")).alias("with_paths"))
    return both.select("root", F.concat_ws(",", side_effects(F.col("with_paths"))).alias("side_effects"), F.concat_ws(",", stages(F.col("bag"))).alias("stages"))


def critical_paths(edges: DataFrame, symbols: DataFrame, roots: DataFrame, limit: int = 3) -> DataFrame:
    """(root, place, path): through the first caller and callee, then callers, then callees, each path once."""
    names = symbols.select("symbol_id", "name")
    entry = roots.join(names.select(F.col("symbol_id").alias("root"), F.col("name").alias("entry")), "root")

    def side(key: str, other: str) -> DataFrame:
        e = edges.select(F.col(key).alias("root"), F.col(other).alias("symbol_id")).join(entry, "root").join(names, "symbol_id")
        once = e.groupBy("root", "entry", "name").agg(F.min("symbol_id").alias("first"))
        return once.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("first", "name"))).where(F.col("k") <= limit)

    up, down = side("dst", "src"), side("src", "dst")
    both = up.where("k = 1").select("root", "entry", F.col("name").alias("u")).join(down.where("k = 1").select("root", F.col("name").alias("d")), "root")
    arrow = F.lit(" -> ")
    paths = (
        both.select("root", F.lit(0).alias("part"), F.lit(0).alias("k"), F.concat("u", arrow, "entry", arrow, "d").alias("path"))
        .unionByName(up.select("root", F.lit(1).alias("part"), "k", F.concat("name", arrow, "entry").alias("path")))
        .unionByName(down.select("root", F.lit(2).alias("part"), "k", F.concat("entry", arrow, "name").alias("path")))
    )
    once = paths.groupBy("root", "path").agg(F.min(F.struct("part", "k")).alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("at", "path"))).where(F.col("place") <= limit).select("root", "place", "path")


def budget(max_nodes: int = 40, mode: str = "standard") -> int:
    """Rows of one list in an answer of ``max_nodes`` (1 to 120)."""
    return max(2, min(max(max_nodes, 1), 120) // (3 if mode == "deep" else 4))
