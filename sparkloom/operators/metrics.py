"""Project maps, directory roll-ups, complexity buckets and naming style."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import complexity_level, directory, naming_prefix, naming_style, prefixes


def complexity_buckets(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.agg(
        F.count(F.when(s >= 50, 1)).alias("high"), F.count(F.when((s >= 20) & (s < 50), 1)).alias("medium"), F.count(F.when(s < 20, 1)).alias("low"), F.avg(s).alias("mean_score")
    )


def files_map(files: DataFrame, symbols: DataFrame, scores: DataFrame) -> DataFrame:
    """(file_path, n_symbols, n_scored, mean_score): files with their symbols' mean complexity."""
    rows = symbols.select("file_id", "symbol_id", "name").join(scores.select("name", "score"), "name", "left")
    per = rows.groupBy("file_id").agg(F.count("*").alias("n_symbols"), F.count("score").alias("n_scored"), F.avg("score").alias("mean_score"))
    return files.select("file_id", "file_path").join(per, "file_id", "left").select(
        "file_path", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "mean_score"
    )


def directories(files_map_rows: DataFrame, limit: int | None = 120) -> DataFrame:
    """(dir, n_files, n_symbols), largest first, then by name."""
    per = files_map_rows.groupBy(directory(F.col("file_path")).alias("dir")).agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"))
    return per.orderBy(F.desc("n_files"), "dir").limit(limit) if limit else per


def roll_up(files_map_rows: DataFrame) -> DataFrame:
    """(dir, depth, n_files, n_symbols, sum_score) of every directory with all below it.

    Files are summed per directory before its ancestors multiply them.
    """
    d = directory(F.col("file_path"))
    score = F.coalesce(F.col("mean_score") * F.col("n_scored"), F.lit(0.0))
    own = files_map_rows.groupBy(d.alias("own")).agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.sum(score).alias("sum_score"))
    up = own.withColumn("dir", F.explode(prefixes(F.concat("own", F.lit("/x")))))
    depth = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))
    return up.groupBy("dir").agg(F.sum("n_files").alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.sum("sum_score").alias("sum_score")).withColumn("depth", depth)


def top_per_directory(files_map_rows: DataFrame, detailed: int = 10, summary: int = 30) -> DataFrame:
    """Files ranked within their directory by mean score; the first are shown in detail, the next in summary, the rest folded."""
    d = files_map_rows.withColumn("dir", directory(F.col("file_path")))
    w = Window.partitionBy("dir").orderBy(F.coalesce("mean_score", F.lit(0.0)).desc(), "file_path")
    place = F.col("place")
    shown = F.when(place <= detailed, "detail").when(place <= summary, "summary").otherwise("folded")
    return d.withColumn("place", F.row_number().over(w)).withColumn("shown", shown)


def ranked_symbols(symbols: DataFrame, scores: DataFrame) -> DataFrame:
    """Symbols of each file, highest score first, then by line."""
    rows = symbols.join(scores.select("name", "score"), "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "line_start", "symbol_id")))


def adaptive_levels(rolled: DataFrame) -> DataFrame:
    """Directories kept at each depth: all of up to 20; of up to 40, 25, 8 and 18; beyond, 20, 6 and 12."""
    counts = rolled.groupBy("depth").agg(F.count("*").alias("n"))  # a row per depth
    place = F.row_number().over(Window.partitionBy("depth").orderBy(F.desc("sum_score"), "dir"))
    cap = F.when(F.col("n") <= 20, F.col("n"))
    for low, values in ((40, (25, 8, 18)), (None, (20, 6, 12))):
        own = F.when(F.col("depth") <= 1, values[0]).when(F.col("depth") == 2, values[1]).otherwise(values[2])
        cap = cap.when(F.col("n") <= low, own) if low else cap.otherwise(own)
    few = rolled.withColumn("place", place).where(F.col("place") <= 25)  # the largest cap, which tasks apply before they shuffle
    return few.join(counts, "depth").where(F.col("place") <= cap).select(*rolled.columns, "place")


def naming(symbols: DataFrame, sample: int | None = 1000) -> DataFrame:
    """One row: counts and shares of styles among functions (the first by id), and the dominant style."""
    rows = symbols.where(F.col("symbol_type").isin("function", "method")).select("symbol_id", "name")
    rows = rows.orderBy("symbol_id").limit(sample) if sample else rows
    s = naming_style(F.col("name"))
    c = rows.agg(F.count("*").alias("n"), F.count(F.when(s == "snake", 1)).alias("snake"), F.count(F.when(s == "camel", 1)).alias("camel"))
    share = lambda x: F.when(F.col("n") > 0, F.col(x) * 100.0 / F.col("n")).otherwise(0.0)
    style = F.when(F.col("camel") > F.col("snake"), "camelCase").when((F.col("snake") == 0) & (F.col("camel") == 0), "mixed").otherwise("snake_case")
    return c.withColumns({"snake_percent": share("snake"), "camel_percent": share("camel"), "style": style})


def common_prefixes(symbols: DataFrame, sample: int | None = 1000, most: int = 5) -> DataFrame:
    """(prefix, n): prefixes of over max(2, a twentieth) of the sampled functions, most frequent first."""
    rows = symbols.where(F.col("symbol_type").isin("function", "method")).select("symbol_id", "name")
    rows = rows.orderBy("symbol_id").limit(sample) if sample else rows
    total = rows.agg(F.floor(F.count("*") / 20).alias("twentieth"))
    per = rows.select(naming_prefix(F.col("name")).alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"))
    kept = per.join(F.broadcast(total), F.col("n") > F.greatest(F.lit(2), F.col("twentieth")))  # one row
    return kept.select("prefix", "n").orderBy(F.desc("n"), "prefix").limit(most)


def counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: n_files, n_symbols of these files."""
    own = symbols.join(files.select("file_id"), "file_id", "left_semi")
    one = files.agg(F.count("*").alias("n_files"))
    return one.join(F.broadcast(own.agg(F.count("*").alias("n_symbols"))))  # a row each


def children_by_mean(rolled: DataFrame) -> DataFrame:
    """(parent, dir, mean_score, place): the directories in each directory, highest mean complexity of their symbols first."""
    rows = rolled.where("depth > 0").select(
        F.when(F.col("depth") == 1, ".").otherwise(F.regexp_replace("dir", "/[^/]*$", "")).alias("parent"), "dir",
        F.when(F.col("n_symbols") > 0, F.col("sum_score") / F.col("n_symbols")).otherwise(0.0).alias("mean_score"),
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.round("mean_score", 6).desc(), "dir")))


# First-level directories shown, and of these those opened by two levels and by one, for trees of up to 20, of up to 40, and beyond.
TREE = ((20, (20, 20, 20)), (40, (25, 8, 18)), (None, (20, 6, 12)))
# Second-level directories of one opened by one level, of one opened by two; third-level directories.
TREE_SECOND, TREE_SECOND_OPEN, TREE_THIRD = 3, 100, 5


def adaptive_tree(rolled: DataFrame) -> DataFrame:
    """(dir, depth, place, of): the directories that a map of the tree shows, to the third level; ``of`` counts all beside it.

    Directories go by the mean complexity of their symbols within their parent.
    How many of the first level are shown and opened depends on how many there
    are; one opened by one level shows three below it, one opened by two all
    (100), each with five of its own.
    """
    depth = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))
    placed = children_by_mean(rolled).withColumn("depth", depth).where("depth <= 3").select("parent", "dir", "depth", "place")
    counts = placed.groupBy("parent").agg(F.count("*").alias("of"))
    few = placed.where(F.col("place") <= TREE_SECOND_OPEN).join(counts, "parent")  # the largest bound, which tasks apply before they shuffle
    n = F.col("of")
    rule = lambda i: F.when(n <= 20, F.lit(TREE[0][1][i])).when(n <= 40, F.lit(TREE[1][1][i])).otherwise(F.lit(TREE[2][1][i]))
    top = few.where("depth = 1").withColumns({"two": F.col("place") <= rule(1), "one": F.col("place") <= rule(2)}).where(F.col("place") <= rule(0))
    opened = top.where("one").select(F.col("dir").alias("parent"), "two")
    second = few.where("depth = 2").join(opened, "parent").where(F.col("place") <= F.when(F.col("two"), TREE_SECOND_OPEN).otherwise(TREE_SECOND))
    third = few.where("depth = 3").join(second.where("two").select(F.col("dir").alias("parent")), "parent").where(F.col("place") <= TREE_THIRD)
    columns = ("dir", "depth", "place", "of")
    return top.select(*columns).unionByName(second.select(*columns)).unionByName(third.select(*columns))


def most_complex(scores: DataFrame, most: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("score"), "name").limit(most)


def highest(scores: DataFrame, names: list[str]) -> DataFrame:
    """One row: the highest score among ``names`` (0 if none is known), its level, and those of 50 and more with their reasons."""
    own = scores.where(F.col("name").isin(names) if names else F.lit(False))
    loud = F.sort_array(F.collect_list(F.when(F.col("score") >= 50, F.concat_ws(" ", "name", F.round("score", 1).cast("string"), "reasons"))))  # as many as names at most
    top = F.coalesce(F.max("score"), F.lit(0.0))
    return own.agg(top.alias("score"), loud.alias("alerts")).withColumn("level", complexity_level(F.col("score")))
