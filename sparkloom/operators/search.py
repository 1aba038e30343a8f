"""Symbol search in tiers, scope and type filters, line owners, and text search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import like, slashes

# Type classes of the filter; each covers its related types.
TYPE_CLASSES = {"function": ("function", "method"), "class": ("class", "struct", "interface")}
#: Score of a tier, and its name.
TIERS = ((0, "exact", 1.0), (1, "prefix_suffix", 0.9), (2, "substring", 0.8), (3, "levenshtein", None), (4, "stem", 0.5))
#: Lines per bucket of the interval join.
BUCKET_LINES = 64


def exact(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.where(F.col("name") == query)


def prefix_suffix(symbols: DataFrame, query: str, compat: bool = False) -> DataFrame:
    name = F.col("name")
    return symbols.where(like(name, query, head="", compat=compat) | like(name, query, tail="", compat=compat))


def substring(symbols: DataFrame, query: str, compat: bool = False) -> DataFrame:
    return symbols.where(like(F.col("name"), query, compat=compat))


def close(symbols: DataFrame, query: str, most: int = 3) -> DataFrame:
    """Names within an edit distance, with ``distance`` and ``score``; lengths are compared first."""
    near = symbols.where(F.abs(F.length("name") - len(query)) <= most)
    found = near.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(query.lower()), most)).where("distance >= 0")
    return found.withColumn("score", (1 - F.col("distance") / 4.0).cast("float"))


def stem(symbols: DataFrame, query: str, compat: bool = False) -> DataFrame:
    return symbols.where(like(F.col("name"), query[:4], head="", compat=compat)) if len(query) >= 4 else symbols.where("false")


def tiered(symbols: DataFrame, query: str, limit: int = 5, compat: bool = False) -> DataFrame:
    """Rows of the first tier that finds any, best first, with tier, match label and score.

    One scan: every row gets the first tier it fits, each tier keeps its best
    ``limit``, and of what is left the least tier is the answer's. The exact
    tier gives one row.
    """
    name = F.col("name")
    distance = F.when(F.abs(F.length(name) - len(query)) <= 3, F.levenshtein(F.lower(name), F.lit(query.lower()), 3))
    tier = (
        F.when(name == query, 0)
        .when(like(name, query, head="", compat=compat) | like(name, query, tail="", compat=compat), 1)
        .when(like(name, query, compat=compat), 2)
        .when(distance >= 0, 3)
    )
    if len(query) >= 4:
        tier = tier.when(like(name, query[:4], head="", compat=compat), 4)
    found = symbols.withColumns({"tier": tier, "distance": distance}).where(F.col("tier").isNotNull())
    rank = Window.partitionBy("tier").orderBy(F.when(F.col("tier") == 3, F.col("distance")).otherwise(0), "symbol_id")
    score = F.when(F.col("tier") == 3, 1 - F.col("distance") / 4.0)
    label = F.when(F.col("tier") == 3, F.concat(F.lit("levenshtein_d"), F.col("distance").cast("string")))
    for number, text, value in TIERS:
        if value is not None:
            score, label = score.when(F.col("tier") == number, value), label.when(F.col("tier") == number, text)
    few = found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= max(limit, 1))  # a plain bound, which tasks apply before they shuffle
    few = few.where((F.col("tier") > 0) | (F.col("place") == 1)).where(F.col("place") <= F.when(F.col("tier") == 0, 1).otherwise(limit))
    ranked = few.withColumn("least", F.min("tier").over(Window.partitionBy(F.lit(0)))).where("tier = least").drop("least")  # five tiers of ``limit`` rows
    return ranked.withColumns({"score": score.cast("float"), "match": label}).drop("distance")


def in_scope(rows: DataFrame, scope: str) -> DataFrame:
    return rows.where(F.col("file_path").startswith(scope)) if scope else rows


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("symbol_type").isin(*TYPE_CLASSES.get(kind, (kind,)))) if kind else rows


def owners(points: DataFrame, symbols: DataFrame, how: str = "inner") -> DataFrame:
    """``points(file_id, line, ...)`` with the smallest symbol whose lines hold the point.

    Intervals are cut into buckets of lines, so the join is an equi-join on
    file and bucket; the tightest interval wins, then the smallest id.
    """
    buckets = F.sequence(F.expr(f"line_start div {BUCKET_LINES}"), F.expr(f"line_end div {BUCKET_LINES}"))
    spans = symbols.where("line_start <= line_end").select("file_id", "symbol_id", "name", "line_start", "line_end", F.explode(buckets).alias("bucket"))
    keyed = points.withColumn("bucket", F.expr(f"line div {BUCKET_LINES}"))
    hit = keyed.select("file_id", "line", "bucket").distinct().join(spans, ["file_id", "bucket"]).where("line between line_start and line_end")
    best = hit.groupBy("file_id", "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "symbol_id", "name")).alias("o"))
    best = best.select("file_id", "line", F.col("o.symbol_id").alias("owner_id"), F.col("o.name").alias("owner"))
    return points.join(best, ["file_id", "line"], how)


def lines(texts: DataFrame) -> DataFrame:
    """(file_id, file_path, line, content) of ``texts(file_id, file_path, text)``; numbers start at 1."""
    return texts.select("file_id", "file_path", F.posexplode(F.split("text", "\n")).alias("pos", "content")).select(
        "file_id", "file_path", (F.col("pos") + 1).alias("line"), "content"
    )


def _glob(pattern: str) -> str:
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.replace("**/", "*"))
    return f"(^|/){out}$"


def grep(
    texts: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False,
    include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), per_file: int | None = None, total: int | None = None,
) -> DataFrame:
    """Matching lines. Files without a match are dropped before their lines are cut apart."""
    expr = pattern if regex else re.escape(pattern)
    expr = rf"\b(?:{expr})\b" if whole_word else expr
    expr = f"(?i){expr}" if ignore_case else expr
    path = F.col("file_path")
    for g in exclude:
        texts = texts.where(~path.rlike(_glob(g)))
    if include:
        ok = F.lit(False)
        for g in include:
            ok = ok | path.rlike(_glob(g))
        texts = texts.where(ok)
    plain = not regex and not ignore_case and not whole_word
    hit: Column = F.col("content").contains(pattern) if plain else F.col("content").rlike(expr)
    first = F.col("text").contains(pattern) if plain else F.col("text").rlike(f"(?m){expr}")
    found = lines(texts.where(first)).where(hit).withColumn("content", F.trim("content"))
    if per_file:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("line"))).where(F.col("_n") <= per_file).drop("_n")
    return found.orderBy("file_path", "line").limit(total) if total else found


def shown_matches(matches: DataFrame, files: int = 10, per_file: int = 3) -> DataFrame:
    """The first matches of the first files, by path and line."""
    paths = matches.select("file_path").distinct().orderBy("file_path").limit(files)
    near = matches.join(paths, "file_path", "left_semi")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("file_path").orderBy("line"))).where(F.col("place") <= per_file)


def under_path(rows: DataFrame, suffix: str) -> DataFrame:
    """Rows of files whose path ends with ``suffix``."""
    return rows.where(slashes(F.col("file_path")).endswith(suffix.replace("\\", "/")))


def within(rows: DataFrame, scope: str) -> DataFrame:
    """Rows of files whose path holds ``scope`` anywhere."""
    return rows.where(slashes(F.col("file_path")).contains(scope.replace("\\", "/"))) if scope.strip() else rows


def same_name(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols whose name or qualified name equals ``query``, case aside."""
    return symbols.where((F.lower("name") == query.lower()) | (F.lower("qualified_name") == query.lower()))


def anchors(symbols: DataFrame, names: list[str], scope: str = "", most: int = 10) -> DataFrame:
    """(place, query, symbol_id, name, file_path): the symbols that the first ``most`` names mean, each name once.

    A name means a symbol of exactly that name if there is one, else one that
    equals it case aside; of several that with the smallest id. Names without a
    symbol are left out.
    """
    wanted = list(dict.fromkeys(names[:most]))
    asked = symbols.sparkSession.createDataFrame([(i, q, q.lower()) for i, q in enumerate(wanted)], "place int, query string, low string")
    rows = within(symbols, scope).select("symbol_id", "name", "file_path", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("low"))
    hit = rows.join(F.broadcast(asked), "low")  # at most ``most`` rows
    best = hit.groupBy("place", "query").agg(F.min(F.struct((F.col("name") != F.col("query")).alias("other"), "symbol_id", "name", "file_path")).alias("s"))
    return best.select("place", "query", "s.symbol_id", "s.name", "s.file_path")
