"""An index of names by their pairs of characters, for search without a scan of all names.

A name's tokens are the pairs of neighbouring characters of the lower-cased name
with a mark at either end, numbered where a pair repeats. A name that contains a
text has all of its pairs; one that begins with it those with the first mark;
and one edit changes two pairs at most, so names within ``MOST`` edits share at
least max(length) + 1 - 2 * MOST of them. Names too short for that bound to say
anything have a token for their length as well. What the counts let pass is
verified by the search itself, so it finds the same rows as a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = "gram string, name string, size int"
#: Edits that the search allows, and the length up to which sharing no pair rules nothing out.
MOST = 3
SHORT = 2 * MOST - 1
_FIRST, _LAST = "\x01", "\x02"


def tokens(name: Column) -> Column:
    text = F.concat(F.lit(_FIRST), F.lower(name), F.lit(_LAST))
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))

    def numbered(all_: Column) -> Column:
        return F.transform(all_, lambda p, i: F.concat(p, F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda x: x == p)).cast("string")))

    short = F.when(F.length(F.lower(name)) <= SHORT, F.array(F.concat(F.lit("size"), F.length(F.lower(name)).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.get(F.transform(F.array(pairs), numbered), F.lit(0)), short)


def table(names: DataFrame) -> DataFrame:
    """(gram, name, size) of ``names(name)``."""
    return names.select(F.explode(tokens(F.col("name"))).alias("gram"), "name", F.length(F.lower("name")).alias("size"))


def _pairs(text: str) -> set[str]:
    seen: dict[str, int] = {}
    out = set()
    for i in range(len(text) - 1):
        pair = text[i : i + 2]
        seen[pair] = seen.get(pair, 0) + 1
        out.add(f"{pair}{seen[pair]}")
    return out


def usable(query: str) -> bool:
    """Whether the index can answer: a query of one character has no pair, and letters beyond ASCII fold in several ways."""
    return len(query) >= 2 and query.isascii()


def wanted(query: str) -> list[str]:
    """All tokens that a search for ``query`` asks for."""
    q = query.lower()
    sizes = {f"size{i}" for i in range(SHORT + 1)} if len(q) <= SHORT else set()
    return sorted(_pairs(q) | _pairs(_FIRST + q + _LAST) | _pairs(_FIRST + q[:4]) | sizes)


def candidates(grams: DataFrame, query: str) -> DataFrame:
    """(name) of the names that the counts of their tokens don't rule out, from the rows of ``wanted`` tokens in ``grams``."""
    q = query.lower()
    share = lambda own: F.count_if(F.col("gram").isin(*own))
    inner, whole, head = _pairs(q), _pairs(_FIRST + q + _LAST), _pairs(_FIRST + q[:4])
    rows = grams.where(F.col("gram").isin(*wanted(query)))
    counted = rows.groupBy("name").agg(F.first("size").alias("size"), share(inner).alias("inside"), share(whole).alias("alike"), share(head).alias("begins"))
    near = (F.abs(F.col("size") - len(q)) <= MOST) & (F.col("alike") >= F.greatest("size", F.lit(len(q))) + 1 - 2 * MOST)
    stems = (F.col("begins") == len(head)) if len(q) >= 4 else F.lit(False)
    return counted.where((F.col("inside") == len(inner)) | near | stems).select("name")
