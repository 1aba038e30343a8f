"""URL filters: rules by host and path, and trust propagated over host links.

Urls that a rule fits take the verdict of the longest one. For the others the
host decides. Links in the pages give host edges. Personalised PageRank carries
trust from hosts with allowed pages along the links, and distrust from hosts
with blocked pages against them (who links to blocked hosts is suspect). Trust
is shared out among the hosts that a host links to; distrust reaches a host by
the part of its own links that lead to distrusted hosts, so it doesn't thin out
where many link to one blocked host. A host starts with the share of its pages
that rules allow or block. It is blocked when its distrust exceeds its trust by
``margin``.

Scores are whole numbers (``UNIT`` is 1), so sums don't depend on their order
and reruns agree. Edges and scores are tables throughout; every step is a
partial aggregate and a join by host, checkpointed in the shared folder. Blocked
hosts are sent to all tasks if they are few, by count; else pages and hosts are
joined in ``SALTS`` parts a host, so a host with a third of all pages is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, stored

UNIT = 10**12
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules up to this many become one expression; more are joined by host suffix.
INLINE_RULES = 200
#: Blocked hosts up to this many are broadcast (10 MB or so); parts of a host's pages in the other join.
FEW_HOSTS, SALTS = 100_000, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^"'\s<>/?#]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls(host, path, ...)`` with the fitting rule (host and path, or null) and its verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    if len(ordered) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for kind, host, path in reversed(ordered):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
        return urls.withColumns({"rule": rule, "rule_verdict": verdict})
    table = urls.sparkSession.createDataFrame([(h, p, h + p, k, i) for i, (k, h, p) in enumerate(ordered)], "suffix string, start string, rule string, rule_verdict string, place int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitted = (
        urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where("startswith(path, start)")
        .groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), "place").alias("best"))
    )
    return urls.join(fitted, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("best")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of src that link to host dst; links within a host don't count."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER)))
    return (
        pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
        .where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def propagated(start: DataFrame, edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(host, kind, score): trust along the edges, distrust against them, from ``start(host, kind, score)``.

    ``start`` and the result hold no zero scores.
    """
    edges = stored(edges)
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    ways = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    back = edges.join(out, "src").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    ways = stored(ways.unionByName(back))
    own = cut(start.withColumn("score", F.floor(F.col("score") * (1 - damping)).cast("long")))
    score = own
    if ways.isEmpty():
        return score
    for _ in range(rounds):
        moved = score.join(ways, ["host", "kind"]).select(F.col("to").alias("host"), "kind", F.floor(damping * F.col("score") * F.col("share")).cast("long").alias("score"))
        score = cut(own.unionByName(moved).groupBy("host", "kind").agg(F.sum("score").alias("score")).where("score > 0"))
    return score


def judge_urls(
    pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int = 12, margin: float = 0.075,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path; no rule fits
    them, and they are allowed. Null pages have no links; pages of any length
    are searched in whole. Repeated rows are judged alike and count repeatedly
    in their host's shares. Hosts out of reach of any rule are allowed. Of equal
    rules of unlike verdict allow wins. Other columns are ignored. An empty
    table gives an empty result.
    """
    frame = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    judged = with_rules(frame.select("page_id", "host", "path"), rules)
    hosts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.sum((F.col("rule_verdict") == "allow").cast("long")).alias("trust"), F.sum((F.col("rule_verdict") == "block").cast("long")).alias("distrust")
    )
    start = hosts.select("host", "n", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "m")).where("m > 0")
    start = start.select("host", "kind", F.floor(F.lit(float(UNIT)) * F.col("m") / F.col("n")).cast("long").alias("score"))
    score = propagated(start, host_edges(frame), damping, rounds)
    signed = F.when(F.col("kind") == "trust", -F.col("score")).otherwise(F.col("score"))
    bad = stored(score.groupBy("host").agg(F.sum(signed).alias("excess")).where(F.col("excess") > int(margin * UNIT)).select("host", F.lit(True).alias("_bad")))
    if bad.count() <= FEW_HOSTS:
        found = judged.join(F.broadcast(bad), "host", "left")
    else:
        salted = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = judged.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict")
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op1_sql(rounds: int = 12) -> str:
    """The same judgement as SQL, its rounds unrolled."""
    steps = "".join(
        f""", s{i} AS MATERIALIZED (
  SELECT host, kind, CAST(sum(score) AS BIGINT) AS score FROM (
    SELECT * FROM s0 UNION ALL
    SELECT w.dst AS host, w.kind, CAST(floor(0.85 * s.score * w.share) AS BIGINT) FROM s{i - 1} s JOIN ways w ON s.host = w.host AND s.kind = w.kind
  ) GROUP BY host, kind HAVING sum(score) > 0)"""
        for i in range(1, rounds + 1)
    )
    return (
        r"""
WITH u AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(kind, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM u) x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
), j AS (
  SELECT page_id, u.host, u.path, html, rule, rule_verdict FROM u LEFT JOIN fit ON u.host = fit.host AND u.path = fit.path
), links AS (
  SELECT DISTINCT rid, host AS src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT row_number() OVER () AS rid, host, unnest(regexp_extract_all(html, '(?i)(?:href|src|action)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^"''\s<>/?#]+)', 1)) AS dst FROM u WHERE host <> '')
), edges AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND dst <> '' GROUP BY src, dst
), ways AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY src) FROM edges
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (rule_verdict = 'allow') AS t, count(*) FILTER (rule_verdict = 'block') AS d FROM j WHERE host <> '' GROUP BY host
), s0 AS MATERIALIZED (
  SELECT host, 'trust' AS kind, CAST(floor(floor(1e12 * t / n) * (1 - 0.85)) AS BIGINT) AS score FROM hosts WHERE t > 0
  UNION ALL SELECT host, 'distrust', CAST(floor(floor(1e12 * d / n) * (1 - 0.85)) AS BIGINT) FROM hosts WHERE d > 0
)"""
        + steps
        + f""", bad AS (
  SELECT host FROM s{rounds} GROUP BY host HAVING sum(CASE WHEN kind = 'trust' THEN -score ELSE score END) > 75000000000
)
SELECT page_id, j.host, path, rule, coalesce(rule_verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN bad ON j.host = bad.host
"""
    )
