"""Archives, human-readable logs, catalogs with front matter, persona libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_time
from ..schemas import ARCHIVE

_LOG = r"^- \[(.*)\] \*\*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\*\*: (\S+) \((.*?)\) (.*)$"


def read_archive(spark: SparkSession, path: str, now=None) -> DataFrame:
    """Memos of a JSON-lines archive; blank and malformed lines are skipped, unreadable times become now."""
    rows = spark.read.schema(ARCHIVE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and (content is not null or entity is not null)").drop("_bad").withColumn("timestamp", parsed_time(F.col("timestamp"), now))


def append_archive(memos: DataFrame, path: str) -> None:
    memos.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX")).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Memos of a log whose lines read ``- [content] **time**: category (entity) act``."""
    raw = spark.read.text(path).where(F.col("value").rlike(_LOG))
    part = [F.regexp_extract("value", _LOG, i) for i in range(1, 6)]
    return raw.select(part[2].alias("category"), part[3].alias("entity"), part[4].alias("act"), part[0].alias("content"), parsed_time(part[1]).alias("timestamp"))


def recovered(memos: DataFrame, archive: DataFrame, log: DataFrame) -> DataFrame:
    """The first of memos, archive and log that has any rows."""
    columns = ["category", "entity", "act", "content", "timestamp"]
    for source in (memos, archive, log):
        if not source.isEmpty():
            return source.select(*columns)
    return memos.select(*columns)


def read_catalog(spark: SparkSession, root: str, level: int = 0) -> DataFrame:
    """(name, description, path, level) of the markdown entries below ``root``.

    Name and description come from the front matter; without a description the
    first paragraph serves, cut at 100 characters.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("value"), F.input_file_name().alias("path"))
    front = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    body = F.trim(F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*\n", ""))

    def field(name: str):
        return F.trim(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{name}:\s*(.*)$", 1), "^[\"']|[\"']$", ""))

    folder = F.element_at(F.split("path", "/"), -2)
    first = F.filter(F.split(body, r"\n\s*\n"), lambda p: (F.trim(p) != "") & ~F.trim(p).startswith("#"))
    opening = F.regexp_replace(F.coalesce(F.get(first, F.lit(0)), F.lit("")), r"^\s+|\s+$", "")
    text = F.when(field("description") != "", field("description")).otherwise(F.substring(opening, 1, 100))
    return raw.select(F.when(field("name") != "", field("name")).otherwise(folder).alias("name"), text.alias("description"), "path", F.lit(level).alias("level"))


def valid_entries(catalog: DataFrame) -> DataFrame:
    """Catalog entries with the first rule they break, or null."""
    name = F.col("name")
    problem = (
        F.when(name == "", "name missing").when(~name.rlike("^[a-z0-9-]+$"), "name not hyphenated").when(name.startswith("-") | name.endswith("-") | name.contains("--"), "hyphens misplaced")
        .when(F.length(name) > 64, "name too long").when(F.col("description") == "", "description missing").when(F.col("description").rlike("[<>]"), "description holds brackets")
    )
    return catalog.withColumn("problem", problem)


def resources(spark: SparkSession, root: str) -> DataFrame:
    """(entry, kind, files): what lies in the references, scripts and assets of each entry."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    part = F.regexp_extract_all("path", F.lit(r"([^/]+)/(references|scripts|assets)/(.+)$"), 0)
    rows = raw.where(F.size(part) > 0).select(
        F.regexp_extract("path", r"([^/]+)/(?:references|scripts|assets)/", 1).alias("entry"), F.regexp_extract("path", r"/(references|scripts|assets)/", 1).alias("kind"),
        F.regexp_extract("path", r"/(?:references|scripts|assets)/(.+)$", 1).alias("file"),
    )
    return rows.groupBy("entry", "kind").agg(F.sort_array(F.collect_list("file")).alias("files"))


PERSONA = (
    "name string, display_name string, avatar string, hard_directive string, style_must array<string>, style_signature array<string>, style_taboo array<string>, "
    "aliases array<string>, triggers array<string>"
)


def read_personas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The personas of all libraries, of equal names the earlier one's; a library that isn't there or can't be read is left out."""
    from ..operators.ingest import overlay

    item = "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in PERSONA.split(", ")) + ">>"
    out = spark.createDataFrame([], PERSONA)
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = spark.read.text(p, wholetext=True).select(F.explode(F.from_json("value", f"personas {item}")["personas"]).alias("p")).select("p.*")
            out = overlay(out, rows.where("name is not null"), "name")
    return out


def persona(library: DataFrame, key: str) -> DataFrame:
    """The persona that a name, a display name or an alias means, case and outer blanks aside; one at most, by name."""
    same = lambda c: F.lower(F.trim(c)) == key.strip().lower()
    hit = same(F.col("name")) | same(F.col("display_name")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), same)
    return library.where(hit).orderBy("name").limit(1) if key.strip() else library.where("false")


def listed(catalog: DataFrame, most: int | None = None) -> DataFrame:
    """A catalog in the order of its names."""
    rows = catalog.orderBy("name")
    return rows.limit(most) if most else rows


def read_resource(spark: SparkSession, folder: str, resource: str) -> dict:
    """A file of an entry by its path, or else by its name among references, scripts and assets; paths that lead out are refused."""
    if resource.startswith("/") or ".." in resource.split("/") or "://" in resource:
        return {"error": "outside of the entry"}
    jvm = spark.sparkContext._jvm
    name = resource.rsplit("/", 1)[-1]
    for part in (resource, *[f"{kind}/{name}" for kind in ("references", "scripts", "assets")]):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isFile():
            stream = fs.open(path)
            try:
                return {"resource": part, "text": jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")}
            finally:
                stream.close()
    return {"error": "no such resource"}
