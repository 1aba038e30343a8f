"""Source trees: scanning, ignore rules, stack detection."""

from __future__ import annotations

import functools
import itertools
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from stat import S_ISREG

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import cut
from ..functions.text import extension
from . import ignore

# Directories that are never scanned.
IGNORED = (
    ".git", "node_modules", "vendor", "dist", "build", "out", "target", "__pycache__", ".venv", "venv",
    "site-packages", ".m2", ".gradle", ".idea", ".vscode", "coverage", "_build", ".next", ".nuxt", ".svelte-kit",
)
# Directories that a project's index leaves out as well.
ARCHIVED = ("release", "releases", "archive", "backup", "old")
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
}
# Stack, marker files, its extensions, its own ignored directories.
STACKS = (
    ("python", ("requirements.txt", "pyproject.toml"), ("py",), ("site-packages", "htmlcov", ".pytest_cache")),
    ("frontend", ("package.json",), ("js", "jsx", "ts", "tsx", "vue", "svelte", "css", "html"), ("coverage", ".next", ".nuxt", "out")),
    ("go", ("go.mod",), ("go",), ("vendor", "bin")),
    ("rust", ("Cargo.toml",), ("rs",), ("target",)),
    ("cpp", ("CMakeLists.txt",), ("c", "h", "cpp", "hpp", "cc"), ("cmake-build-debug", "obj")),
    ("java", ("pom.xml", "build.gradle"), ("java",), (".gradle",)),
)
# Extensions that show a stack without its marker; the others of the stack don't.
SHOWN_BY = {"frontend": ("js", "jsx", "ts", "tsx", "vue", "svelte")}


FILES = "file_path string, file_size long, file_mtime long"
_FOUND = "path string, kind string, size long, mtime long, rules array<string>"
#: Entries that a task lists below one directory before it hands the directories left to other tasks.
SHARE = 5_000
#: Files of one directory whose size and time its lister reads; those of the rest are read in pages by other tasks.
PAGE = 20_000
#: Rows that a task gives at once.
_ROWS = 4_096


def _plain(root: str) -> str | None:
    """The local path that a root means, or None."""
    return root if "://" not in root and not root.startswith("file:") else re.sub("^file:(//)?", "", root) if root.startswith("file:") else None


class _Tree:
    """A source tree as a task sees it: a local folder, or what another file system holds."""

    def __init__(self, base: str):
        self.local = _plain(base)
        self.remote, self.root = (None, self.local) if self.local is not None else pafs.FileSystem.from_uri(base)

    def text(self, path: str) -> str:
        """A small file's text; nothing where it can't be read."""
        try:
            with open(f"{self.root}/{path}", "rb") if self.remote is None else self.remote.open_input_stream(f"{self.root}/{path}") as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return ""

    def entries(self, folder: str) -> Iterator[tuple[str, bool, Callable[[], tuple[int, int]]]]:
        """(name, whether a directory, how to learn size and time) of what a directory holds; links are left out."""
        try:
            if self.remote is None:
                with os.scandir(f"{self.root}/{folder}") as found:
                    for e in found:
                        if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False):
                            yield e.name, e.is_dir(follow_symlinks=False), lambda e=e: ((st := e.stat(follow_symlinks=False)).st_size, int(st.st_mtime))
            else:
                for x in self.remote.get_file_info(pafs.FileSelector(f"{self.root}/{folder}".rstrip("/"))):
                    if x.type in (pafs.FileType.File, pafs.FileType.Directory):
                        yield x.base_name, x.type == pafs.FileType.Directory, lambda x=x: (x.size, int((x.mtime_ns or 0) // 10**9))
        except OSError:  # it is gone, or closed to us
            return

    def stat(self, path: str) -> tuple[int, int] | None:
        if self.remote is not None:
            x = self.remote.get_file_info(f"{self.root}/{path}")
            return (x.size, int((x.mtime_ns or 0) // 10**9)) if x.type == pafs.FileType.File else None
        try:
            st = os.stat(f"{self.root}/{path}", follow_symlinks=False)
        except OSError:
            return None
        return (st.st_size, int(st.st_mtime)) if S_ISREG(st.st_mode) else None


def _lister(base: str, drop: frozenset[str], heed: bool, share: int, page: int):
    """Lists directories, and those below them until ``share`` entries are seen; gives files, directories left, and files whose size is still to be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, out = _Tree(base), []
        columns = [f.split()[0] for f in _FOUND.replace("array<string>", "array").split(", ")]

        def rules_of(above: list[str]) -> list[tuple]:
            return [(name, at, ignore.cached(tree.text(at + name))) for at in above for name in ignore.NAMES]

        for pdf in batches:
            for top, rules in pdf[["path", "rules"]].itertuples(index=False):
                todo, seen = [(top, list(rules))], 0
                while todo:
                    folder, above = todo.pop()
                    if seen >= share:
                        out.append((folder, "dir", None, None, above))
                    else:
                        if heed and any(tree.text(folder + name) for name in ignore.NAMES):
                            above = [*above, folder]
                        known, files = rules_of(above), 0
                        for name, is_dir, stat in tree.entries(folder):
                            seen += 1
                            path = folder + name
                            if is_dir and name in drop or known and ignore.ignored(path, is_dir, known):
                                continue
                            if is_dir:
                                todo.append((path + "/", above))
                                continue
                            files += 1
                            late = files > page and tree.remote is None
                            try:
                                out.append((path, "late" if late else "file", *((None, None) if late else stat()), None))
                            except OSError:
                                continue
                            if len(out) >= _ROWS:
                                yield pd.DataFrame(out, columns=columns).astype({"size": "Int64", "mtime": "Int64"})
                                out = []
                    if len(out) >= _ROWS:
                        yield pd.DataFrame(out, columns=columns).astype({"size": "Int64", "mtime": "Int64"})
                        out = []
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"size": "Int64", "mtime": "Int64"})

    return run


def _sizes(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = _Tree(base)
        for pdf in batches:
            found = [(p, tree.stat(p)) for p in pdf["path"]]
            yield pd.DataFrame([(p, *st) for p, st in found if st], columns=["file_path", "file_size", "file_mtime"])

    return run


def scan(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = (), ignored: tuple[str, ...] = (), scope: str = "", heed: bool = True, share: int = SHARE, page: int = PAGE
) -> DataFrame:
    """(file_path, file_size, file_mtime, extension): files below ``root``, paths relative to it.

    Tasks list directories, round by round: each takes some, goes down until it
    has seen ``share`` entries and hands the directories left to the next round,
    where they are dealt out anew. Of a directory with over ``page`` files the
    names are listed by one task and sizes read by others. The driver sees how
    many directories are left.

    Names that start with ``_`` or ``.`` are listed too, which Spark's file
    sources leave out; links aren't. Ignored directories aren't entered. Ignore
    files at any depth hold for what lies below them (``heed``), within a scope
    those above it too. What can't be read is left out.
    """
    base, drop, below = root.rstrip("/"), frozenset((*IGNORED, *ignored)), "/".join(x for x in scope.replace("\\", "/").split("/") if x not in ("", "."))
    below = f"{below}/" if below else ""
    tree, above = _Tree(base), []
    inside = not below or not drop & set(below.split("/"))
    for at in ["", *itertools.accumulate(f"{x}/" for x in below.split("/")[:-1])][:-1] if below and heed else []:
        if any(tree.text(at + name) for name in ignore.NAMES):
            above.append(at)
        here = f"{at}{below[len(at) :].split('/')[0]}"
        known = [(name, d, ignore.cached(tree.text(d + name))) for d in above for name in ignore.NAMES]
        inside = inside and not ignore.ignored(here, True, known)
    frontier, left = spark.createDataFrame([(below, above)] if inside else [], "path string, rules array<string>"), int(inside)
    parts = []
    while left:
        dealt = frontier.repartition(min(left, 4 * spark.sparkContext.defaultParallelism))
        found = cut(dealt.mapInPandas(_lister(base, drop, heed, share, page), _FOUND))
        kinds = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        parts.append(found.where("kind = 'file'").selectExpr("path AS file_path", "size AS file_size", "mtime AS file_mtime"))
        if n := kinds.get("late"):
            pages = found.where("kind = 'late'").select("path").repartition(min(-(-n // page) + 1, 4 * spark.sparkContext.defaultParallelism))
            parts.append(cut(pages.mapInPandas(_sizes(base), FILES)))
        frontier, left = found.where("kind = 'dir'").select("path", "rules"), kinds.get("dir", 0)
    out = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FILES)
    out = out.withColumn("extension", extension(F.col("file_path")))
    wanted = [e.lower().lstrip(".") for e in extensions]
    return out.where(F.lower("extension").isin(*wanted)) if wanted else out


def outside(files: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """``files(file_path)`` that lie in none of ``folders``, told by name at any depth."""
    parts = F.split("file_path", "/")
    return files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, folders)))) if folders else files


def loader(root: str) -> Callable[[str], bytes | None]:
    """Reads a file below ``root`` by its path, in a task; None for one that is gone."""
    base, opened = root.rstrip("/"), []

    def load(path: str) -> bytes | None:
        if not opened:
            opened.append(_Tree(base))
        tree = opened[0]
        try:
            with open(f"{tree.root}/{path}", "rb") if tree.remote is None else tree.remote.open_input_stream(f"{tree.root}/{path}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    return load


def contents(files: DataFrame, root: str) -> DataFrame:
    """``files(file_path, ...)`` with their content, read by the tasks; a file that is gone meanwhile is left out."""
    load = loader(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64].copy()
                yield part.assign(content=[load(x) for x in part["file_path"]])

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return files.mapInPandas(run, schema).where("content is not null")


def stats(paths: DataFrame, root: str) -> DataFrame:
    """(file_path, file_size, file_mtime, extension) of the ``paths(path)`` below ``root`` that are files now."""
    return paths.select("path").mapInPandas(_sizes(root.rstrip("/")), FILES).withColumn("extension", extension(F.col("file_path")))


def root_text(spark: SparkSession, root: str, name: str) -> str:
    """The text of a file right below ``root``, or nothing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ""
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# Endings by which a rule means a file rather than a directory.
FILE_ENDINGS = (
    "txt", "md", "json", "yml", "yaml", "toml", "lock", "log", "py", "js", "ts", "rs", "go", "java", "c", "cpp", "h", "hpp", "sql", "db",
)


def ignore_rules(text: str) -> list[str]:
    """Directory names from the text of an ignore file.

    Comments and negations go. A rule means a directory if it ends with a slash,
    or holds one and doesn't end like a file; its last part counts, as
    directories are told by name wherever they are.
    """
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule[0] in "#!" or "/" not in rule:
            continue
        is_dir = rule.endswith("/")
        name = rule.rstrip("/").rsplit("/", 1)[-1].replace("*", "")
        if name and (is_dir or not ("." in name and name.rsplit(".", 1)[-1].lower() in FILE_ENDINGS)):
            out.append(name)
    return list(dict.fromkeys(out))


# Markers that count in directories below the root too, and down to which depth.
DEEP_MARKERS = {"Cargo.toml": 6}


def detect_stack(files: DataFrame, depth: int = 8) -> tuple[list[str], list[str], list[str]]:
    """(stacks, extensions, ignored directories) from the names of ``files(file_path)``.

    Extensions count down to a depth of directories, markers in the root and
    some down to a depth of their own. What reaches the driver is the set of
    distinct extensions and markers.
    """
    markers = sorted({m for _, ms, _, _ in STACKS for m in ms})
    folders = F.size(F.split("file_path", "/")) - 1
    near = files.where(folders <= depth)
    name = F.element_at(F.split("file_path", "/"), -1)
    known = sorted({e for _, _, es, _ in STACKS for e in es})
    deep = functools.reduce(Column.__or__, [(name == m) & (folders <= n) for m, n in DEEP_MARKERS.items()])
    seen = near.select(F.when((name.isin(*markers) & (folders == 0)) | deep, name).when(extension(F.col("file_path")).isin(*known), extension(F.col("file_path"))).alias("x")).where("x is not null").distinct()
    found = {r["x"] for r in seen.collect()}
    stacks, exts, ignored = [], [], []
    for stack, marks, es, own in STACKS:
        if found & (set(marks) | set(SHOWN_BY.get(stack, es))):
            stacks.append(stack), exts.extend(es), ignored.extend(own)
    return stacks, list(dict.fromkeys(exts)), list(dict.fromkeys(ignored))


# Places in which no project is made.
SYSTEM_PLACES = ("c:\\windows", "system32", "program files", "programdata", "users\\all users")
RUNTIME_PLACES = ("vscode", "cursor", "windsurf", "pycharm", "intellij")
PRIVATE_PLACES = ("appdata", "local/programs", "local\\programs", "application data", "temp", "prefetch")


def valid_root(path: str) -> bool:
    """Whether a local directory may be a project root."""
    if not path or path == "Unknown" or not os.path.isdir(path):
        return False
    full = os.path.abspath(path)
    low = full.lower()
    if os.path.dirname(full) == full or any(x in low for x in SYSTEM_PLACES + RUNTIME_PLACES):
        return False
    return os.path.exists(os.path.join(full, ".git")) or not any(x in low for x in PRIVATE_PLACES) or low.startswith(tempfile.gettempdir().lower())
