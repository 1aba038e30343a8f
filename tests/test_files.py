import os
import random
import shutil
import subprocess

import pytest

from sparkloom.sources import files as source_files
from sparkloom.sources import ignore


def listed(spark, root, **options):
    return {r.file_path for r in source_files.scan(spark, str(root), **options).select("file_path").collect()}


def walked(root, drop=source_files.IGNORED):
    out = {}
    for folder, names, files in os.walk(root):
        names[:] = [x for x in names if x not in drop and not os.path.islink(os.path.join(folder, x))]
        for f in files:
            full = os.path.join(folder, f)
            if not os.path.islink(full):
                st = os.stat(full)
                out[os.path.relpath(full, root)] = (st.st_size, int(st.st_mtime))
    return out


def grown(root, rng, names, depth=4):
    """A random tree."""
    os.makedirs(root, exist_ok=True)
    for name in rng.sample(names, rng.randrange(2, min(7, len(names)))):
        path = os.path.join(root, name)
        if depth and rng.random() < 0.45:
            grown(path, rng, names, depth - 1)
        elif not os.path.isdir(path):
            with open(path, "w") as f:
                f.write("x" * rng.randrange(9))


def simple(pattern, parts):
    """Whether a pattern without slash at its ends matches path parts, by recursion over both."""

    def name(p, s):
        if not p:
            return not s
        if p[0] == "*":
            return any(name(p[1:], s[i:]) for i in range(len(s) + 1))
        if p[0] == "[" and "]" in p[2:]:
            end = p.index("]", 2)
            body, negated = p[1:end], p[1] in "!^"
            body = body[negated:]
            return bool(s) and (s[0] in body) != negated and name(p[end + 1 :], s[1:])
        return bool(s) and (p[0] == "?" or p[0] == s[0]) and name(p[1:], s[1:])

    def over(ps, ss):
        if not ps:
            return not ss
        if ps[0] == "**":
            return bool(ss) if len(ps) == 1 else any(over(ps[1:], ss[i:]) for i in range(len(ss) + 1))
        return bool(ss) and name(ps[0], ss[0]) and over(ps[1:], ss[1:])

    return over(pattern, parts)


def left_out(root, path, is_dir):
    """By the definition: files from the deepest to the root, lines from last to first."""
    parts = path.split("/")
    for n in range(len(parts) - 1, -1, -1):
        where = os.path.join(root, *parts[:n], ".gitignore")
        if not os.path.isfile(where):
            continue
        with open(where) as f:
            lines = f.read().split("\n")
        for line in reversed(lines):
            if not line or line[0] == "#":
                continue
            keep, line = line[0] == "!", line.lstrip("!")
            if line.endswith("/") and not is_dir:
                continue
            body = line.rstrip("/")
            pattern = body.lstrip("/").split("/")
            if "/" not in body:
                pattern = ["**", *pattern]
            if simple(pattern, parts[n:]):
                return not keep
    return False


def kept_files(root):
    out = set()

    def enter(folder):
        for name in os.listdir(os.path.join(root, folder)):
            path = f"{folder}/{name}" if folder else name
            is_dir = os.path.isdir(os.path.join(root, path))
            if (is_dir and name in source_files.IGNORED) or left_out(root, path, is_dir):
                continue
            if is_dir:
                enter(path)
            else:
                out.add(path)

    enter("")
    return out


NAMES = ["a", "b", "ab", "keep.log", "x.log", "y.log", "only-root", "deep", "a.c", "b.c", "c1", "c2", "_p", ".h"]
PATTERNS = ["*.log", "!keep.log", "/only-root", "deep/", "a/b", "**/ab", "a/**", "**/b/x.log", "a/**/c1", "c?", "[ab].c", "[!a].c", "/a/*.log", "# note", "", "!/a/x.log", "!deep/", "*", "!*.c", "!*/", "b/"]


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    """Random trees with ignore files at random depths."""
    out = []
    for seed in range(12):
        rng, root = random.Random(seed), tmp_path_factory.mktemp(f"t{seed}")
        grown(str(root), rng, NAMES)
        for folder, names, _ in list(os.walk(root)):
            if folder == str(root) or rng.random() < 0.25:
                with open(os.path.join(folder, ".gitignore"), "w") as f:
                    f.write("\n".join(rng.choices(PATTERNS, k=rng.randrange(1, 6))) + "\n")
        out.append(root)
    return out


def test_ignore_files_by_the_definition(spark, trees):
    for root in trees:
        assert listed(spark, root) == kept_files(str(root)), root


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_ignore_files_as_git_reads_them(spark, trees, tmp_path):
    for i, root in enumerate(trees):
        env = os.environ | {"GIT_DIR": str(tmp_path / f"g{i}"), "GIT_WORK_TREE": str(root), "HOME": str(tmp_path), "GIT_CONFIG_NOSYSTEM": "1"}
        subprocess.run(["git", "init", "-q"], env=env, check=True, cwd=root)
        said = subprocess.run(["git", "ls-files", "-o", "--exclude-standard", "-z"], env=env, check=True, capture_output=True, text=True, cwd=root)
        assert listed(spark, root) == {x for x in said.stdout.split("\0") if x}, root


@pytest.mark.parametrize(
    "text, path, is_dir, want",
    [
        ("a\\*b", "a*b", False, True), ("a\\*b", "axb", False, False), ("\\#x", "#x", False, True), ("\\!x", "!x", False, True), ("x  ", "x", False, True), ("x\\ ", "x ", False, True),
        ("foo/", "foo", False, False), ("foo/", "d/foo", True, True), ("a/**/b", "a/b", False, True), ("a/**/b", "a/x/y/b", False, True), ("a**b", "a/b", False, False), ("a**b", "axxb", False, True),
        ("**", "x/y", False, True), ("[", "[", False, False), ("x\\", "x", False, False), ("[[:digit:]]x", "7x", False, True), ("[]]x", "]x", False, True), ("/a", "d/a", False, False), ("é*", "d/éa", False, True),
        ("*\n!x\n", "x", False, False), ("!x\n*\n", "x", False, True), ("x\r\n", "x", False, True), ("[z-a]", "b", False, False), ("a/", "a/b", False, False),
    ],
)
def test_patterns(text, path, is_dir, want):
    assert ignore.ignored(path, is_dir, [(".gitignore", "", ignore.compiled(text))]) == want


def test_order_of_files(spark, tmp_path):
    """A deeper file has the last word, and an .ignore file before any .gitignore."""
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("*.log\n/top.txt\n")
    (tmp_path / "d/.gitignore").write_text("!keep.log\n")
    (tmp_path / "d/e/.ignore").write_text("!x.log\nkeep.log\n")
    for f in ("x.log", "keep.log", "top.txt", "d/x.log", "d/keep.log", "d/top.txt", "d/e/x.log", "d/e/keep.log"):
        (tmp_path / f).write_text("x")
    seen = {x for x in listed(spark, tmp_path) if not x.endswith("ignore")}
    assert seen == {"d/keep.log", "d/top.txt", "d/e/x.log"}
    assert {x for x in listed(spark, tmp_path, heed=False) if x.endswith(".log")} == {"x.log", "keep.log", "d/x.log", "d/keep.log", "d/e/x.log", "d/e/keep.log"}
    assert {x for x in listed(spark, tmp_path, scope="./d/e/") if x.endswith(".log")} == {"d/e/x.log"}
    (tmp_path / ".gitignore").write_text("d/\n")
    assert listed(spark, tmp_path, scope="d/e") == set()


def test_same_rows_as_a_walk(spark, tmp_path):
    """Many rounds: tasks hand on after three entries; a hot directory's sizes are read in pages."""
    rng = random.Random(3)
    grown(str(tmp_path), rng, [*NAMES, "node_modules", "old", "q", "r", "s"], 6)
    (tmp_path / "hot").mkdir()
    for i in range(150):
        (tmp_path / f"hot/f{i}.py").write_text("y" * (i % 7))
    os.symlink(tmp_path / "hot", tmp_path / "hot/loop")
    os.symlink(tmp_path / "hot/f1.py", tmp_path / "link.py")
    (tmp_path / "empty").mkdir()
    rows = source_files.scan(spark, str(tmp_path), share=3, page=20).collect()
    assert {r.file_path: (r.file_size, r.file_mtime) for r in rows} == walked(tmp_path) and len(rows) == len(walked(tmp_path))
    some = source_files.scan(spark, f"file://{tmp_path}", ("PY", ".c"), ("hot",))
    assert {r.file_path for r in some.collect()} == {x for x in walked(tmp_path, (*source_files.IGNORED, "hot")) if x.endswith(".c")}
    assert source_files.scan(spark, str(tmp_path / "nothing")).count() == 0
    assert source_files.scan(spark, str(tmp_path), scope="node_modules/x").count() == 0


def test_driver_sees_counts_only(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"d{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 7}/f{i}.py").write_text("")
    frame = type(spark.range(0))
    seen, real = [], frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(out := real(self)) or out)
    found = source_files.scan(spark, str(tmp_path), share=10)
    assert sum(map(len, seen)) <= 3 * len(seen) and len(seen) > 1 and all(set(r.asDict()) == {"kind", "n"} for x in seen for r in x)
    monkeypatch.undo()
    assert found.count() == 300


def test_outside(spark):
    df = spark.createDataFrame([("a/b/c",), ("bin/x",), ("a/bin/x",), ("bin",), ("binx/y",)], "file_path string")
    assert {r.file_path for r in source_files.outside(df, ("bin",)).collect()} == {"a/b/c", "bin", "binx/y"} and source_files.outside(df, ()).count() == 5


@pytest.mark.parametrize(
    "paths, stacks",
    [
        (["Cargo.toml"], ["rust"]), (["a/b/c/d/e/f/Cargo.toml"], ["rust"]), (["a/b/c/d/e/f/g/Cargo.toml"], []), (["go.mod"], ["go"]), (["sub/go.mod"], []), (["sub/package.json", "x.PY"], ["python"]),
        (["1/2/3/4/5/6/7/8/x.rs"], ["rust"]), (["1/2/3/4/5/6/7/8/9/x.rs"], []), (["pom.xml", "CMakeLists.txt", "a/x.vue"], ["frontend", "cpp", "java"]), (["x.css", "y.html", "readme"], []),
    ],
)
def test_markers_and_extensions(spark, paths, stacks):
    assert source_files.detect_stack(spark.createDataFrame([(p,) for p in paths], "file_path string"))[0] == stacks
