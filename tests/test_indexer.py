"""An index kept in step by changes equals one made at once, and writes and reads what changed."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.api import Engine
from sparkloom.operators import graph
from sparkloom.sources.store import Part, Store

NAMES = [f"fn{i}" for i in range(14)]


def source(rng):
    """Some functions that call others by name; names are shared by files."""
    own = rng.sample(NAMES, rng.randrange(0, 4))
    return "".join(f"def {n}():\n" + "".join(f"    {c}()\n" for c in rng.choices(NAMES, k=rng.randrange(1, 4))) + "\n" for n in own) + f"# {rng.random()}\n"


def write(path, text, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (at, at))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


SYMBOLS = ("symbol_id", "file_id", "name", "scope_path", "line_start", "line_end", "signature")
CALLS = ("call_id", "caller_id", "callee_name", "call_line", "callee_id")


def state(e):
    return rows(e.symbols(), *SYMBOLS), rows(e.calls(), *CALLS), rows(e.edges(), "src", "dst", "n"), rows(e.files(), "file_path", "file_hash", "line_count", "index_level")


def test_random_edits_equal_a_full_link(spark, tmp_path):
    rng, root = random.Random(11), tmp_path / "proj"
    paths = [str(root / f"d{i % 3}/f{i}.py") for i in range(9)]
    for p in paths:
        write(p, source(rng), 1_700_000_000)
    e = Engine(spark, str(tmp_path / "db"), buckets=8)
    e.ingest(str(root))
    for step in range(3):
        for p in rng.sample(paths, 2):
            if rng.random() < 0.3 and os.path.exists(p):
                os.remove(p)
            else:
                write(p, source(rng), 1_700_000_000 + 60 * (step + 1))
        if step % 2:
            e.ingest(str(root))
        else:  # the same by names of changed files
            e.refresh(str(root), spark.createDataFrame([(os.path.relpath(p, root),) for p in paths], "path string"))
        held = state(e)
        linked = graph.link_calls(e.calls().drop("callee_id"), e.symbols())
        assert held[1] == rows(linked, *CALLS)
        assert held[2] == rows(graph.build_edges(linked), "src", "dst", "n")
        names = rows(e.store.read("names", "name string, file_id long, symbol_id long"), "name", "file_id", "symbol_id")
        assert names == rows(e.symbols(), "name", "file_id", "symbol_id")
    fresh = Engine(spark, str(tmp_path / "db2"), buckets=8)
    fresh.ingest(str(root))
    assert state(fresh) == state(e)


TABLES = ("files", "symbols", "calls", "edges", "names", "callers", "grams")


def folders(e):
    """The folder of every bucket of every table."""
    return {p for name in TABLES for p in e.store.paths(name)}


def test_one_changed_file_writes_its_buckets(spark, tmp_path):
    rng, root = random.Random(5), tmp_path / "proj"
    for i in range(60):
        write(str(root / f"f{i}.py"), f"def own{i}():\n    own{(i + 1) % 60}()\n    print(1)\n", 1_700_000_000)
    e = Engine(spark, str(tmp_path / "db"), buckets=32)
    e.ingest(str(root))
    before = folders(e)
    files_before = set(glob.glob(str(tmp_path / "db/*/v*/bucket=*/*.parquet")))
    write(str(root / "f7.py"), "def own7():\n    print(2)\n\ndef added():\n    own3()\n", 1_700_000_100)
    e.ingest(str(root))
    new = folders(e) - before
    by_table = {name: sum(f"/{name}/" in p for p in new) for name in TABLES}
    assert by_table["files"] == by_table["symbols"] == by_table["names"] == 1 and by_table["calls"] == 1 and by_table["edges"] == 1 and by_table["callers"] <= 3 and by_table["grams"] <= 7, by_table  # a bucket a pair of the new name's characters
    written = set(glob.glob(str(tmp_path / "db/*/v*/bucket=*/*.parquet"))) - files_before
    assert len(written) == len(new) <= 15
    number = e.store._state()[0]
    e.ingest(str(root))  # nothing changed, nothing is written
    assert e.store._state()[0] == number and folders(e) - before == new
    # a name that gains a definition touches the buckets that call it, no others
    calls = set(e.store.paths("calls"))
    write(str(root / "f9.py"), "def own9():\n    own10()\n    print(1)\n\ndef own20():\n    pass\n", 1_700_000_200)
    e.ingest(str(root))
    assert 1 <= len(set(e.store.paths("calls")) - calls) <= 3
    assert rows(graph.link_calls(e.calls().drop("callee_id"), e.symbols()), *CALLS) == rows(e.calls(), *CALLS)


def test_reads_only_touched_buckets(spark, tmp_path, monkeypatch):
    root = tmp_path / "proj"
    for i in range(40):
        write(str(root / f"f{i}.py"), f"def own{i}():\n    own{(i + 1) % 40}()\n", 1_700_000_000)
    e = Engine(spark, str(tmp_path / "db"), buckets=32)
    e.ingest(str(root))
    asked, real = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, schema, buckets=None: asked.append((name, None if buckets is None else len(list(buckets)))) or real(self, name, schema, buckets))
    write(str(root / "f3.py"), "def own3():\n    own4()\n    own5()\n", 1_700_000_100)
    e.ingest(str(root))
    assert {n for n, b in asked if b is None} == {"files"}  # whose sizes and times are compared with the tree's
    assert all(b <= 3 for _, b in asked if b is not None) and {n for n, _ in asked} >= {"symbols", "calls", "names", "callers"}
    one = real(e.store, "symbols", schemas.SYMBOLS, [int(e.store.paths("symbols")[0].rsplit("=", 1)[1])])
    assert len(one.inputFiles()) == 1


def test_budget_is_kept_before_reading(spark, tmp_path, monkeypatch):
    from sparkloom.sources import parser

    root = tmp_path / "proj"
    for i in range(12):
        write(str(root / f"f{i:02}.py"), f"def own{i}():\n    pass\n", 1_700_000_000)
    read, real = [], parser.read_changed
    monkeypatch.setattr(parser, "read_changed", lambda files, root: read.append(sorted(r.file_path for r in files.collect())) or real(files, root))
    e = Engine(spark, str(tmp_path / "db"), threshold=10, budget=5)
    run = lambda **more: {r.action: r.n for r in e.ingest(str(root), **more).collect()}
    assert run() == {"new": 5, "meta": 7} and read[-1] == [f"f{i:02}.py" for i in range(5)]
    held = {r.file_path: (r.index_level, r.file_hash) for r in e.files().collect()}
    size = os.path.getsize(root / "f11.py")
    assert len(held) == 12 and held["f11.py"] == ("meta", f"meta:{size}:1700000000") and held["f00.py"][0] == "symbol"
    assert run() == {"skip_meta": 5, "parse": 5, "meta": 2} and read[-1] == [f"f{i:02}.py" for i in range(5, 10)]
    assert run() == {"skip_meta": 10, "parse": 2} and len(read[-1]) == 2 and e.files().where("index_level = 'meta'").isEmpty()
    assert run() == {"skip_meta": 12} and read[-1] == []
    assert run(force_full=True) == {"new": 12} and len(read[-1]) == 12 and e.symbols().count() == 12


def test_touched_files_are_read_but_not_parsed_again(spark, tmp_path):
    root = tmp_path / "proj"
    write(str(root / "a.py"), "def a():\n    a()\n", 1_700_000_000)
    e = Engine(spark, str(tmp_path / "db"))
    e.ingest(str(root))
    symbols, files = e.store.paths("symbols"), e.store.paths("files")
    os.utime(root / "a.py", (1_700_000_500, 1_700_000_500))
    assert {r.action: r.n for r in e.ingest(str(root)).collect()} == {"skip_hash": 1}
    assert e.store.paths("symbols") == symbols and e.store.paths("files") != files
    assert {r.action: r.n for r in e.ingest(str(root)).collect()} == {"skip_meta": 1}


def test_store_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), keep=1, buckets=4)
    rows_of = lambda **kv: spark.createDataFrame([(k, v) for k, v in kv.items()], "k string, v int").withColumn("bucket", F.when(F.col("k") < "m", 0).otherwise(2))
    store.commit({"t": Part(rows_of(a=1, z=2), (0, 2)), "u": rows_of(q=1)}, {"feed": 3})
    first = store.paths("t")
    read = store.read("t", "k string, v int")
    store.commit({"t": Part(rows_of(a=5), (0,))})
    assert rows(read, "k", "v") == [("a", 1), ("z", 2)]  # a reader keeps what it began with
    assert rows(store.read("t", "k string, v int"), "k", "v") == [("a", 5), ("z", 2)] and store.mark("feed") == 3
    assert first[1] in store.paths("t") and rows(store.read("t", "k string, v int", [2]), "k", "v") == [("z", 2)]
    store.commit({"t": Part(rows_of(z=0).where("false"), (2,))}, {"feed": 4})
    assert rows(store.read("t", "k string, v int"), "k", "v") == [("a", 5)] and store.mark("feed") == 4
    store.commit({"t": Part(rows_of(b=6), (0,))})
    assert not os.path.exists(first[0]) and rows(store.read("t", "k string, v int"), "k", "v") == [("b", 6)] and store.read("u", "k string").count() == 1
    other = Store(spark, str(tmp_path / "db"))
    state = store._state()
    other._state = lambda: state
    store.commit({"u": rows_of(q=2)})
    with pytest.raises(Exception):
        other.commit({"u": rows_of(q=3)})
    assert [r.v for r in store.read("u", "v int").collect()] == [2] and store.buckets == 4


def test_small_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.get_text("x") is None
    for i in range(3):
        store.put_text("x", str(i))
    assert store.get_text("x") == "2" and not glob.glob(str(tmp_path / "db/_new-*"))
    assert store.make_text("lock", "a") and not store.make_text("lock", "b") and store.get_text("lock") == "a"
    store.drop_text("lock")
    assert store.make_text("lock", "c")


def test_single_keys_write_one_bucket(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), buckets=8)
    for i in range(12):
        e.save_state(f"k{i}", "0")
    before = set(e.store.paths("system_state"))
    e.save_state("k5", "1")
    assert len(set(e.store.paths("system_state")) - before) == 1 and {r.value for r in e.state("k5").collect()} == {"1"}
    assert e.store.read("system_state", schemas.STATE).count() == 12
    hooks = [e.append_hook(f"h{i}") for i in range(6)]
    before = set(e.store.paths("pending_hooks"))
    e.release_hook(hooks[2], "done")
    assert len(set(e.store.paths("pending_hooks")) - before) == 1 and e.hooks().count() == 5
