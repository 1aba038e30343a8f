"""Streams and background builds: batches count once, a build that is killed changes nothing."""

import json
import os
import threading
import time
from datetime import datetime

import pytest

from sparkloom import builds, schemas
from sparkloom.api import Engine
from sparkloom.operators import taskchain
from sparkloom.streaming import follow

SAID = [("start", "", None), ("complete", "", {"summary": "s"}), ("start", "", None), ("pass", "", None), ("start", "implement", None), ("spawn", "implement", {"sub_tasks": [{"name": "x"}, {"name": "y"}]}), ("complete_sub", "implement", {"result": "fail"}), ("complete_sub", "implement", {"result": "pass"}), ("nonsense", "", None)]
COLUMNS = ("task_id", "protocol", "status", "current_phase", "n_events", "n_errors", "last_error", "reinit_count", "phases_json")


def events(spark, folder, lo, hi, tasks=("a", "b", "c")):
    rows = [(10 * i + j, t, p, None, k, json.dumps(x) if x else None, datetime(2024, 1, 1, 0, i, j)) for i, (k, p, x) in enumerate(SAID) for j, t in enumerate(tasks)]
    spark.createDataFrame([r for r in rows if lo <= r[0] // 10 < hi], schemas.CHAIN_EVENTS).coalesce(1).write.mode("append").parquet(folder)


def table(e):
    return sorted(tuple(r) for r in e.chains().select(*COLUMNS).collect())


def replayed(spark, folder):
    return sorted(tuple(r) for r in taskchain.replay(spark.read.schema(schemas.CHAIN_EVENTS).parquet(folder)).select(*COLUMNS).collect())


def test_chain_states_are_written_through(spark, tmp_path, monkeypatch):
    e, folder, checkpoint = Engine(spark, str(tmp_path / "db"), buckets=4), str(tmp_path / "in"), str(tmp_path / "cp")
    events(spark, folder, 0, 2)
    events(spark, folder, 2, 3)
    follow.follow_chains(e, folder, checkpoint, files=1)
    assert table(e) == replayed(spark, folder) and e.store._state()[0] == 1
    # a batch is committed, but the stream dies before it can note that
    events(spark, folder, 3, 5)
    real = Engine.advance_chains

    def dies(self, *a):
        real(self, *a)
        raise OSError("killed")

    monkeypatch.setattr(Engine, "advance_chains", dies)
    with pytest.raises(Exception):
        follow.follow_chains(e, folder, checkpoint)
    monkeypatch.setattr(Engine, "advance_chains", real)
    number = e.store._state()[0]
    assert table(e) == replayed(spark, folder)
    follow.follow_chains(e, folder, checkpoint)  # the batch is given again
    assert e.store._state()[0] == number and table(e) == replayed(spark, folder)
    # it dies before the commit
    events(spark, folder, 5, 7)
    monkeypatch.setattr(Engine, "advance_chains", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception):
        follow.follow_chains(e, folder, checkpoint)
    monkeypatch.setattr(Engine, "advance_chains", real)
    follow.follow_chains(e, folder, checkpoint)
    assert table(e) == replayed(spark, folder)
    # a cold stream is given all events again and starts from the table
    events(spark, folder, 7, 9, ("a", "b", "c", "d"))
    follow.follow_chains(e, folder, str(tmp_path / "cold"))
    assert [r[:7] for r in table(e) if r[0] != "d"] == [r[:7] for r in replayed(spark, folder) if r[0] != "d"] and len(table(e)) == 4
    assert {r.task_id: r.n_events for r in e.chains().collect()} == {"a": 9, "b": 9, "c": 9, "d": 2}


def test_other_tasks_stay_as_they_are(spark, tmp_path):
    e, folder = Engine(spark, str(tmp_path / "db"), buckets=32), str(tmp_path / "in")
    events(spark, folder, 0, 3, tuple(f"t{i}" for i in range(20)))
    follow.follow_chains(e, folder, str(tmp_path / "cp"))
    before = set(e.store.paths("task_chains"))
    events(spark, folder, 3, 4, ("t3",))
    follow.follow_chains(e, folder, str(tmp_path / "cp"))
    assert len(set(e.store.paths("task_chains")) - before) == 1 and e.chains().where("task_id = 't3'").first().created_at == datetime(2024, 1, 1, 0, 0, 3)


def feed(folder, name, paths):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("".join(json.dumps({"path": p}) + "\n" for p in paths))


def test_changed_files_are_followed(spark, tmp_path, monkeypatch):
    root, db = tmp_path / "proj", str(tmp_path / "db")
    (root / "pkg").mkdir(parents=True)
    for i in range(4):
        (root / f"pkg/f{i}.py").write_text(f"def own{i}():\n    own{i + 1}()\n")
    e, inbox, checkpoint = Engine(spark, db, buckets=4), str(tmp_path / "feed"), str(tmp_path / "cp")
    feed(inbox, "a", ["pkg/f0.py", "pkg/f1.py", "pkg/f1.py", "pkg/none.py", "pkg/readme.md"])
    reporter = follow.Reporter(e.store)
    spark.streams.addListener(reporter)
    try:
        follow.follow_changes(e, str(root), inbox, checkpoint)
        assert {r.file_path for r in e.files().collect()} == {"pkg/f0.py", "pkg/f1.py"} and e.edges().count() == 1
        for _ in range(50):
            if (said := e.store.get_text("_streams.json")) and json.loads(said)["processed"] == 5:
                break
            time.sleep(0.2)
        assert json.loads(e.store.get_text("_streams.json"))["processed"] == 5
    finally:
        spark.streams.removeListener(reporter)
    (root / "pkg/f0.py").unlink()
    (root / "pkg/f1.py").write_text("def own1():\n    own3()\n")
    os.utime(root / "pkg/f1.py", (1_800_000_000, 1_800_000_000))
    feed(inbox, "b", ["pkg/f0.py", "pkg/f1.py", "pkg/f3.py"])
    real, given = Engine.refresh, []

    def dies(self, *a):
        given.append(a)
        real(self, *a)
        raise OSError("killed")

    monkeypatch.setattr(Engine, "refresh", dies)
    with pytest.raises(Exception):
        follow.follow_changes(e, str(root), inbox, checkpoint)
    monkeypatch.setattr(Engine, "refresh", real)
    number, held = e.store._state()
    follow.follow_changes(e, str(root), inbox, checkpoint)
    assert e.store._state() == (number, held)  # the batch, given again, changes nothing
    assert {r.file_path for r in e.files().collect()} == {"pkg/f1.py", "pkg/f3.py"} and {r.name for r in e.impact("own3").collect()} == {"own1"}


@pytest.fixture
def large(tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    for i in range(48):
        body = "".join(f"def f{i}_{j}(a):\n    b = f{i}_{j + 1}(a) + len(a)\n    return [x for x in (b, a)]\n\n" for j in range(1500))
        (root / f"m{i:02}.py").write_text(body)
    return root


def test_build_in_the_background(spark, tmp_path, large):
    e = Engine(spark, str(tmp_path / "db"))
    seen, over = [], threading.Event()

    def watch():
        while not over.wait(0.05):
            if said := e.store.get_text(builds.PROGRESS):
                seen.append(json.loads(said))

    watcher = threading.Thread(target=watch)
    watcher.start()
    build = e.build(str(large))
    with pytest.raises(builds.Busy):
        e.build(str(large))
    assert spark.range(1000).selectExpr("sum(id) AS s").first().s == 499500 and not build.wait(0)  # a query beside it
    assert e.files().count() == 0
    assert build.wait(300) and build.counts == {"new": 48} and e.symbols().count() == 48 * 1500
    over.set()
    watcher.join()
    done = [x["processed"] for x in seen]
    assert done == sorted(done) and len(set(done)) >= 3 and seen[-1]["total"] == 48 and e.index_status()["progress"]["processed"] == 48
    assert e.store.get_text(builds.LOCK) is None and e.index_status()["index_status"]["status"] == "ready"
    # a build that is killed leaves the old version
    for f in large.iterdir():
        os.utime(f, (1_800_000_000, 1_800_000_000))
        f.write_text(f.read_text().replace("def f", "def g"))
    held = e.store._state()
    second = e.build(str(large), force_full=True)
    time.sleep(2)
    second.cancel()
    try:
        second.wait(120)
    except Exception:
        pass
    assert second.error is not None and e.store._state() == held and e.symbols().where("name like 'f%'").count() == 48 * 1500
    assert e.index_status()["index_status"]["status"] == "failed" and e.store.get_text(builds.LOCK) is None


def test_dead_builds_are_taken_over(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj/a.py").write_text("def a():\n    pass\n")
    e = Engine(spark, str(tmp_path / "db"))
    e.store.put_text(builds.LOCK, json.dumps({"id": "x", "path": "y", "at": time.time()}))
    with pytest.raises(builds.Busy):
        e.build(str(tmp_path / "proj"))
    e.store.put_text(builds.LOCK, json.dumps({"id": "x", "path": "y", "at": time.time() - 2 * builds.STALE_S}))
    build = e.build(str(tmp_path / "proj"))
    assert build.wait(120) and build.counts == {"new": 1}


def test_a_failed_ingest_is_tried_again(spark, tmp_path, monkeypatch):
    """Once more, with the extensions of the tree's stacks alone."""
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj/a.py").write_text("def a():\n    pass\n")
    (tmp_path / "proj/b.java").write_text("class B {}\n")
    e, asked, real = Engine(spark, str(tmp_path / "db")), [], Engine._ingest

    def first_fails(self, path, extensions, *more):
        asked.append(tuple(extensions))
        if len(asked) == 1:
            raise RuntimeError("no memory")
        return real(self, path, extensions, *more)

    monkeypatch.setattr(Engine, "_ingest", first_fails)
    assert e.ensure_fresh(str(tmp_path / "proj")) and asked == [(), ("py", "java")] and e.fresh()
    monkeypatch.setattr(Engine, "_ingest", lambda *a: (_ for _ in ()).throw(RuntimeError("no memory")))
    with pytest.raises(RuntimeError):
        Engine(spark, str(tmp_path / "db2")).ensure_fresh(str(tmp_path / "proj"))
