"""Tasks, personas, match records, spilled answers, the map's tree, and states of a small event table."""

import json
from datetime import datetime

import pytest

from sparkloom.api import Engine
from sparkloom.operators import metrics
from sparkloom.plans import queries
from sparkloom.sources import logs, results


def test_tasks(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), buckets=8)
    assert e.tasks().count() == 0 and e.task("x").count() == 0
    e.save_task("t1", "fix the parser", task_type="bug")
    e.save_task("t2", "write docs")
    first = e.task("t1").first()
    assert (first.status, first.task_type, first.completed_at) == ("pending", "bug", None)
    before = set(e.store.paths("tasks"))
    e.save_task("t1", "fix the parser", status="completed", summary="quotes were wrong")
    now = e.task("t1").first()
    assert now.created_at == first.created_at and now.updated_at > first.updated_at and now.task_type == "bug" and now.completed_at is not None
    assert len(set(e.store.paths("tasks")) - before) == 1
    assert [r.task_id for r in e.tasks().collect()] == ["t1", "t2"]
    assert [r.task_id for r in e.tasks("QUOTES, nothing").collect()] == ["t1"] and e.tasks("100%").count() == 0
    assert [r.task_id for r in e.tasks(limit=1).collect()] == ["t1"]
    with pytest.raises(ValueError):
        e.save_task("t3", "x", colour="red")


def test_personas(spark, tmp_path):
    def library(name, *rows):
        (tmp_path / name).write_text(json.dumps({"personas": list(rows)}, ensure_ascii=False, indent=1))
        return str(tmp_path / name)

    own = library("own.json", {"name": "owl", "display_name": "Owl", "hard_directive": "be wise", "aliases": ["Eule", "hibou"]})
    shared = library("shared.json", {"name": "owl", "hard_directive": "other"}, {"name": "fox", "display_name": "Fuchs", "style_must": ["a", "b"]}, {"display_name": "nameless"})
    (tmp_path / "bad.json").write_text("{broken")
    paths = [str(tmp_path / "none.json"), str(tmp_path / "bad.json"), own, shared]
    got = {r.name: r for r in logs.read_personas(spark, paths).collect()}
    assert set(got) == {"owl", "fox"} and got["owl"].hard_directive == "be wise" and got["fox"].style_must == ["a", "b"]
    e = Engine(spark, str(tmp_path / "db"))
    assert e.activate_persona(" EULE ", *paths)["name"] == "owl" and e.state("active_persona").first().value == "owl"
    assert e.activate_persona("wolf", *paths) == {"found": False, "names": ["fox", "owl"]} and not e.activate_persona(" ", *paths)["found"]
    e.save_persona("fox", hard_directive="be quick", aliases=["renard"])
    assert e.activate_persona("Renard", *paths)["hard_directive"] == "be quick" and e.personas(*paths).count() == 2
    assert e.drop_persona("fox") and not e.drop_persona("fox") and e.activate_persona("fuchs", *paths)["style_must"] == ["a", "b"]
    with pytest.raises(ValueError):
        e.save_persona("x")


def test_match_records(spark, tmp_path):
    said = [
        {"type": "begin", "data": {"path": {"text": "a\\b.py"}}},
        {"type": "match", "data": {"path": {"text": "a\\b.py"}, "lines": {"text": "x = foo(foo)\r\n"}, "line_number": 3, "absolute_offset": 9, "submatches": [{"match": {"text": "foo"}, "start": 4, "end": 7}, {"match": {"text": "foo"}, "start": 8, "end": 11}]}},
        {"type": "context", "data": {"path": {"text": "a\\b.py"}, "lines": {"text": "y\n"}, "line_number": 4, "submatches": []}},
        {"type": "match", "data": {"path": {"text": "c.py"}, "lines": {"text": "é"}, "line_number": 1, "submatches": []}},
        {"type": "summary", "data": {"elapsed_total": {"secs": 0}}},
    ]
    (tmp_path / "out.jsonl").write_text("\n".join(json.dumps(x) for x in said) + "\n{broken\n\n")
    got = sorted(tuple(r) for r in results.read_matches(spark, str(tmp_path / "out.jsonl")).collect())
    assert got == [("a/b.py", 3, "x = foo(foo)", [4, 7, 8, 11]), ("c.py", 1, "é", [])]


def test_long_answers_go_to_a_file(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    assert e.shown("map.md", "é" * 1000) == "é" * 1000
    path = e.shown("map.md", "é" * 1001)
    assert open(path).read() == "é" * 1001 and e.store.get_text("_shown/map.md") == "é" * 1001
    e.shown("map.md", "z" * 3000)
    assert open(path).read() == "z" * 3000


@pytest.mark.parametrize("n", [5, 20, 21, 40, 41, 60])
def test_map_tree(spark, n):
    rows = []
    for i in range(n):
        rows.append((f"d{i:02}", 1, float(n - i)))
        for j in range(7):
            rows.append((f"d{i:02}/e{j}", 1, float(j)))
            rows += [(f"d{i:02}/e{j}/f{k}", 1, 1.0) for k in range(6)] if i < 22 else []
    rolled = spark.createDataFrame([(d, 1, s, x, d.count("/") + 1) for d, s, x in rows] + [(".", 1, 1, 0.0, 0)], "dir string, n_files int, n_symbols int, sum_score double, depth int")
    show, two, one = (20, 20, 20) if n <= 20 else (25, 8, 18) if n <= 40 else (20, 6, 12)
    want = set()
    for i in range(min(n, show)):
        want.add(f"d{i:02}")
        if i < one:
            for j in (6, 5, 4, 3, 2, 1, 0)[: 7 if i < two else 3]:
                want.add(f"d{i:02}/e{j}")
                want |= {f"d{i:02}/e{j}/f{k}" for k in range(5)} if i < two else set()
    got = metrics.adaptive_tree(rolled).collect()
    assert {r.dir for r in got} == want and len(got) == len(want)
    assert {r.of for r in got if r.depth == 1} == {n} and {r.of for r in got if r.depth == 2} == {7}


def test_states_of_a_small_event_table(spark, tmp_path):
    """By hand: the develop protocol, whose gate leads back and then on; and events that it doesn't admit."""
    say = {"start": "view", "complete": "click", "pass": "purchase", "fail": "error", "init": "signup"}
    told = {
        1: "start complete start pass start complete start pass start complete",  # the whole way
        2: "start complete start fail start",  # the gate sends back to the first phase
        3: "complete pass start start",  # nothing is active yet, so two are refused; a second phase may begin beside the first
        4: "start complete init start",  # begun anew, once
        5: "start complete init init",
    }
    rows, n = [], 0
    for user, kinds in told.items():
        for kind in kinds.split():
            rows.append((n, datetime(2024, 1, 1, 0, 0, n), user, say[kind], 1.0, "{}"))
            n += 1
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = {
        "task_1": ("finished", ["passed"] * 5, 10, 0, 0),
        "task_2": ("running", ["active", "pending", "pending", "pending", "pending"], 5, 0, 0),
        "task_3": ("running", ["active", "active", "pending", "pending", "pending"], 4, 2, 0),
        "task_4": ("running", ["active", "pending", "pending", "pending", "pending"], 4, 0, 1),
        "task_5": ("running", ["pending"] * 5, 4, 1, 1),
    }
    for name in ("task_chain_state", "stream_task_chain"):
        got = {r.task_id: (r.status, [p["status"] for p in json.loads(r.phases_json)], r.n_events, r.n_errors, r.reinit_count) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == want, name


def test_recovery_takes_the_first_source_that_holds_anything(spark, tmp_path):
    from sparkloom import schemas

    e = Engine(spark, str(tmp_path / "db"))
    (tmp_path / "log.md").write_text("# Log\n- [from the log] **2024-01-02 03:04:05**: fix (core) patch x\n")
    (tmp_path / "archive").mkdir()
    log, archive = logs.read_log(spark, str(tmp_path / "log.md")), spark.createDataFrame([], schemas.MEMOS)
    assert [r.content for r in logs.recovered(e.memos(), archive, log).collect()] == ["from the log"]
    other = Engine(spark, str(tmp_path / "other"))
    other.append_memos([{"content": "from the archive", "entity": "x"}])
    assert [r.content for r in logs.recovered(e.memos(), other.memos(), log).collect()] == ["from the archive"]
    e.append_memos([{"content": "own", "entity": "x"}])
    assert [r.content for r in logs.recovered(e.memos(), other.memos(), log).collect()] == ["own"]
    assert logs.recovered(archive, archive, log.where("false")).count() == 0


def test_events_are_appended(spark, tmp_path):
    from sparkloom import schemas

    e = Engine(spark, str(tmp_path / "db"))
    for i, kind in enumerate(("start", "complete")):
        e.append_chain_events(spark.createDataFrame([(i, "t", None, None, kind, None, datetime(2024, 1, 1, 0, 0, i))], schemas.CHAIN_EVENTS))
    assert [(r.id, r.event_type) for r in e.chain_events().orderBy("id").collect()] == [(0, "start"), (1, "complete")]
    assert e.task_chains().first().n_events == 2 and len(e.store.paths("task_chain_events")) == 1
