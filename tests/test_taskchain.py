import pytest

from sparkloom.operators.taskchain import PROTOCOLS, Refused, TaskChain, replay


def test_execute_leads_to_the_next_pending_phase():
    c = TaskChain("develop")
    c.start("analyze")
    assert c.complete("analyze", "done") == "plan_gate"
    with pytest.raises(Refused):
        c.start("analyze")
    with pytest.raises(Refused):
        c.complete("implement")


def test_gate_retries_then_fails():
    c = TaskChain("debug")
    for p in c.phases[:3]:
        p["status"] = "passed"
    for _ in range(2):
        c.start("verify_gate")
        assert c.gate("verify_gate", "anything but pass") == "fix"
        assert c.phase("fix")["status"] == "pending"
        c.phase("fix")["status"] = "passed"
    c.start("verify_gate")
    with pytest.raises(Refused):
        c.gate("verify_gate", "fail")
    assert c.status == "failed"


def test_loop_passes_even_with_failed_parts():
    c = TaskChain("refactor")
    for p in c.phases[:2]:
        p["status"] = "passed"
    c.start("refactor")
    c.spawn("refactor", [{"name": "a"}, {"name": "b"}])
    assert not c.complete_sub("refactor", "sub_001", "pass")
    assert c.complete_sub("refactor", "sub_002", "fail")
    assert c.phase("refactor")["status"] == "passed"
    assert [s["status"] for s in c.phase("refactor")["sub_tasks"]] == ["passed", "failed"]


def test_second_reinit_is_refused():
    c = TaskChain("linear")
    c.reinit()
    with pytest.raises(Refused):
        c.reinit()


def test_replay(spark):
    rows = [(1, "t", "start"), (2, "t", "complete"), (3, "t", "complete"), (4, "u", "bogus")]
    e = spark.createDataFrame([(i, t, k, None, None, None) for i, t, k in rows], "id long, task_id string, event_type string, phase_id string, sub_id string, payload string")
    e = e.selectExpr("*", "timestamp_seconds(id) as created_at")
    got = {r.task_id: r for r in replay(e, "linear").collect()}
    assert (got["t"].status, got["t"].n_events, got["t"].n_errors) == ("finished", 3, 1)
    assert (got["u"].status, got["u"].n_errors) == ("running", 1)
    assert set(PROTOCOLS) == {"linear", "develop", "debug", "refactor"}


def test_sub_tasks_get_ids_by_number():
    c = TaskChain("develop")
    for p in c.phases[:2]:
        p["status"] = "passed"
    c.start("implement")
    c.spawn("implement", [{"name": "x"}, {"name": "y", "id": "own"}, {"name": "z"}])
    assert [s["id"] for s in c.phase("implement")["sub_tasks"]] == ["sub_001", "own", "sub_003"]
