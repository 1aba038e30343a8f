import pytest

from sparkloom.plans import extras, oracles, queries

from .oracle import connect, same

ORACLES, QUERIES = oracles.ORACLES | extras.ORACLES, queries.QUERIES | extras.QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name], connect(sf_dir))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"task_chain_state", "random_walk_coverage", "stream_task_chain"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_stream_equals_batch(spark, sf_dir):
    a = {r.task_id: r for r in QUERIES["task_chain_state"](spark, sf_dir).collect()}
    b = {r.task_id: r for r in QUERIES["stream_task_chain"](spark, sf_dir).collect()}
    assert a == b


def test_walks_stay_in_reach(spark, sf_dir):
    from sparkloom.operators import graph
    from sparkloom.plans.queries import ROOT, _edges, _roots

    edges = _edges(spark, sf_dir)
    seen = {r.node: r.visits for r in graph.random_walks(edges, ROOT, walks=200, steps=4).collect()}
    again = {r.node: r.visits for r in graph.random_walks(edges, ROOT, walks=200, steps=4).collect()}
    near = {r.node for r in graph.reach(edges, _roots(spark), "forward", depth=4).collect()} | {ROOT}
    assert seen == again and set(seen) <= near and seen[ROOT] >= 200


def test_log_shows_newest(spark, tmp_path):
    events = spark.range(999_900, 1_000_200).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'view' AS event_type", "0.0D AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.id for r in QUERIES["log_projection"](spark, str(tmp_path)).collect()) == list(range(1_000_100, 1_000_200))


def test_stream_reads_payloads(spark, tmp_path):
    """A stream whose events name phases, sub-tasks and payloads ends as the batch does."""
    import json
    from datetime import datetime

    from sparkloom.operators import taskchain
    from sparkloom.streaming import jobs

    schema = "id long, task_id string, phase_id string, sub_id string, event_type string, payload string, created_at timestamp"
    said = [("start", "", None), ("complete", "", {"summary": "s"}), ("start", "", None), ("pass", "", None), ("start", "implement", None), ("spawn", "implement", {"sub_tasks": [{"name": "x"}, {"name": "y"}]}), ("complete_sub", "implement", {"result": "fail"}), ("complete_sub", "implement", {"result": "pass"})]
    rows = [(i, t, p, None, k, json.dumps(x) if x else None, datetime(2024, 1, 1, 0, 0, i)) for t in ("a", "b") for i, (k, p, x) in enumerate(said)]
    events = spark.createDataFrame(rows, schema)
    for i in range(0, 8, 3):
        events.where(f"id >= {i} and id < {i + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = jobs._collected(jobs.chain_states(stream), "update").collect()
    want = {r.task_id: r for r in taskchain.replay(events).collect()}
    assert want["a"].n_errors == 0 and "failed" in want["a"].phases_json and set(out) == set(want.values())
