import os
import time

import pytest

from sparkloom.api import Engine
from sparkloom.sources import files as source_files
from sparkloom.sources import logs, parser

PY = "class Shop:\n    def sell(self, x):\n        return price(x)\n\n\ndef price(x):\n    return helper(x) + helper(x)\n\n\ndef helper(x):\n    return len(x)\n"
GO = "package main\n\n// Old() is gone\nfunc Handle(w int) {\n\tprice(w)\n}\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg/shop.py").write_text(PY)
    (root / "main.go").write_text(GO)
    (root / "node_modules/x.js").write_text("function no() {}")
    return root


def test_parsers():
    symbols, calls = parser.parse_text(PY, "python")
    assert [(s[0], s[1], s[2]) for s in symbols] == [("Shop", "Shop", "class"), ("sell", "Shop::sell", "function"), ("price", "price", "function"), ("helper", "helper", "function")]
    assert [(symbols[c][0], n) for c, n, _ in calls] == [("sell", "price"), ("price", "helper"), ("price", "helper"), ("helper", "len")]
    symbols, calls = parser.parse_text(GO, "go")
    assert [(s[0], s[3], s[4]) for s in symbols] == [("Handle", 4, 6)] and [c[1] for c in calls] == ["price"]
    symbols, _ = parser.parse_text("impl Foo {\n  fn bar(&self) -> u8 { baz(1) }\n}", "rust")
    assert [s[1] for s in symbols] == ["Foo", "Foo::bar"]
    assert [s[0] for s in parser.parse_text("class A { go(x: number): void { f(); } }", "typescript")[0]] == ["A", "go"]
    assert [s[0] for s in parser.parse_text("int add(int a) {\n return a;\n}", "c")[0]] == ["add"]
    assert [s[0] for s in parser.parse_text("class A { public int run(int x) { return f(x); } }", "java")[0]] == ["A", "run"]
    assert parser.parse_text("def broken(:", "python") == ([], [])


def test_ingest_search_and_impact(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    counts = {r.action: r.n for r in e.ingest(str(tree)).collect()}
    assert counts == {"new": 2}
    assert e.symbols().count() == 5
    assert [r.name for r in e.search("price").collect()] == ["price"]
    near = {(r.name, r.hop) for r in e.impact("helper").collect()}
    assert near == {("price", 1), ("sell", 2), ("Handle", 2)}
    assert e.risk("helper").first().direct_edges == 2
    assert e.symbol_at("pkg/shop.py", 3).first().owner == "sell"
    assert {r.owner for r in e.grep(str(tree), "helper(x)").collect()} == {"price", "helper"}
    assert e.flow_trace(symbol="price").count() == 1
    before = e.snapshot().collect()
    base = spark.createDataFrame(before, e.snapshot().schema)

    assert {r.action: r.n for r in e.ingest(str(tree)).collect()} == {"skip_meta": 2}
    (tree / "pkg/shop.py").write_text(PY.replace("helper(x) + helper(x)", "1"))
    os.remove(tree / "main.go")
    os.utime(tree / "pkg/shop.py", (time.time() + 5, time.time() + 5))
    assert {r.action: r.n for r in e.ingest(str(tree)).collect()} == {"parse": 1, "removed": 1}
    assert e.impact("helper").count() == 0 and e.files().count() == 1
    changes = {(r.canonical_id.split("::")[-1], r.change) for r in e.diff(base).collect()}
    assert changes == {("price", "modified"), ("Handle", "removed")}


def test_scan_and_stack(spark, tree):
    found = source_files.scan(spark, str(tree))
    assert {r.file_path for r in found.select("file_path").collect()} == {"pkg/shop.py", "main.go"}
    stacks, exts, _ = source_files.detect_stack(found)
    assert stacks == ["python", "go"] and exts == ["py", "go"]
    assert source_files.ignore_rules("# c\nbuild/\n!keep/\n/a/b/tmp/\nfile.txt\n*.log\n") == ["build", "tmp"]
    assert source_files.valid_root(str(tree)) and not source_files.valid_root("/")


def test_memory(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    assert e.recall("x").count() == 0
    e.append_memos([{"entity": "Unit Test", "content": "Verification run", "category": "test"}, {"content": "first line\nsecond", "entity": "-"}])
    e.append_fact("rule", "Verification is due")
    got = [(r.section, r.content) for r in e.recall("Verification").collect()]
    assert got == [("fact", "Verification is due"), ("memo", "Verification run")]
    assert {r.entity for r in e.memos().collect()} == {"Unit Test", "first line"}
    hook = e.append_hook("later", hours=1)
    assert [(r.hook_id, r.expired) for r in e.hooks().collect()] == [(hook, False)]
    e.release_hook(hook, "done")
    assert e.hooks().count() == 0 and e.hooks("closed").first().result_summary == "done"
    e.save_state("k", "1")
    e.save_state("k", "2")
    assert [r.value for r in e.state("k").collect()] == ["2"]
    e.archive(str(tmp_path / "archive"))
    with open(tmp_path / "archive" / "bad.json", "w") as f:
        f.write("\nnot json\n")
    assert logs.read_archive(spark, str(tmp_path / "archive")).count() == 2
    (tmp_path / "log.md").write_text("# Log\n- [did it] **2024-01-02 03:04:05**: fix (core) patch x\nnoise\n")
    row = logs.read_log(spark, str(tmp_path / "log.md")).first()
    assert (row.category, row.entity, row.act, row.content, str(row.timestamp)) == ("fix", "core", "patch x", "did it", "2024-01-02 03:04:05")
    assert e.briefing("please fix the parser", read_only=False).first().intent == "DEBUG"


def test_catalog(spark, tmp_path):
    (tmp_path / "s/one/scripts").mkdir(parents=True)
    (tmp_path / "s/one/SKILL.md").write_text("---\nname: one-skill\ndescription: does one\n---\n# One\n")
    (tmp_path / "s/two").mkdir()
    (tmp_path / "s/two/SKILL.md").write_text("# Two\n\nParagraph of two.\n")
    (tmp_path / "s/one/scripts/run.sh").write_text("x")
    got = {r.name: r.description for r in logs.read_catalog(spark, str(tmp_path / "s")).collect()}
    assert got == {"one-skill": "does one", "two": "Paragraph of two."}
    assert [(r.entry, r.kind, r.files) for r in logs.resources(spark, str(tmp_path / "s")).collect()] == [("one", "scripts", ["run.sh"])]
    assert logs.valid_entries(logs.read_catalog(spark, str(tmp_path / "s"))).where("problem is null").count() == 2


def test_every_file_is_seen(spark, tree, tmp_path):
    (tree / "pkg/__init__.py").write_text("def boot():\n    return price(1)\n")
    (tree / ".tools").mkdir()
    (tree / ".tools/run.py").write_text("def run():\n    boot()\n")
    for folder in ("generated", "bin", "deep/scratch"):
        (tree / folder).mkdir(parents=True)
        (tree / folder / "no.py").write_text("def no(): pass\n")
    (tree / ".gitignore").write_text("generated/\n# note\n!kept/\ndeep/scratch\n*.log\n")
    (tree / "go.mod").write_text("module x\n")
    e = Engine(spark, str(tmp_path / "db"))
    extensions, ignored, stacks = e.project(str(tree))
    assert stacks == ["python", "go"] and {"generated", "scratch", "bin"} <= set(ignored) and "pkg" not in ignored and extensions[:2] == ("py", "go")
    e.ingest(str(tree))
    assert {r.file_path for r in e.files().collect()} == {"pkg/shop.py", "pkg/__init__.py", ".tools/run.py", "main.go"}
    assert {(r.name, r.hop) for r in e.impact("price").collect()} == {("sell", 1), ("Handle", 1), ("boot", 1), ("run", 2)}
    assert {r.action: r.n for r in e.ingest(str(tree), scope="pkg").collect()} == {"skip_meta": 2} and e.files().count() == 4


def test_status_freshness_and_one_commit(spark, tree, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "db"))
    assert "index_status_error" in e.index_status() and not e.fresh()
    assert e.ensure_fresh(str(tree)) and e.fresh() and not e.ensure_fresh(str(tree)) and not e.fresh(ttl=-1)
    status = e.index_status()
    assert status["index_status"]["counts"] == {"new": 2} and set(status["tables"]) == {"files", "symbols", "calls", "edges", "names", "callers", "grams"}
    e.store.put_text("_status.json", "{broken")
    assert e.index_status()["index_status_raw"] == "{broken" and not e.fresh()
    # a change that breaks off leaves all three tables as they were
    before = (e.files().count(), e.symbols().count(), e.calls().count())
    (tree / "pkg/more.py").write_text("def more():\n    price(2)\n")
    real, written = e.store.commit, []

    def broken(tables, marks=None):
        for name, part in tables.items():
            part.rows.write.parquet(str(tmp_path / f"half-{name}"))
            written.append(name)
            raise OSError("disk gone")

    monkeypatch.setattr(e.store, "commit", broken)
    with pytest.raises(OSError):
        e.ingest(str(tree))
    assert e.index_status()["index_status"]["status"] == "failed" and (e.files().count(), e.symbols().count(), e.calls().count()) == before
    monkeypatch.setattr(e.store, "commit", real)
    assert {r.action: r.n for r in e.ingest(str(tree)).collect()} == {"skip_meta": 2, "new": 1}
    for i in range(4):
        e.save_state("k", str(i))
    assert len(os.listdir(tmp_path / "db/system_state")) == 3 and [r.value for r in e.state("k").collect()] == ["3"]


def test_ingest_stops_in_time(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    with pytest.raises(Exception):
        e.ingest(str(tree), timeout=0.2)
    assert e.files().count() == 0 and e.index_status()["index_status"]["status"] == "failed"
    assert e.ingest(str(tree), timeout=600).count() == 1


def test_answers(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.ingest(str(tree))
    assert [(r.section, r.name) for r in e.search_all(str(tree), "price").collect()] == [("exact", "price")]
    rows = e.search_all(str(tree), "len(x)").collect()
    assert {(r.section, r.name, r.line) for r in rows} == {("text", "helper", 11)}
    assert e.search_all(str(tree), "pric", kind="class").where("section <> 'text'").count() == 0
    lists = {(r.direction, r.kind, r.name, r.of) for r in e.flow_lists("price").collect()}
    assert lists == {("backward", "direct", "sell", 2), ("backward", "direct", "Handle", 2), ("forward", "direct", "helper", 1)}
    assert {r.direction for r in e.flow_lists("price", direction="forward").collect()} == {"forward"}
    assert [r.line for r in e.checklist("helper").orderBy("place").collect()] == ["Target: helper (pkg/shop.py)", "Check Caller: function:price (pkg/shop.py)"]
    e.append_fact("rule", "helper is slow")
    first = e.briefing("please fix helper", symbols=("HELPER", "nowhere", "HELPER")).first()
    assert first.intent == "DEBUG" and [(a.query, a.name) for a in first.anchors] == [("HELPER", "helper")] and first.facts == ["helper is slow"] and first.level == "Low"
    held = e.handoff(first.task_id)
    assert held["anchors"][0]["name"] == "helper" and "fix" in held["strategy"]
    with pytest.raises(KeyError):
        e.handoff(first.task_id)


def test_skills_and_status_files(spark, tmp_path):
    from sparkloom.sources import results

    (tmp_path / "s/one/references").mkdir(parents=True)
    (tmp_path / "s/one/SKILL.md").write_text("---\nname: one-skill\ndescription: does one\n---\n# One\n")
    (tmp_path / "s/one/references/more.txt").write_text("more")
    e = Engine(spark, str(tmp_path / "db"))
    root = str(tmp_path / "s")
    assert e.skill(root, "ONE") == {"found": False, "suggestions": ["one-skill"]}
    got = e.skill(root, "one-skill")
    assert got["text"].strip() == "# One" and got["resources"] == {"references": ["more.txt"]}
    assert e.skill(root, "one-skill", "more.txt")["text"] == "more" and "error" in e.skill(root, "one-skill", "../x") and "error" in e.skill(root, "one-skill", "nothing")
    (tmp_path / "st").mkdir()
    (tmp_path / "st/a.json").write_text('{"status": "ready", "n": 3}')
    (tmp_path / "st/b.json").write_text("{broken")
    rows = {r.path.rsplit("/", 1)[-1]: (r.held, r.raw) for r in results.read_status(spark, str(tmp_path / "st")).collect()}
    assert rows == {"a.json": ({"status": "ready", "n": "3"}, None), "b.json": (None, "{broken")}


def test_chains_of_their_own(spark, tmp_path):
    import json
    from datetime import datetime

    from sparkloom import schemas

    e = Engine(spark, str(tmp_path / "db"))
    own = json.dumps({"phases": [{"id": "look"}, {"id": "check", "type": "gate", "on_fail": "look", "max_retries": 2}]})
    said = [("a", "init", json.dumps({"protocol": "linear"})), ("a", "start", ""), ("a", "complete", json.dumps({"summary": "done"})), ("b", "init", own), ("b", "start", None), ("b", "complete", None), ("b", "start", None), ("b", "fail", None), ("c", "start", None)]
    rows = [(i, t, None, None, k, p, datetime(2024, 1, 1, 0, 0, i)) for i, (t, k, p) in enumerate(said)]
    e.append_chain_events(spark.createDataFrame(rows, schemas.CHAIN_EVENTS))
    got = {r.task_id: r for r in e.task_chains().collect()}
    assert (got["a"].protocol, got["a"].status) == ("linear", "finished") and "done" in got["a"].phases_json
    assert [p["status"] for p in json.loads(got["b"].phases_json)] == ["pending", "pending"] and got["b"].protocol == "custom" and got["c"].protocol == "develop"
    e.save_chains()
    assert e.chains().count() == 3
    e.delete_chains("b", "c")
    assert {r.task_id for r in e.chains().collect()} == {"a"} == {r.task_id for r in e.chain_events().collect()}


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions import text as X
    from sparkloom.operators import search

    row = spark.range(1).select(
        X.cut_bytes(F.lit("añb"), 2), X.cut_bytes(F.lit("ab"), 2), F.date_format(X.parsed_time(F.lit("2024-01-02T03:04:05+00:00")), "yyyy-MM-dd HH:mm:ss"), X.normalised_time(F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == ("a...", "ab", "2024-01-02 03:04:05", "1970-01-01T00:00:00Z")
    texts = spark.createDataFrame([(1, "a.py", "the cat\nconcat\nThe end")], "file_id long, file_path string, text string")
    assert [r.line for r in search.grep(texts, "cat", whole_word=True).collect()] == [1]
    assert [r.line for r in search.grep(texts, "the", whole_word=True, ignore_case=True).orderBy("line").collect()] == [1, 3]


def test_files_of_other_encodings(spark, tree, tmp_path):
    """A file that isn't UTF-8 is indexed and searched with its odd bytes replaced."""
    (tree / "latin.py").write_bytes("def café_open():\n    # naïve\n    helper(1)\n\n\ndef plain_one():\n    helper(2)\n".encode("latin-1"))
    (tree / "bytes.py").write_bytes(b"\x00\xff\xfe\x00")
    (tree / "empty.py").write_bytes(b"")
    e = Engine(spark, str(tmp_path / "db"))
    assert {r.action: r.n for r in e.ingest(str(tree)).collect()} == {"new": 5}
    assert e.search("plain_one").first().file_path == "latin.py" and {r.file_path: r.line_count for r in e.files().collect()}["empty.py"] == 0
    assert {(r.file_path, r.owner) for r in e.grep(str(tree), "helper(2)").collect()} == {("latin.py", "plain_one")}
