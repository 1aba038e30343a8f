"""Gated task state machines, replayed from their event log.

Events of a task are folded in order. The log is partitioned by task and sorted
within partitions, and the fold streams over the sorted rows, so a task's
events are never gathered in memory.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The phases of the built-in protocols (id, type, on_pass, on_fail, max_retries).
PROTOCOLS = {
    "linear": (("main", "execute", "", "", 0),),
    "develop": (
        ("analyze", "execute", "", "", 0), ("plan_gate", "gate", "implement", "analyze", 2), ("implement", "loop", "", "", 0),
        ("verify_gate", "gate", "finalize", "implement", 3), ("finalize", "execute", "", "", 0),
    ),
    "debug": (
        ("reproduce", "execute", "", "", 0), ("locate", "execute", "", "", 0), ("fix", "loop", "", "", 0),
        ("verify_gate", "gate", "finalize", "fix", 3), ("finalize", "execute", "", "", 0),
    ),
    "refactor": (
        ("baseline", "execute", "", "", 0), ("analyze", "execute", "", "", 0), ("refactor", "loop", "", "", 0),
        ("verify_gate", "gate", "finalize", "refactor", 3), ("finalize", "execute", "", "", 0),
    ),
}
STATE = (
    "task_id string, protocol string, status string, current_phase string, n_events long, n_errors long, last_error string, "
    "reinit_count int, phases_json string"
)


def template(protocol: str) -> list[dict]:
    keys = ("id", "type", "on_pass", "on_fail", "max_retries")
    return [dict(zip(keys, p, strict=True), status="pending", retry_count=0, summary="", sub_tasks=[]) for p in PROTOCOLS[protocol]]


def custom_phases(phases) -> list[dict]:
    """Phases of a task's own: a list of objects, or its JSON."""
    given = json.loads(phases) if isinstance(phases, str) else phases
    out = []
    for p in given:
        if not isinstance(p, dict) or not p.get("id"):
            raise Refused("a phase needs an id")
        known = {"id": p["id"], "type": p.get("type") or "execute", "on_pass": p.get("on_pass", ""), "on_fail": p.get("on_fail", ""), "max_retries": int(p.get("max_retries") or 0)}
        if known["type"] not in ("execute", "gate", "loop"):
            raise Refused(f"no phase type {known['type']}")
        out.append(known | {"status": "pending", "retry_count": 0, "summary": "", "sub_tasks": []})
    if not out:
        raise Refused("no phases")
    return out


class Refused(Exception):
    """An event that the state doesn't admit."""


class TaskChain:
    """State of one task; every method is one transition and raises ``Refused`` where it isn't admitted."""

    def __init__(self, protocol: str = "develop", phases: list[dict] | None = None):
        self.protocol, self.phases = protocol, copy.deepcopy(phases) if phases else template(protocol)
        self.status, self.current, self.reinits = "running", "", 0

    def phase(self, name: str) -> dict:
        for p in self.phases:
            if p["id"] == name:
                return p
        raise Refused(f"no phase {name}")

    def _expect(self, p: dict, status: str, kind: str | None = None) -> None:
        if kind and p["type"] != kind:
            raise Refused(f"{p['id']} is {p['type']}, not {kind}")
        if p["status"] != status:
            raise Refused(f"{p['id']} is {p['status']}, not {status}")

    def following(self, name: str) -> str:
        """The first pending phase behind ``name``."""
        at = next((i for i, p in enumerate(self.phases) if p["id"] == name), len(self.phases))
        return next((p["id"] for p in self.phases[at + 1 :] if p["status"] == "pending"), "")

    def start(self, name: str) -> None:
        p = self.phase(name)
        self._expect(p, "pending")
        p["status"], self.current = "active", name

    def complete(self, name: str, summary: str = "") -> str:
        p = self.phase(name)
        self._expect(p, "active", "execute")
        p["status"], p["summary"] = "passed", summary
        return self.following(name)

    def gate(self, name: str, result: str, summary: str = "") -> str:
        p = self.phase(name)
        self._expect(p, "active", "gate")
        p["summary"] = summary
        if result == "pass":
            p["status"] = "passed"
            return p["on_pass"] or self.following(name)
        p["retry_count"] += 1
        if p["retry_count"] >= (p["max_retries"] if p["max_retries"] > 0 else 3):
            p["status"] = self.status = "failed"
            raise Refused(f"{name} failed {p['retry_count']} times")
        p["status"] = "pending"
        back = next((x for x in self.phases if p["on_fail"] and x["id"] == p["on_fail"]), None)
        if back is None:
            return ""
        back["status"], back["summary"] = "pending", ""
        return back["id"]

    def spawn(self, name: str, subs: list[dict]) -> None:
        p = self.phase(name)
        self._expect(p, "active", "loop")
        for i, s in enumerate(subs, len(p["sub_tasks"]) + 1):
            p["sub_tasks"].append({"id": s.get("id") or f"sub_{i:03d}", "name": s.get("name", ""), "verify": s.get("verify", ""), "status": s.get("status") or "pending", "summary": ""})
        self._advance(p)

    def _advance(self, p: dict) -> None:
        waiting = next((s for s in p["sub_tasks"] if s["status"] == "pending"), None)
        if waiting:
            waiting["status"] = "active"

    def complete_sub(self, name: str, sub: str, result: str = "pass", summary: str = "") -> bool:
        p = self.phase(name)
        s = next((x for x in p["sub_tasks"] if x["id"] == sub), None)
        if s is None:
            raise Refused(f"no sub-task {sub}")
        if s["status"] != "active":
            raise Refused(f"{sub} is {s['status']}, not active")
        s["status"], s["summary"] = ("passed" if result == "pass" else "failed"), summary
        if any(x["status"] in ("pending", "active") for x in p["sub_tasks"]):
            self._advance(p)
            return False
        p["status"], p["summary"] = "passed", summary  # even if some of them failed
        self.finish()
        return True

    def finished(self) -> bool:
        return all(p["status"] not in ("pending", "active") for p in self.phases)

    def finish(self) -> None:
        if self.status == "running" and self.finished():
            self.status = "finished"

    def reinit(self) -> None:
        if self.reinits >= 1:
            raise Refused("initialised twice already")
        count, own = self.reinits + 1, None if self.protocol in PROTOCOLS else [{k: p[k] for k in ("id", "type", "on_pass", "on_fail", "max_retries")} for p in self.phases]
        self.__init__(self.protocol, own and custom_phases(own))
        self.reinits = count

    def apply(self, kind: str, phase: str | None, sub: str | None, payload: dict) -> None:
        """One event; without a phase it goes to the current one, or the next pending one."""
        active = next((p["id"] for p in self.phases if p["status"] == "active"), "")
        pending = next((p["id"] for p in self.phases if p["status"] == "pending"), "")
        if kind == "init":
            return self.reinit()
        if self.status != "running":
            raise Refused(f"chain is {self.status}")
        if kind == "start":
            return self.start(phase or pending)
        if kind == "spawn":
            return self.spawn(phase or active, payload.get("sub_tasks", []))
        if kind == "complete_sub":
            p = self.phase(phase or active)
            sub = sub or next((s["id"] for s in p["sub_tasks"] if s["status"] == "active"), "")
            self.complete_sub(p["id"], sub, payload.get("result", "pass"), payload.get("summary", ""))
            return None
        if kind in ("complete", "pass", "fail"):
            p = self.phase(phase or active)
            if p["type"] == "gate":
                self.gate(p["id"], "pass" if kind == "pass" else payload.get("result", kind), payload.get("summary", ""))
            elif p["type"] == "loop" and not p["sub_tasks"]:
                self._expect(p, "active")
                p["status"] = "passed"
            else:
                self.complete(p["id"], payload.get("summary", ""))
            return self.finish()
        raise Refused(f"unknown event {kind}")


def _row(task: str, chain: TaskChain, events: int, errors: int, last: str) -> tuple:
    return (task, chain.protocol, chain.status, chain.current, events, errors, last, chain.reinits, json.dumps(chain.phases, ensure_ascii=False))


class Fold:
    """Running state of one task over its events in order."""

    def __init__(self, task: str, protocol: str):
        self.task, self.chain, self.events, self.errors, self.last = task, TaskChain(protocol), 0, 0, ""

    def add(self, kind, phase, sub, payload) -> None:
        """One event. A first ``init`` may name its own protocol or list its own phases."""
        self.events += 1
        try:
            said = json.loads(payload) if isinstance(payload, str) and payload else {}
            if kind == "init" and self.events == 1 and (said.get("protocol") or said.get("phases")):
                self.chain = TaskChain(said.get("protocol") or "custom", custom_phases(said["phases"]) if said.get("phases") else None)
            else:
                self.chain.apply(kind, phase or None, sub or None, said)
        except (Refused, ValueError, KeyError, AttributeError, TypeError) as e:
            self.errors, self.last = self.errors + 1, str(e)

    def row(self) -> tuple:
        return _row(self.task, self.chain, self.events, self.errors, self.last)

    @classmethod
    def resumed(cls, row: tuple) -> Fold:
        """The state that ``row()`` gave."""
        task, protocol, status, current, events, errors, last, reinits, phases = row
        fold = cls(task, "linear")
        fold.chain = TaskChain(protocol, json.loads(phases))
        fold.chain.status, fold.chain.current, fold.chain.reinits = status, current, reinits
        fold.events, fold.errors, fold.last = events, errors, last
        return fold


def advance(held: DataFrame, events: DataFrame, protocol: str = "develop") -> DataFrame:
    """The state of the tasks of ``events`` after them, from the state that ``held`` (STATE and last_event) has of them.

    Events whose id isn't above the task's last one are left out, so events that
    are given twice count once. A task's state is the first of its sorted rows;
    the fold streams over them.
    """
    for c in ("phase_id", "sub_id", "payload"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    given = events.where("task_id is not null").select("task_id", F.lit(1).alias("turn"), "created_at", "id", F.struct("event_type", "phase_id", "sub_id", "payload").alias("event"), F.lit(None).cast("string").alias("state"))
    names = [f.split()[0] for f in STATE.split(", ")]
    state = F.to_json(F.array(*[F.col(c).cast("string") for c in names]), {"ignoreNullFields": "false"})
    old = held.join(given.select("task_id").distinct(), "task_id", "left_semi").select("task_id", F.lit(0).alias("turn"), F.lit(None).cast("timestamp").alias("created_at"), F.col("last_event").alias("id"), F.lit(None).cast("struct<event_type:string,phase_id:string,sub_id:string,payload:string>").alias("event"), state.alias("state"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold: Fold | None = None
        newest = -(2**63)
        for pdf in batches:
            done = []
            for task, turn, number, event, kept in pdf[["task_id", "turn", "id", "event", "state"]].itertuples(index=False):
                if fold is None or fold.task != task:
                    if fold is not None:
                        done.append((*fold.row(), newest))
                    fold, newest = Fold(task, protocol), -(2**63)
                if turn == 0:
                    got = json.loads(kept)
                    fold, newest = Fold.resumed((*got[:4], int(got[4]), int(got[5]), got[6], int(got[7]), got[8])), int(number)
                elif number > newest:
                    fold.add(event["event_type"], event["phase_id"], event["sub_id"], event["payload"])
                    newest = int(number)
            if done:
                yield pd.DataFrame(done, columns=[*names, "last_event"])
        if fold is not None:
            yield pd.DataFrame([(*fold.row(), newest)], columns=[*names, "last_event"])

    both = old.unionByName(given).repartition("task_id").sortWithinPartitions("task_id", "turn", "id")
    return both.select("task_id", "turn", "id", "event", "state").mapInPandas(run, f"{STATE}, last_event long")


def replay(events: DataFrame, protocol: str = "develop") -> DataFrame:
    """Final state of every task of ``events(id, task_id, event_type, created_at[, phase_id, sub_id, payload])``.

    Events are applied by time and id; what the state doesn't admit is counted, not raised.
    """
    for c in ("phase_id", "sub_id", "payload"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    columns = [f.split()[0] for f in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: Fold | None = None
        for pdf in batches:
            done = []
            for task, kind, phase, sub, payload in pdf[["task_id", "event_type", "phase_id", "sub_id", "payload"]].itertuples(index=False):
                if state is None or state.task != task:
                    if state is not None:
                        done.append(state.row())
                    state = Fold(task, protocol)
                state.add(kind, phase, sub, payload)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if state is not None:
            yield pd.DataFrame([state.row()], columns=columns)

    ordered = events.where("task_id is not null").repartition("task_id").sortWithinPartitions("task_id", "created_at", "id")
    return ordered.select("task_id", "event_type", "phase_id", "sub_id", "payload").mapInPandas(run, STATE)


def progress(chains: DataFrame, phases_schema: str) -> DataFrame:
    """(task_id, phase_id, done, total, all_done) from the phases column of stored chains."""
    p = chains.select("task_id", F.explode(F.from_json("phases_json", phases_schema)).alias("p"))
    closed = F.filter("p.sub_tasks", lambda s: s["status"].isin("passed", "failed"))
    return p.select("task_id", F.col("p.id").alias("phase_id"), F.size(closed).alias("done"), F.size("p.sub_tasks").alias("total"), F.forall("p.sub_tasks", lambda s: s["status"].isin("passed", "failed")).alias("all_done"))


def first_events(events: DataFrame, most: int = 50) -> DataFrame:
    """The first events of every task by id, with their place."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("id"))).where(F.col("place") <= most)


def by_update(chains: DataFrame, most: int = 20) -> DataFrame:
    """Chains last changed, latest first."""
    return chains.orderBy(F.desc("updated_at"), "task_id").limit(most)
