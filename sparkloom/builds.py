"""Index builds in the background, and the progress of any build.

A build has a job group and a scheduler pool of its own, so queries run beside
it and it can be cancelled alone. One build at a time holds a small file that
only one writer can make; it is renewed while the build lives, and one that
isn't renewed for ``STALE_S`` seconds is taken over. Tables change by the
commit at a build's end, so one that is killed leaves the index as it was.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark import InheritableThread

from .sources.store import Store

LOCK, PROGRESS = "_building.json", "_progress.json"
#: Seconds after which a build that doesn't renew its lock counts as dead.
STALE_S = 120.0
#: Files after which progress is written anew.
EVERY = 10


class Busy(RuntimeError):
    """Another build is under way."""


class Heartbeat:
    """Writes how many files a build has read of how many, from the tasks that its jobs have ended."""

    def __init__(self, store: Store, group: str, every: int = EVERY, pause: float = 0.2):
        self.store, self.group, self.every, self.pause = store, group, every, pause
        self.done = self.total = self.written = 0
        self.first_job = None
        self.over = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def __enter__(self) -> Heartbeat:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        if self.total:
            self._write()

    def files(self, done: int, total: int) -> None:
        """``total`` files are about to be read, or ``done`` of them are."""
        if not done:
            self.first_job = max(self._jobs(), default=-1) + 1
        self.done, self.total = done, total
        self._write()

    def _jobs(self) -> list[int]:
        return list(self.store.spark.sparkContext.statusTracker().getJobIdsForGroup(self.group))

    def _write(self) -> None:
        self.written = self.done
        self.store.put_text(PROGRESS, json.dumps({"timestamp": int(time.time()), "processed": self.done, "total": self.total}))

    def _run(self) -> None:
        tracker = self.store.spark.sparkContext.statusTracker()
        while not self.over.wait(self.pause):
            if self.first_job is None or self.done >= self.total:
                continue
            share = 0.0
            for job in (j for j in self._jobs() if j >= self.first_job):
                info = tracker.getJobInfo(job)
                stages = [s for i in (info.stageIds if info else []) if (s := tracker.getStageInfo(i)) and s.numTasks]
                share = max([share, *(s.numCompletedTasks / s.numTasks for s in stages[-1:])])  # the last stage reads
            self.done = max(self.done, min(self.total - 1, int(self.total * share)))
            if self.done >= self.written + self.every:
                self._write()


class Build:
    """An ``ingest`` of ``engine`` in a thread of its own; see ``start``."""

    def __init__(self, engine, path: str, options: dict, pool: str):
        self.engine, self.path, self.options, self.pool = engine, path, options, pool
        self.id, self.error, self.counts = f"build-{uuid.uuid4().hex}", None, None
        self.thread = InheritableThread(target=self._run, daemon=True)

    def _run(self) -> None:
        context = self.engine.spark.sparkContext
        context.setJobGroup(self.id, f"build {self.path}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", self.pool)
        over = threading.Event()
        threading.Thread(target=self._renew, args=(over,), daemon=True).start()
        try:
            rows = self.engine.ingest(self.path, **self.options)
            self.counts = {r["action"]: r["n"] for r in rows.collect()}
        except Exception as e:
            self.error = e
        finally:
            over.set()
            if (held := _lock(self.engine.store)) and held.get("id") == self.id:
                self.engine.store.drop_text(LOCK)

    def _renew(self, over: threading.Event) -> None:
        while not over.wait(STALE_S / 4):
            self.engine.store.put_text(LOCK, json.dumps({"id": self.id, "path": self.path, "at": time.time()}))

    def cancel(self) -> None:
        """Stops the build's jobs, those that begin later too; the index stays as it was."""

        def stop() -> None:
            while self.thread.is_alive():
                self.engine.spark.sparkContext.cancelJobGroup(self.id)
                self.thread.join(0.1)

        threading.Thread(target=stop, daemon=True).start()

    def wait(self, timeout: float | None = None) -> bool:
        """Whether the build has ended, within ``timeout`` seconds; an error of the build is raised."""
        self.thread.join(timeout)
        if self.thread.is_alive():
            return False
        if self.error:
            raise self.error
        return True


def _lock(store: Store) -> dict | None:
    try:
        return json.loads(store.get_text(LOCK) or "null")
    except ValueError:
        return {}


def start(engine, path: str, pool: str = "builds", **options) -> Build:
    """Begins an ingest of the tree at ``path`` in the background; raises ``Busy`` while another one lives."""
    build, store = Build(engine, path, options, pool), engine.store
    mine = json.dumps({"id": build.id, "path": path, "at": time.time()})
    if not store.make_text(LOCK, mine):
        held = _lock(store)
        if held and time.time() - held.get("at", 0) <= STALE_S:
            raise Busy(f"{held['id']} builds {held.get('path')}")
        store.drop_text(LOCK)
        if not store.make_text(LOCK, mine):
            raise Busy("another build began just now")
    build.thread.start()
    return build
