"""The engine: everything the operators offer over one project's index and memory."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import builds, schemas
from .durable import cut
from .functions import text as X
from .indexer import EDGES, NAMES, Refresh
from .operators import flow, grams, graph, ingest, memory, metrics, search, snapshot, taskchain
from .sources import files as source_files
from .sources import logs
from .sources.store import BUCKETS, Part, Store


#: Seconds for which an index counts as fresh.
FRESH_S = 300
# Bytes up to which an answer's text is given as it is.
SHOWN_BYTES = 2000


def _within(scope: str) -> str:
    """A scope as the beginning of paths; nothing for the whole tree."""
    parts = [x for x in scope.replace("\\", "/").split("/") if x not in ("", ".")]
    return "/".join([*parts, ""]) if parts else ""


class Engine:
    """Lazy DataFrames over versioned tables below ``root``; nothing is collected but single ids."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, threshold: int = ingest.THRESHOLD, budget: int = ingest.BUDGET):
        self.spark, self.store, self.threshold, self.budget = spark, Store(spark, root, buckets=buckets), threshold, budget

    # index -----------------------------------------------------------------
    def files(self) -> DataFrame:
        return self.store.read("files", schemas.FILES)

    def symbols(self) -> DataFrame:
        return self.store.read("symbols", schemas.SYMBOLS)

    def calls(self) -> DataFrame:
        return self.store.read("calls", schemas.CALLS)

    def edges(self) -> DataFrame:
        """The call graph, kept with the calls."""
        return self.store.read("edges", EDGES)

    def _upsert(self, name: str, schema: str, keys: list[str], rows: DataFrame, keep: tuple[str, ...] = (), marks: dict[str, int] | None = None) -> None:
        """New rows in place of those of equal keys; only the buckets of these keys are written."""
        rows = cut(rows.select(*[f.split()[0] for f in schema.split(", ")]).withColumn("bucket", self.store.bucket(*keys)))
        touched = self._buckets(rows)
        old = self.store.read(name, schema, touched).withColumn("bucket", self.store.bucket(*keys))
        self.store.commit({name: Part(ingest.upsert(old, rows, keys, keep), touched)} if touched else {}, marks)

    def project(self, path: str, extensions: tuple[str, ...] = (), ignored: tuple[str, ...] = ()) -> tuple[tuple[str, ...], tuple[str, ...], list[str]]:
        """(extensions, ignored directories, stacks) that hold for the tree at ``path``: what is given, its ignore file, its stacks."""
        return self._project(path, extensions, ignored)[:3]

    def _project(self, path: str, extensions: tuple[str, ...], ignored: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...], list[str], DataFrame]:
        """And the files of the tree, listed once."""
        rules = source_files.ignore_rules(source_files.root_text(self.spark, path, ".gitignore"))
        ignored = tuple(dict.fromkeys([*ignored, *source_files.ARCHIVED, *rules]))
        found = source_files.scan(self.spark, path, (), ignored)
        stacks, exts, own = source_files.detect_stack(found)
        chosen = extensions or tuple(e for e in dict.fromkeys([*exts, *source_files.LANGUAGES]) if e in source_files.LANGUAGES)
        wanted = found.where(F.lower("extension").isin(*chosen))
        return chosen, tuple(dict.fromkeys([*ignored, *own])), stacks, source_files.outside(wanted, tuple(own))

    def _listed(self, path: str, extensions: tuple[str, ...] = (), ignored: tuple[str, ...] = (), scope: str = "") -> DataFrame:
        """The files of the tree that belong to the index, or of one part of it."""
        found = self._project(path, extensions, ignored)[3]
        below = _within(scope)
        return found.where(F.col("file_path").startswith(below)) if below else found

    def ingest(
        self, path: str, extensions: tuple[str, ...] = (), scope: str = "", force_full: bool = False, ignored: tuple[str, ...] = (), timeout: float | None = None
    ) -> DataFrame:
        """Brings the index up to date with the tree at ``path``; gives the number of files by action.

        The tree's ignore file and the directories that its stacks make are left
        out. Contents are read once, only of files whose size or time changed,
        and parsed only where they changed. A scope leaves the rest of the index
        as it is. The three tables change together. After ``timeout`` seconds
        the jobs are cancelled and the index stays as it was.
        """
        began = time.time()
        self._note("running", path, scope, began)
        context, done = self.spark.sparkContext, threading.Event()
        outer = context.getLocalProperty("spark.jobGroup.id")
        group = outer or f"ingest-{uuid.uuid4().hex}"

        def watch() -> None:
            if not done.wait(timeout):
                while not done.wait(0.2):  # jobs that begin later are cancelled too
                    context.cancelJobGroup(group)

        if not outer:
            context.setJobGroup(group, f"ingest {path}", interruptOnCancel=True)
        if timeout:
            threading.Thread(target=watch, daemon=True).start()
        try:
            with builds.Heartbeat(self.store, group) as beat:
                counts = self._ingest(path, extensions, scope, force_full, ignored, began + timeout if timeout else None, beat)
        except Exception as e:
            self._note("failed", path, scope, began, error=str(e).splitlines()[0][:300])
            raise
        finally:
            done.set()
            if not outer:
                context._jsc.sc().clearJobGroup()
        self._note("ready", path, scope, began, counts=counts)
        return self.spark.createDataFrame(sorted(counts.items()), "action string, n long")

    def _note(self, status: str, path: str, scope: str, began: float, **more) -> None:
        """The state of the index, for ``index_status`` and ``fresh``."""
        self.store.put_text("_status.json", json.dumps({"status": status, "project_root": path, "scope": scope, "began": began, "at": time.time()} | more))

    def index_status(self) -> dict:
        """What the last ingest said, or its text if that can't be read; and the bytes of every table."""
        text, progress = self.store.get_text("_status.json"), self.store.get_text(builds.PROGRESS)
        out: dict = {"tables": self.store.sizes()} | ({"progress": json.loads(progress)} if progress else {})
        try:
            return out | ({"index_status": json.loads(text)} if text is not None else {"index_status_error": "no ingest yet"})
        except ValueError:
            return out | {"index_status_raw": text}

    def fresh(self, ttl: float = FRESH_S) -> bool:
        """Whether the index is usable and a whole ingest ended within ``ttl`` seconds."""
        state = self.index_status().get("index_status", {})
        return state.get("status") == "ready" and not state.get("scope") and time.time() - state.get("at", 0) <= ttl and not self.files().isEmpty()

    def ensure_fresh(self, path: str, ttl: float = FRESH_S, **options) -> bool:
        """Ingests unless the index is fresh; if a whole ingest fails, once more with the extensions of the tree's stacks alone. Whether it ingested."""
        if self.fresh(ttl):
            return False
        try:
            self.ingest(path, **options)
        except Exception:
            stacks = source_files.detect_stack(source_files.scan(self.spark, path))[1]
            self.ingest(path, tuple(e for e in stacks if e in source_files.LANGUAGES) or tuple(source_files.LANGUAGES), **{k: v for k, v in options.items() if k != "extensions"})
        return True

    def _ingest(self, path: str, extensions: tuple[str, ...], scope: str, force_full: bool, ignored: tuple[str, ...], until: float | None, beat: builds.Heartbeat) -> dict[str, int]:
        found = cut(self._listed(path, extensions, ignored, scope))
        step = Refresh(self.store, path, force_full, self.threshold, self.budget, until, beat.files)
        gone = ingest.deleted(step.old_files(), found)
        if below := _within(scope):
            gone = gone.where(F.col("file_path").startswith(below))
        return step.run(found, gone)

    def build(self, path: str, **options) -> builds.Build:
        """Begins an ``ingest`` in the background; one at a time."""
        return builds.start(self, path, **options)

    def refresh(self, path: str, paths: DataFrame, marks: dict[str, int] | None = None) -> dict[str, int]:
        """Brings the index up to date with the files that ``paths(path)`` names, gone ones included; the number of files by action."""
        named = cut(paths.select("path").where("path is not null").distinct())
        found = source_files.stats(named, path).where(F.col("extension").isin(*source_files.LANGUAGES))
        step = Refresh(self.store, path, threshold=self.threshold, budget=self.budget)
        gone = step.old_files().join(named.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        found = cut(found)
        return step.run(found, gone.join(found.select("file_path"), "file_path", "left_anti"), marks)

    def search(self, query: str, scope: str = "", kind: str = "", limit: int = 5) -> DataFrame:
        """The best symbols of the first tier with a hit. Names come from the index of their pairs, if the query has any; then only buckets with such names are read."""
        if not grams.usable(query):
            rows = self.symbols().join(self.files().select("file_id", "file_path"), "file_id")
            return search.tiered(search.of_type(search.in_scope(rows, scope), kind), query, limit)
        found = self._named(query)
        if not scope and not kind:  # names decide alone, so few symbols are looked up
            found = cut(search.tiered(found, query, limit).select("symbol_id", "file_id"))
        touched = self._buckets(found.select(F.pmod("file_id", F.lit(self.store.buckets)).cast("int").alias("bucket")))
        placed = self.store.read("files", schemas.FILES, touched).select("file_id", "file_path")
        own = self.store.read("symbols", schemas.SYMBOLS, touched).join(found.select("symbol_id"), "symbol_id", "left_semi").join(placed, "file_id")
        return search.tiered(search.of_type(search.in_scope(own, scope), kind), query, limit)

    def _buckets(self, rows: DataFrame) -> tuple[int, ...]:
        return tuple(sorted(r["bucket"] for r in rows.select("bucket").distinct().collect()))

    def _named(self, query: str) -> DataFrame:
        """(name, file_id, symbol_id) of all symbols whose name may answer ``query``."""
        asked = self.spark.createDataFrame([(x,) for x in grams.wanted(query)], "gram string")
        rows = self.store.read("grams", grams.TABLE, self._buckets(asked.select(self.store.bucket("gram").alias("bucket"))))
        names = cut(grams.candidates(rows, query).withColumn("bucket", self.store.bucket("name")))
        return cut(self.store.read("names", NAMES, self._buckets(names)).join(names.select("name"), "name", "left_semi"))

    def grep(self, root: str, pattern: str, scope: str = "", **options) -> DataFrame:
        """Matching lines of the tree with their owners; lines outside any symbol belong to ``(global)``."""
        found = source_files.contents(self._listed(root, scope=scope), root)
        texts = found.select(F.xxhash64("file_path").alias("file_id"), "file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        return search.owners(search.grep(texts, pattern, **options), self.symbols(), "left").withColumn("owner", F.coalesce("owner", F.lit("(global)")))

    def search_all(self, root: str, query: str, scope: str = "", kind: str = "") -> DataFrame:
        """(section, place, name, file_path, line, text): an exact definition, or else similar symbols and then lines of text with their owners.

        Lines are sought only without an exact definition: 20 at most, three a
        file of the first ten files, case aside, 80 characters of each.
        """
        rows = search.within(self.symbols().join(self.files().select("file_id", "file_path"), "file_id"), scope)
        hit = search.tiered(search.of_type(rows, "" if kind == "any" else kind), query)
        section = F.when(F.col("tier") == 0, "exact").otherwise("similar")
        symbols = hit.select(section.alias("section"), "place", "name", "file_path", F.col("line_start").alias("line"), F.col("match").alias("text"))
        if not hit.where("tier = 0").isEmpty():
            return symbols
        found = self.grep(root, query, scope, ignore_case=True, total=20)
        lines = search.shown_matches(found).select(F.lit("text").alias("section"), "place", F.col("owner").alias("name"), "file_path", "line", X.cut_chars(F.col("content"), 80).alias("text"))
        return symbols.unionByName(lines)

    def symbol_at(self, path: str, line: int) -> DataFrame:
        point = self.files().where(F.col("file_path") == path).select("file_id", F.lit(line).alias("line"))
        return search.owners(point, self.symbols())

    def _root(self, query: str) -> DataFrame:
        return graph.resolve(self.symbols(), query).select(F.col("symbol_id").alias("root"))

    def impact(self, symbol: str, direction: str = "backward") -> DataFrame:
        near = graph.reach(self.edges(), self._root(symbol), direction)
        return near.join(self.symbols().select(F.col("symbol_id").alias("node"), "name", "canonical_id"), "node")

    def risk(self, symbol: str, direction: str = "backward") -> DataFrame:
        return graph.impact(self.edges(), self._root(symbol), direction)

    def complexity(self) -> DataFrame:
        return graph.complexity(self.calls(), self.symbols())

    def project_map(self, scope: str = "", level: str = "symbols") -> DataFrame:
        rows = metrics.files_map(search.in_scope(self.files(), scope), self.symbols(), self.complexity())
        return metrics.directories(rows) if level == "structure" else metrics.top_per_directory(rows)

    def flow_trace(self, symbol: str = "", path: str = "", mode: str = "standard", max_nodes: int = 40) -> DataFrame:
        """Entries with scores; their neighbours come from ``impact``, cut by ``flow.budget``."""
        if symbol:
            roots = self._root(symbol)
        else:
            own = self.symbols().join(self.files().where(F.col("file_path") == path).select("file_id"), "file_id")
            roots = flow.candidates(own, mode).select(F.col("symbol_id").alias("root"))
        scored = flow.flow_scores(self.edges(), self.symbols(), self.calls(), roots)
        return flow.entries(scored, self.symbols(), mode).limit(flow.budget(max_nodes, mode))

    def flow_lists(self, symbol: str = "", path: str = "", direction: str = "both", mode: str = "standard", max_nodes: int = 40) -> DataFrame:
        """(root, direction, kind, place, node, name, of): the neighbours that a trace lists around its entries, nearest first.

        ``of`` counts all of a kind, so ``of`` less the rows listed are left out.
        """
        roots = self.flow_trace(symbol, path, mode, max_nodes).select("root")
        most = flow.budget(max_nodes, mode)
        out = None
        for d in ("backward", "forward") if direction == "both" else (direction,):
            near = graph.shown(graph.reach(self.edges(), roots, d), self.symbols(), most, most).withColumn("direction", F.lit(d))
            out = near if out is None else out.unionByName(near)
        return out.select("root", "direction", "kind", "place", "node", "name", "of")

    def checklist(self, symbol: str, direction: str = "backward") -> DataFrame:
        near = graph.reach(self.edges(), self._root(symbol), direction, depth=1)
        return graph.checklist(near, self.symbols(), self.files(), direction)

    def critical_paths(self, symbol: str) -> DataFrame:
        return flow.critical_paths(self.edges(), self.symbols(), self._root(symbol))

    def snapshot(self) -> DataFrame:
        return snapshot.snapshot(self.symbols(), self.calls(), self.files())

    def diff(self, base: DataFrame) -> DataFrame:
        return snapshot.diff(base, self.snapshot())

    def naming(self) -> DataFrame:
        return metrics.naming(self.symbols())

    def briefing(self, task: str, intent: str = "", read_only: bool = False, symbols: tuple[str, ...] = (), scope: str = "") -> DataFrame:
        """One row, the first step: what is asked, where it is anchored, what is known of it, how complex it is, what to mind.

        Its task_id names it for ``handoff``, the second step.
        """
        row = self.spark.createDataFrame([(f"analyze_{uuid.uuid4().hex[:12]}", task, intent, read_only, list(symbols))], "task_id string, task string, explicit string, read_only boolean, symbols array<string>")
        label = X.intent(F.col("task"), F.col("explicit"), F.col("read_only"))
        words = row.select(X.keywords(F.col("task"), F.col("symbols"))).first()[0]
        placed = self.symbols().join(self.files().select("file_id", "file_path"), "file_id")
        found = [r.asDict() for r in search.anchors(placed, list(symbols), scope).orderBy("place").select("query", "symbol_id", "name", "file_path").collect()]  # ten at most
        facts = [r["summarize"] for r in memory.recall_facts(self.facts(), " ".join(words), 10).collect()]
        top = metrics.highest(self.complexity(), list(symbols)).first()
        known = self.spark.createDataFrame(
            [(words, found, facts, float(top["score"]), top["level"], top["alerts"])],
            "keywords array<string>, anchors array<struct<query:string,symbol_id:long,name:string,file_path:string>>, facts array<string>, complexity double, level string, loud array<string>",
        )
        out = row.join(F.broadcast(known)).select(  # a row each
            "task_id", "task", X.cut_chars(F.col("task"), 300).alias("directive"), label.alias("intent"), "keywords", "anchors", "facts", "complexity", "level",
            X.guardrails(label, F.col("read_only")).alias("guardrails"), F.concat(X.alerts(F.col("task"), F.col("read_only")), "loud").alias("alerts"),
        )
        first = out.first()
        self.save_state(f"briefing:{first['task_id']}", json.dumps(first.asDict(recursive=True), ensure_ascii=False), "briefing")
        return self.spark.createDataFrame([first], out.schema)

    def handoff(self, task_id: str) -> dict:
        """The second step of a briefing: all of the first, and the order of work that follows from it. It can be had once."""
        kept = self.state(f"briefing:{task_id}").collect()
        if not kept:
            raise KeyError(f"no first step {task_id}")
        held = json.loads(kept[0]["value"])
        steps = ["read the anchors" if held["anchors"] else "search for where to begin"]
        steps += [f"heed {len(held['facts'])} known facts"] if held["facts"] else []
        steps += ["check the impact before any change"] if held["level"] == "High" or held["alerts"] else []
        steps += {"DEBUG": ["reproduce", "locate", "fix", "verify"], "REFACTOR": ["fix a baseline", "refactor", "verify"], "DESIGN": ["map the structure", "design"], "RESEARCH": ["map the structure", "report"]}.get(held["intent"], ["plan", "implement", "verify"])
        key = self.spark.createDataFrame([(f"briefing:{task_id}",)], "key string").withColumn("bucket", self.store.bucket("key"))
        touched = (key.first()["bucket"],)
        rows = self.store.read("system_state", schemas.STATE, touched).withColumn("bucket", self.store.bucket("key"))
        self.store.commit({"system_state": Part(rows.join(key.select("key"), "key", "left_anti"), touched)})
        return held | {"strategy": steps}

    # memory ----------------------------------------------------------------
    def memos(self) -> DataFrame:
        return self.store.read("memos", schemas.MEMOS)

    def facts(self) -> DataFrame:
        return self.store.read("known_facts", schemas.FACTS)

    def hooks(self, status: str = "open", now: Column | None = None) -> DataFrame:
        return memory.hooks(self.store.read("pending_hooks", schemas.HOOKS), status, now)

    def _next(self, rows: DataFrame) -> int:
        """An id above all others, by time, so that two writers don't meet."""
        return max((rows.agg(F.max("id")).first()[0] or 0) + 1, time.time_ns() // 1000)

    def append_memos(self, items: list[dict], now=None) -> None:
        """Adds memos; missing categories, entities and acts get defaults. One session id for all of them."""
        first, session = self._next(self.memos()), uuid.uuid4().hex[:8]
        rows = [(first + i, *[x.get(k) or "" for k in ("category", "entity", "act", "path", "content")]) for i, x in enumerate(items)]
        df = self.spark.createDataFrame(rows, "id long, category string, entity string, act string, path string, content string")
        entity = F.coalesce(F.when(~F.col("entity").isin("", "-"), F.col("entity")), F.when(F.col("content") != "", X.cut_chars(F.substring_index("content", "\n", 1), 40)), F.lit("System"))
        df = df.withColumns({"category": X.fallback(F.col("category"), F.lit("开发")), "entity": entity, "act": X.fallback(F.col("act"), F.lit("-")), "session_id": F.lit(session), "timestamp": F.lit(now).cast("timestamp") if now else F.current_timestamp()})
        self.store.append("memos", df, schemas.MEMOS)

    def append_fact(self, kind: str, text: str) -> None:
        df = self.spark.createDataFrame([(self._next(self.facts()), kind, text)], "id long, type string, summarize string").withColumn("created_at", F.current_timestamp())
        self.store.append("known_facts", df, schemas.FACTS)

    def append_hook(self, description: str, priority: str = "medium", tag: str = "", task_id: str = "", hours: int = 0) -> str:
        hook = f"hook_{uuid.uuid4().hex[:5]}"
        df = self.spark.createDataFrame([(hook, description, priority, task_id, tag, hours)], "hook_id string, description string, priority string, related_task_id string, tag string, hours int")
        none = F.lit(None).cast("string")
        df = df.withColumns({"created_at": F.current_timestamp(), "status": F.lit("open"), "context": none, "result_summary": none, "summary": none})
        self._upsert("pending_hooks", schemas.HOOKS, ["hook_id"], df.withColumn("expires_at", memory.expiry(F.col("created_at"), F.col("hours"))))
        return hook

    def release_hook(self, hook_id: str, summary: str = "") -> None:
        mine = self.store.read("pending_hooks", schemas.HOOKS).where(F.col("hook_id") == hook_id)
        self._upsert("pending_hooks", schemas.HOOKS, ["hook_id"], mine.withColumns({"status": F.lit("closed"), "result_summary": F.lit(summary)}))

    def recall(self, keywords: str, category: str = "", limit: int = 20) -> DataFrame:
        return memory.recall_report(self.memos(), self.facts(), keywords, category, limit)

    def timeline(self, **options) -> DataFrame:
        return memory.timeline(self.memos(), **options)

    def save_state(self, key: str, value: str, category: str = "") -> None:
        new = self.spark.createDataFrame([(key, value, category)], "key string, value string, category string").withColumn("updated_at", F.current_timestamp())
        self._upsert("system_state", schemas.STATE, ["key"], new)

    def state(self, key: str) -> DataFrame:
        return self.store.read("system_state", schemas.STATE).where(F.col("key") == key)

    def save_task(self, task_id: str, description: str, **more: str) -> None:
        """Makes a task, or changes the fields given; the time of its making stays."""
        names = [f.split()[0] for f in schemas.TASKS.split(", ") if f.endswith("string")]
        if unknown := set(more) - set(names):
            raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")
        said = {"task_id": task_id, "description": description} | more
        old = self.task(task_id).select(*names).collect()
        row = (old[0].asDict() if old else {"status": "pending"} | dict.fromkeys(n for n in names if n != "status")) | said
        df = self.spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} string" for n in names))
        ended = F.when(F.col("status").isin("completed", "failed"), F.current_timestamp())
        df = df.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "completed_at": ended})
        self._upsert("tasks", schemas.TASKS, ["task_id"], df, keep=("created_at",))

    def task(self, task_id: str) -> DataFrame:
        """One task, from the bucket of its id."""
        key = self.spark.createDataFrame([(task_id,)], "task_id string").select(self.store.bucket("task_id").alias("bucket"))
        return self.store.read("tasks", schemas.TASKS, self._buckets(key)).where(F.col("task_id") == task_id)

    def tasks(self, keywords: str = "", limit: int = 20) -> DataFrame:
        """Tasks last changed, with any of the words in their description or summary."""
        return memory.recall_tasks(self.store.read("tasks", schemas.TASKS), keywords, limit)

    def personas(self, *libraries: str) -> DataFrame:
        """All personas: the project's own first, then those of the libraries, earlier ones first."""
        return logs.listed(ingest.overlay(self.store.read("personas", logs.PERSONA), logs.read_personas(self.spark, list(libraries)), "name"))

    def save_persona(self, name: str, **fields) -> None:
        """Makes a persona of the project's own, or changes one; it covers a library's of that name."""
        if not name.strip() or not str(fields.get("hard_directive", "")).strip():
            raise ValueError("a persona needs a name and a directive")
        kinds = dict(f.split() for f in logs.PERSONA.split(", "))
        row = {"name": name.strip(), "display_name": fields.get("display_name") or name.strip()} | {k: v for k, v in fields.items() if k != "display_name"}
        self._upsert("personas", logs.PERSONA, ["name"], self.spark.createDataFrame([tuple(row.get(k) for k in kinds)], logs.PERSONA))

    def drop_persona(self, name: str) -> bool:
        """Whether the project had a persona of its own of that name; it is gone then."""
        key = self.spark.createDataFrame([(name,)], "name string").withColumn("bucket", self.store.bucket("name"))
        touched = self._buckets(key)
        rows = self.store.read("personas", logs.PERSONA, touched)
        if rows.where(F.col("name") == name).isEmpty():
            return False
        self.store.commit({"personas": Part(rows.where(F.col("name") != name).withColumn("bucket", self.store.bucket("name")), touched)})
        return True

    def activate_persona(self, key: str, *libraries: str) -> dict:
        """Notes the persona that a name, display name or alias means as the active one; for an unknown key the names that there are."""
        found = logs.persona(self.personas(*libraries), key).collect()
        if not found:
            return {"found": False, "names": [r["name"] for r in self.personas(*libraries).select("name").limit(100).collect()]}
        self.save_state("active_persona", found[0]["name"], "persona")
        return {"found": True} | found[0].asDict(recursive=True)

    def shown(self, name: str, text: str, most: int = SHOWN_BYTES) -> str:
        """An answer's text; one of more than ``most`` bytes goes to a file of the store, whose path the answer then is."""
        if len(text.encode()) <= most:
            return text
        self.store.put_text(f"_shown/{name}", text)
        return f"{self.store.root}/_shown/{name}"

    def archive(self, path: str) -> None:
        logs.append_archive(self.memos(), path)

    def append_chain_events(self, events: DataFrame) -> None:
        self.store.append("task_chain_events", events, schemas.CHAIN_EVENTS)

    def chain_events(self) -> DataFrame:
        return self.store.read("task_chain_events", schemas.CHAIN_EVENTS)

    def task_chains(self, protocol: str = "develop") -> DataFrame:
        """The state of every task; a task whose first event is an ``init`` with a protocol or phases goes by these."""
        return taskchain.replay(self.chain_events(), protocol)

    def save_chains(self, protocol: str = "develop") -> None:
        """Writes the state of all tasks to ``task_chains``; the time of their making stays."""
        times = self.chain_events().groupBy("task_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.max("id").alias("last_event"))
        rows = self.task_chains(protocol).join(times, "task_id").withColumn("description", F.lit(None).cast("string"))
        self._upsert("task_chains", schemas.CHAINS, ["task_id"], rows, keep=("description", "created_at"))

    def chains(self) -> DataFrame:
        return self.store.read("task_chains", schemas.CHAINS)

    def advance_chains(self, events: DataFrame, protocol: str = "develop", marks: dict[str, int] | None = None) -> None:
        """Writes the state of the tasks of ``events`` through to ``task_chains``, from what it holds of them; other tasks aren't touched."""
        events = cut(events.where("task_id is not null"))
        touched = self._buckets(events.select(self.store.bucket("task_id").alias("bucket")))
        times = events.groupBy("task_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
        new = taskchain.advance(self.store.read("task_chains", schemas.CHAINS, touched), events, protocol)
        self._upsert("task_chains", schemas.CHAINS, ["task_id"], new.join(times, "task_id").withColumn("description", F.lit(None).cast("string")), ("description", "created_at"), marks)

    def delete_chains(self, *task_ids: str) -> None:
        """Tasks go with their events, together."""
        gone = self.spark.createDataFrame([(x,) for x in task_ids], "task_id string").withColumn("bucket", self.store.bucket("task_id"))
        touched = tuple(sorted({r["bucket"] for r in gone.collect()}))
        chains = self.store.read("task_chains", schemas.CHAINS, touched).withColumn("bucket", self.store.bucket("task_id"))
        self.store.commit({"task_chain_events": ingest.without_tasks(self.chain_events(), gone), "task_chains": Part(ingest.without_tasks(chains, gone), touched)})

    # skills ----------------------------------------------------------------
    def skill(self, root: str, name: str, resource: str = "") -> dict:
        """A catalog entry: its text and resources, or one resource; for an unknown name the names that hold it."""
        catalog = logs.read_catalog(self.spark, root)
        own = catalog.where(F.col("name") == name).limit(1).collect()
        if not own:
            near = logs.listed(catalog.where(F.lower("name").contains(name.lower()))).select("name").limit(20).collect()
            return {"found": False, "suggestions": [r["name"] for r in near]}
        folder = own[0]["path"].rsplit("/", 1)[0]
        if resource:
            return {"found": True, "name": name} | logs.read_resource(self.spark, folder, resource)
        text = self.spark.read.text(own[0]["path"], wholetext=True).select(F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*\n", "")).first()[0]
        entry = folder.rsplit("/", 1)[-1]
        parts = {r["kind"]: r["files"] for r in logs.resources(self.spark, root).where(F.col("entry") == entry).collect()}
        return {"found": True, "name": name, "description": own[0]["description"], "text": text, "resources": parts}
