"""One registered query per operator, on the views of the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut
from ..functions import text as X
from ..operators import flow, graph, ingest, memory, metrics, search, snapshot, taskchain
from ..streaming import jobs
from . import views as V

#: Symbol whose impact is asked for, names that are searched for, and fixed times.
ROOT, NAME = 3, "the_red"
NOW = "2024-07-01 00:00:00"


def _linked(s: SparkSession, d: str) -> DataFrame:
    return graph.link_calls(V.calls(s, d), V.symbols(s, d))


def _edges(s: SparkSession, d: str) -> DataFrame:
    """The call graph, made once for a query."""
    return cut(graph.build_edges(_linked(s, d)))


def _roots(s: SparkSession, *ids: int) -> DataFrame:
    return s.createDataFrame([(i,) for i in (ids or (ROOT,))], "root long")


def _scores(s: SparkSession, d: str) -> DataFrame:
    return graph.complexity(_linked(s, d), V.symbols(s, d))


def _name(s: SparkSession, d: str) -> str:
    """The name of symbol 3, as a search word."""
    return V.symbols(s, d).where(F.col("symbol_id") == ROOT).select("name").first()[0]


_SHOWN = ("symbol_id", "name", "symbol_type", "line_start")


def symbol_exact(s, d):
    return search.exact(V.symbols(s, d), _name(s, d)).select(*_SHOWN)


def symbol_prefix_suffix(s, d):
    return search.prefix_suffix(V.symbols(s, d), _name(s, d)[:4]).select(*_SHOWN)


def symbol_substring(s, d):
    return search.substring(V.symbols(s, d), _name(s, d)[1:5]).select(*_SHOWN)


def symbol_levenshtein(s, d):
    return search.close(V.symbols(s, d), _name(s, d)[:-1] + "x").orderBy("distance", "symbol_id").limit(5).select("symbol_id", "name", "distance", F.col("score").cast("double").alias("score"))


def symbol_stem(s, d):
    return search.stem(V.symbols(s, d), _name(s, d)).select(*_SHOWN)


def _tier_rows(s, d, query):
    return search.tiered(V.symbols(s, d), query).select("symbol_id", "name", "tier", "match", F.col("score").cast("double").alias("score"))


def symbol_search_tiered(s, d):
    """Five searches, one for each tier."""
    n = _name(s, d)
    out = None
    for i, q in enumerate((n, n[:4], n[1:6], n[:-2] + "zx", n[:4] + "qqqqqqq")):
        rows = _tier_rows(s, d, q).withColumn("query", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def search_scope_type(s, d):
    rows = V.symbols(s, d).join(V.files(s, d).select("file_id", "file_path"), "file_id")
    hit = search.of_type(search.in_scope(search.substring(rows, _name(s, d)[:3]), "src1"), "function")
    return hit.select("symbol_id", "name", "file_path")


def symbol_at_line(s, d):
    points = V.files(s, d).select("file_id", F.lit(40).alias("line"))
    return search.owners(points, V.symbols(s, d))


def grep_lines(s, d):
    found = search.grep(V.text_files(s, d), "tion", exclude=("*.md",), per_file=5)
    return found.select("file_id", "line", F.length("content").cast("long").alias("n_chars"))


def grep_shown(s, d):
    return search.shown_matches(search.grep(V.text_files(s, d), "tion", ignore_case=True)).select("file_path", "line", "place")


def text_owner(s, d):
    found = search.grep(V.text_files(s, d), "tion").select("file_id", "line")
    return search.owners(found, V.symbols(s, d), how="left").withColumn("owner", F.coalesce("owner", F.lit("(global)")))


def link_calls(s, d):
    return _linked(s, d).groupBy("caller_id", "callee_name", "callee_id").agg(F.count("*").alias("n"))


def unresolved_calls(s, d):
    """Calls without a definition, those whose link to an odd symbol is lost among them, and the namesakes they reach."""
    open_ = graph.link_calls(V.calls(s, d), V.symbols(s, d)).withColumn("callee_id", F.when(F.col("callee_id") % 2 == 0, F.col("callee_id")))
    return graph.expand_unresolved(open_, V.symbols(s, d))


def callers_of(s, d):
    return graph.callers_of(_linked(s, d), V.symbols(s, d), ROOT, _name(s, d)).select("caller_id", "name", "call_line")


def impact_backward(s, d):
    return graph.reach(_edges(s, d), _roots(s), "backward").select(F.col("node").alias("symbol_id"), "hop", "edge_count")


def impact_forward(s, d):
    return graph.reach(_edges(s, d), _roots(s), "forward").select(F.col("node").alias("symbol_id"), "hop", "edge_count")


def impact_both(s, d):
    return graph.reach(_edges(s, d), _roots(s), "both").select(F.col("node").alias("symbol_id"), "hop", "direction")


def impact_risk(s, d):
    roots = _roots(s, *range(0, 40))
    return graph.impact(_edges(s, d), roots)


def resolve_symbol(s, d):
    n = _name(s, d)
    return graph.resolve(V.symbols(s, d), n).select("symbol_id", "name", "tier").unionByName(graph.resolve(V.symbols(s, d), n[1:5]).select("symbol_id", "name", "tier"))


def fan_in_out(s, d):
    return graph.degrees(_linked(s, d), V.symbols(s, d))


def complexity_score(s, d):
    return _scores(s, d).withColumn("level", X.complexity_level(F.col("score")))


def complexity_buckets(s, d):
    return metrics.complexity_buckets(_scores(s, d))


def _files_map(s, d):
    return metrics.files_map(V.files(s, d), V.symbols(s, d), _scores(s, d))


def project_map_files(s, d):
    return _files_map(s, d)


def project_map_dirs(s, d):
    return metrics.directories(_files_map(s, d))


def dir_rollup(s, d):
    return metrics.roll_up(_files_map(s, d))


def dir_levels(s, d):
    return metrics.adaptive_levels(metrics.roll_up(_files_map(s, d))).select("dir", "depth", "place")


def map_top_per_dir(s, d):
    return metrics.top_per_directory(_files_map(s, d)).select("dir", "file_path", "place", "shown")


def map_symbols_ranked(s, d):
    return metrics.ranked_symbols(V.symbols(s, d), _scores(s, d)).select("file_id", "symbol_id", "score", "place")


def dir_structure(s, d):
    return V.files(s, d).groupBy(X.directory(F.col("file_path")).alias("dir")).agg(F.count("*").alias("n_files"))


def extensions(s, d):
    return V.files(s, d).select(X.extension(F.col("file_path")).alias("extension"), "language").distinct()


def naming_style(s, d):
    return metrics.naming(V.symbols(s, d))


def naming_prefixes(s, d):
    return metrics.common_prefixes(V.symbols(s, d))


def flow_edges(s, d):
    return flow.edge_classes(_edges(s, d), V.symbols(s, d))


def flow_score(s, d):
    linked = cut(_linked(s, d))
    return flow.flow_scores(cut(graph.build_edges(linked)), V.symbols(s, d), linked, _roots(s, *range(0, 40)))


def flow_entries(s, d):
    sym = V.symbols(s, d)
    picked = flow.candidates(sym, "deep").select(F.col("symbol_id").alias("root"))
    linked = cut(_linked(s, d))
    scored = flow.flow_scores(cut(graph.build_edges(linked)), sym, linked, picked)
    return flow.entries(scored, sym, "deep").select("root", "ext_in", "b_dir", "b_ind", "flow_score", "line_start")


def flow_labels(s, d):
    """Side effects and stages of some calls, judged by texts that do hold the words."""
    return V.facts(s, d).select("id", F.concat_ws(",", X.side_effects(F.concat_ws(" ", "type", "summarize", F.lit("read_file http url exec")))).alias("side_effects"), F.concat_ws(",", X.stages(F.col("summarize"))).alias("stages"))


def flow_related(s, d):
    roots = _roots(s, *range(0, 20))
    near = graph.reach(cut(graph.edges_at(V.calls(s, d), V.symbols(s, d), roots)), roots, "both", depth=1).select("root", "direction", F.col("node").alias("symbol_id"))
    return flow.labels(V.symbols(s, d), near, V.files(s, d))


def critical_paths(s, d):
    roots = _roots(s, *range(0, 20))
    return flow.critical_paths(cut(graph.edges_at(V.calls(s, d), V.symbols(s, d), roots)), V.symbols(s, d), roots)


def _shot(s, d, target):
    sym = V.snapshot_symbols(s, d, target)
    return snapshot.snapshot(sym, V.calls(s, d).where("call_line < 7") if target else V.calls(s, d), V.files(s, d))


def snapshot_table(s, d):
    return snapshot.snapshot(V.symbols(s, d), V.calls(s, d), V.files(s, d)).select("canonical_id", "name", "symbol_type", "line_start", F.size("calls").cast("long").alias("n_calls"))


def snapshot_diff(s, d):
    return snapshot.diff(_shot(s, d, False), _shot(s, d, True))


def ingest_classify(s, d):
    return ingest.classify(V.files(s, d), V.stored_files(s, d)).select("file_id", "action")


def ingest_counters(s, d):
    return ingest.counters(ingest.classify(V.files(s, d), V.stored_files(s, d)))


def ingest_budget(s, d):
    rows = ingest.classify(V.files(s, d), V.stored_files(s, d))
    return ingest.budgeted(rows, initial=True, threshold=100, budget=50).groupBy("action").agg(F.count("*").alias("n"))


def ingest_merge(s, d):
    changed = ingest.classify(V.files(s, d), V.stored_files(s, d)).where("action in ('new', 'parse')").drop("action")
    kept = ingest.deleted(V.stored_files(s, d), V.files(s, d)).select("file_path")
    live = V.stored_files(s, d).join(kept, "file_path", "left_anti")
    return ingest.upsert(live, changed, ["file_path"]).select("file_id", "file_path", "file_hash", "file_mtime")


def ingest_replace_children(s, d):
    changed = ingest.classify(V.files(s, d), V.stored_files(s, d)).where("action = 'parse'").select("file_id")
    sym = V.symbols(s, d).select("symbol_id", "file_id")
    fresh = sym.join(changed, "file_id", "left_semi").withColumn("symbol_id", F.col("symbol_id") + 1_000_000).select("symbol_id", "file_id")
    return ingest.replace_children(sym, fresh, changed, "file_id")


def ingest_deleted(s, d):
    return ingest.deleted(V.stored_files(s, d), V.files(s, d)).select("file_id", "file_path")


def dup_content(s, d):
    return ingest.equal_contents(V.files(s, d))


def recall_memos(s, d):
    return memory.recall_memos(V.memos(s, d), "1,2 error", "purchase", 20).select("id", "category", "entity")


def recall_chat(s, d):
    return memory.recall_memos(V.chat_memos(s, d), "tion, que", limit=50).select("id", "category", "entity")


def recall_facts(s, d):
    return memory.recall_facts(V.facts(s, d), "the er", 15).select("id", "type")


def recall_report(s, d):
    return memory.recall_report(V.memos(s, d), V.facts(s, d), "a", limit=10).select("section", "id", "kind")


def timeline(s, d):
    last = V.memos(s, d).agg(F.max("timestamp")).first()[0]
    return memory.timeline(V.memos(s, d), days=7, text="user_1", now=F.lit(last)).select("id", "category", F.col("day").cast("string").alias("day"))


def timeline_counts(s, d):
    return memory.category_counts(V.memos(s, d), known=("view", "click", "purchase"), other="other")


def hooks_open(s, d):
    rows = V.memos(s, d).select(
        F.concat(F.lit("hook_"), F.lower(F.hex(F.col("id").bitwiseAND(0xFFFFF)))).alias("hook_id"),
        F.when(F.col("category") == "error", "released").otherwise("open").alias("status"),
        F.col("timestamp").alias("created_at"),
        memory.expiry(F.col("timestamp"), (F.col("id") % 48).cast("int")).alias("expires_at"),
    )
    now = rows.agg(F.max("created_at")).first()[0]
    return memory.hooks(rows, "open", F.lit(now)).select("hook_id", "expired")


def intent_classify(s, d):
    """Requests with a word of work in the midst of what is said; the word goes by the text's length, as invented prose has none."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("fix it", "refactor", "analysis", "design", "none", "add feature update", "migrate")]), (F.length("content") % 7 + 1).cast("int"))
    half = (F.length("content") / 2).cast("int")
    text = F.concat(F.substring("content", F.lit(1), half), F.lit(" "), word, F.lit(" "), F.substring("content", half + 1, F.length("content")))
    rows = V.chat_memos(s, d).select("id", text.alias("t"), (F.col("category") == "user").alias("ro"), F.when(F.col("content").contains("\n"), "reflect").otherwise("").alias("e"))
    label = X.intent(F.col("t"), F.col("e"), F.col("ro"))
    return rows.select(
        "id", label.alias("intent"), F.concat_ws(",", X.alerts(F.col("t"), F.col("ro"))).alias("alerts"), F.concat_ws(",", X.guardrails(label, F.col("ro"))).alias("guardrails")
    )


def keyword_extract(s, d):
    return V.facts(s, d).select("id", F.concat_ws(",", X.ascii_keywords(F.col("summarize"))).alias("keywords"))


def text_heads(s, d):
    t = F.col("summarize")
    return V.facts(s, d).select("id", X.cut_chars(t, 20).alias("cut"), X.sentence_head(t).alias("head"), F.size(X.tokens(t)).cast("long").alias("n_tokens"))


def path_parts(s, d):
    p = F.col("file_path")
    return V.files(s, d).select("file_id", X.directory(p).alias("dir"), X.base_name(p).alias("base"), X.extension(p).alias("extension"), F.size(X.prefixes(p)).cast("long").alias("depth"), "line_count")


def task_chain_state(s, d):
    return taskchain.replay(V.chain_events(s, d)).select("task_id", "status", "current_phase", "n_events", "n_errors", "reinit_count", "phases_json")


def chain_event_counts(s, d):
    return V.chain_events(s, d).groupBy("task_id", "event_type").agg(F.count("*").alias("n"))


def latest_state(s, d):
    rows = V.memos(s, d).select(F.col("entity").alias("key"), F.col("content").alias("value"), "category", F.col("timestamp").alias("updated_at"), "id")
    return ingest.last_written(rows, "key", ["updated_at", "id"]).select("key", "value", "category")


def _catalog(s, d, mod, level):
    rows = V.facts(s, d).where(F.col("id") % mod == 0)
    return rows.select(F.col("id").alias("key"), F.concat(F.lit(level), F.col("id").cast("string")).alias("value"))


def overlay_merge(s, d):
    return ingest.overlay(_catalog(s, d, 2, "base"), _catalog(s, d, 3, "over"), "key")


def catalog_precedence(s, d):
    return ingest.by_precedence([_catalog(s, d, 1, "install"), _catalog(s, d, 2, "home"), _catalog(s, d, 3, "project")], "key")


def random_walk_coverage(s, d):
    return graph.random_walks(_edges(s, d), ROOT)


def page_tag_outline(s, d):
    pages = V.table(s, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >]"), 1).alias("tags"))
    return pages.select("page_id", F.explode("tags").alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def integrity_references(s, d):
    """Calls whose definition is unknown, by name."""
    refs = V.calls(s, d).select(F.col("callee_name").alias("name")).distinct()
    broken, unused = ingest.broken_references(V.symbols(s, d).select("name").distinct(), refs, "name")
    return broken.withColumn("problem", F.lit("broken")).unionByName(unused.withColumn("problem", F.lit("unreferenced")))


def integrity_unique(s, d):
    return ingest.repeated_keys(V.symbols(s, d), ["file_id", "name"])


def log_projection(s, d):
    return memory.log_lines(V.memos(s, d))


def box_overlaps(s, d):
    boxes = V.symbols(s, d).select(
        "file_id", F.col("symbol_id").alias("id"), (F.col("line_start") * 1.0).alias("left"), (F.col("symbol_id") % 3 * 1.0).alias("top"),
        (F.col("line_end") - F.col("line_start")).cast("double").alias("width"), F.lit(1.5).alias("height"),
    )
    return memory.overlaps(boxes, "file_id")


QUERIES = {f.__name__: f for f in (
    symbol_exact, symbol_prefix_suffix, symbol_substring, symbol_levenshtein, symbol_stem, symbol_search_tiered, search_scope_type, symbol_at_line,
    grep_lines, grep_shown, text_owner, link_calls, unresolved_calls, callers_of, impact_backward, impact_forward, impact_both, impact_risk, resolve_symbol,
    fan_in_out, complexity_score, complexity_buckets, project_map_files, project_map_dirs, dir_rollup, dir_levels, map_top_per_dir, map_symbols_ranked,
    dir_structure, extensions, naming_style, naming_prefixes, flow_edges, flow_score, flow_entries, flow_labels, flow_related, critical_paths, snapshot_diff,
    ingest_classify, ingest_counters, ingest_budget, ingest_merge, ingest_replace_children, ingest_deleted, dup_content, recall_memos, recall_chat, recall_facts,
    recall_report, timeline, timeline_counts, hooks_open, intent_classify, keyword_extract, text_heads, path_parts, task_chain_state, chain_event_counts,
    latest_state, overlay_merge, catalog_precedence, random_walk_coverage, page_tag_outline, integrity_references, integrity_unique, log_projection, box_overlaps,
)} | {"snapshot": snapshot_table} | jobs.QUERIES
