"""Further registered queries, each with its SQL: finer predicates, rankings, labels, checks of documents and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut
from ..functions import text as X
from ..operators import grams, graph, ingest, memory, metrics, search, snapshot, taskchain
from ..sources import logs, results
from . import oracles as O
from . import views as V
from .queries import ROOT, _edges, _files_map, _linked, _name, _roots, _scores


def _of(value: Column, *choices: Column) -> Column:
    """The choice that ``value`` counts off."""
    return F.element_at(F.array(*choices), (F.pmod(value, F.lit(len(choices))) + 1).cast("int"))


def path_suffix(s, d):
    return search.under_path(V.files(s, d), "7.txt").select("file_id", "file_path")


def scope_contains(s, d):
    return search.within(V.files(s, d), "/en\\doc_1").select("file_id", "file_path")


def name_ignore_case(s, d):
    return search.same_name(V.symbols(s, d), _name(s, d).upper()).select("symbol_id", "name")


def _asked(s, d) -> list[str]:
    """Some names as a request gives them: of another case, qualified, repeated, unknown."""
    rows = {r.symbol_id: r for r in V.symbols(s, d).where("symbol_id in (3, 5, 7)").select("symbol_id", "name", "qualified_name").collect()}
    return [rows[3].name, rows[3].name.upper(), rows[7].qualified_name, rows[5].name, rows[3].name, "nowhere"]


def briefing_anchors(s, d):
    placed = V.symbols(s, d).join(V.files(s, d).select("file_id", "file_path"), "file_id")
    return search.anchors(placed, _asked(s, d)).select("place", "query", "symbol_id", "name")


def complexity_highest(s, d):
    return metrics.highest(_scores(s, d), _asked(s, d)).select("score", "level")


def complexity_top(s, d):
    return metrics.most_complex(_scores(s, d)).select("name", "score")


def counts_scoped(s, d):
    return metrics.counts(search.in_scope(V.files(s, d), "src1"), V.symbols(s, d))


def dir_children(s, d):
    return metrics.children_by_mean(metrics.roll_up(_files_map(s, d))).select("parent", "dir", "place")


def symbol_search_indexed(s, d):
    """The five searches of ``symbol_search_tiered``, by the index of names: only symbols of the names that it lets pass are ranked."""
    symbols, n = V.symbols(s, d), _name(s, d)
    index = cut(grams.table(symbols.select("name").distinct()))
    out = None
    for i, q in enumerate((n, n[:4], n[1:6], n[:-2] + "zx", n[:4] + "qqqqqqq")):
        rows = search.tiered(symbols.join(grams.candidates(index, q), "name", "left_semi"), q)
        rows = rows.select("symbol_id", "name", "tier", "match", F.col("score").cast("double").alias("score"), F.lit(i).alias("query"))
        out = rows if out is None else out.unionByName(rows)
    return out


def recall_tasks(s, d):
    rows = memory.recall_tasks(V.tasks(s, d), "urgent, customer 7", 40)
    return rows.select("task_id", "description", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


def recent_tasks(s, d):
    return memory.recall_tasks(V.tasks(s, d), limit=30).select("task_id", "summary")


def match_records(s, d):
    """Lines with a word, as a search tool reports them among other messages, read back from its JSON."""
    found = search.grep(V.text_files(s, d), "tion")
    at = F.instr("content", "tion") - 1
    sub = F.array(F.struct(F.struct(F.lit("tion").alias("text")).alias("match"), at.cast("int").alias("start"), (at + 4).cast("int").alias("end")))
    data = F.struct(F.struct(F.replace("file_path", F.lit("/"), F.lit("\\")).alias("text")).alias("path"), F.struct(F.concat("content", F.lit("\r\n")).alias("text")).alias("lines"), F.col("line").alias("line_number"), sub.alias("submatches"))
    said = lambda kind: found.select(F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data"))).alias("value"))
    every = said("match").unionByName(said("context")).unionByName(found.select(F.col("content").alias("value")))
    got = every.select(results.matches(F.col("value")).alias("m")).where("m is not null")
    return got.select("m.file_path", "m.line", F.length("m.content").cast("long").alias("n_chars"), F.get("m.spans", F.lit(0)).alias("first"), F.size("m.spans").alias("n_ends"))


def map_tree(s, d):
    return metrics.adaptive_tree(metrics.roll_up(_files_map(s, d))).select("dir", "depth", "place", "of")


def impact_shown(s, d):
    near = graph.reach(_edges(s, d), _roots(s, *range(0, 20)), "backward")
    return graph.shown(near, V.symbols(s, d)).select("root", "kind", "node", "place", "of")


def impact_checklist(s, d):
    near = graph.reach(cut(graph.edges_at(V.calls(s, d), V.symbols(s, d), _roots(s))), _roots(s), "backward", depth=1)
    return graph.checklist(near, V.symbols(s, d), V.files(s, d))


def score_levels(s, d):
    deg = graph.degrees(_linked(s, d), V.symbols(s, d))
    score = graph.complexity_score((F.col("symbol_id") % 150).cast("double"), F.col("fan_out").cast("double"), F.col("fan_in").cast("double"))
    return deg.select("symbol_id", score.alias("score"), graph.score_level(score).alias("level"))


def catalog_sorted(s, d):
    rows = V.facts(s, d).select(F.concat(F.lit("entry_"), F.col("id").cast("string")).alias("name"), "type")
    return logs.listed(rows, 30).select("name", "type")


def catalog_rules(s, d):
    """Names of parts, in the four ways that they can be written, with their kinds as descriptions."""
    name = F.col("p_name")
    forms = F.array(F.replace(name, F.lit(" "), F.lit("-")), name, F.replace("p_brand", F.lit("#"), F.lit("--")), F.repeat(F.replace(name, F.lit(" "), F.lit("")), F.lit(6)), F.concat(F.lit("-"), F.lower("p_type")), F.trim(F.replace(name, F.substring_index(name, " ", 1), F.lit(""))))
    rows = V.table(s, d, "part").select("p_partkey", F.posexplode(forms).alias("form", "name"), F.when(F.col("p_size") < 10, "").when(F.col("p_size") > 40, F.concat(F.lit("<"), "p_type", F.lit(">"))).otherwise(F.col("p_type")).alias("description"))
    return logs.valid_entries(rows).select("p_partkey", "form", "name", "problem")


def chain_first_events(s, d):
    return taskchain.first_events(V.chain_events(s, d), 3).select("task_id", "id", "place")


def chain_by_update(s, d):
    chains = V.chain_events(s, d).groupBy("task_id").agg(F.max("created_at").alias("updated_at"), F.count("*").alias("n_events"))
    return taskchain.by_update(chains).select("task_id", "n_events")


def chain_delete(s, d):
    events = V.chain_events(s, d)
    gone = events.where(F.substring_index("task_id", "_", -1).cast("long") % 3 == 0).select("task_id")
    return ingest.without_tasks(events, gone).groupBy("task_id").agg(F.count("*").alias("n"))


def chain_progress(s, d):
    """Progress of chains whose phases are written from the events: a sub-task for each of the five kinds."""
    states = F.create_map(*[F.lit(x) for kv in {"start": "active", "complete": "passed", "pass": "passed", "fail": "failed", "init": "pending"}.items() for x in kv])
    subs = V.chain_events(s, d).groupBy("task_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    sub = F.transform("kinds", lambda k: F.struct(k.alias("id"), k.alias("name"), F.lit("").alias("verify"), F.element_at(states, k).alias("status"), F.lit("").alias("summary")))
    phase = F.struct(F.lit("implement").alias("id"), F.lit("loop").alias("type"), F.lit("active").alias("status"), sub.alias("sub_tasks"))
    from ..schemas import PHASES

    return taskchain.progress(subs.select("task_id", F.to_json(F.array(phase)).alias("phases_json")), PHASES)


def union_distinct(s, d):
    f = V.files(s, d)
    ext = X.extension(F.col("file_path"))
    joined = X.union_distinct(F.array("language", F.concat(F.lit("."), ext)), F.array(F.lit(""), ext, F.lit("go"), F.col("language")))
    return f.select("file_id", F.array_join(joined, ",").alias("items"))


def _json_texts(s, d):
    """What events hold: an object, a list with the object in it, or neither, as the event's kind goes; and what conversations say."""
    kind, props = F.col("category"), F.col("content")
    listed = F.concat(F.lit("["), props, F.lit(', "'), kind, F.lit('"]'))
    text = F.when(kind.isin("view", "signup"), props).when(kind == "click", listed).when(kind == "error", F.concat(F.lit('["'), "entity", F.lit('"]'))).otherwise(F.concat(kind, F.lit(" "), props))
    said = V.chat_memos(s, d).select((-F.col("id") - 1).alias("id"), "content")
    return V.memos(s, d).select("id", text.alias("content")).unionByName(said)


def json_lists(s, d):
    got = X.json_list(F.col("content"))
    return _json_texts(s, d).select("id", F.size(got).alias("n"), F.get(got, F.lit(0)).alias("first"), F.get(got, F.lit(1)).alias("second"))


def json_or_raw(s, d):
    got = _json_texts(s, d).select("id", X.json_or_raw(F.col("content")).alias("j"))
    return got.select("id", F.element_at("j.held", F.lit("k")).alias("k"), F.col("j.raw").alias("raw"))


#: Steps of work as events stand for them.
_STEP_OF = {"view": "快速浏览结构", "click": "搜索函数", "purchase": "谁调用了它的依赖", "error": "核对 map 文件", "signup": "会影响哪些"}


def _steps(s, d):
    """An event's step and what it holds; and all that conversations and pages say."""
    word = F.element_at(F.create_map(*[F.lit(x) for kv in _STEP_OF.items() for x in kv]), F.col("category"))
    steps = V.memos(s, d).select(F.lit("event").alias("of"), "id", F.concat(word, F.lit(" "), "content").alias("t"))
    said = V.chat_memos(s, d).select(F.lit("turn").alias("of"), "id", F.col("content").alias("t"))
    pages = V.table(s, d, "pages").select(F.lit("page").alias("of"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    return steps.unionByName(said).unionByName(pages)


def step_hints(s, d):
    """The hint that each text gets, and how long it is with it."""
    rows = _steps(s, d).withColumn("step", X.step_hint(F.col("t")))
    return rows.select("of", "id", F.substring("step", F.length("t") + 1, F.length("step")).alias("hint"), F.length("step").cast("long").alias("n_chars"))


def _time_texts() -> Column:
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return _of(F.col("id"), *[F.date_format("timestamp", f) for f in forms], F.lit("nonsense"), F.lit(""))


def times_parsed(s, d):
    parsed = X.parsed_time(_time_texts(), F.to_timestamp(F.lit("2024-07-01 00:00:00")))
    return V.memos(s, d).select("id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("time"))


def times_normalised(s, d):
    return V.memos(s, d).select("id", X.normalised_time(_time_texts()).alias("time"))


_HAN = " 修复登录模块的报错 x 重构 缓存, 修复登录 单 设计系统架构"


def keywords_han(s, d):
    return V.facts(s, d).select("id", F.concat_ws(",", X.han_keywords(F.concat("summarize", F.lit(_HAN)))).alias("keywords"))


def keywords_assembled(s, d):
    symbols = F.array(F.concat(F.lit("sym_"), (F.col("id") % 5).cast("string")), F.lit("缓存"), F.lit("sym_0"))
    return V.facts(s, d).select("id", F.concat_ws(",", X.keywords(F.concat("summarize", F.lit(_HAN)), symbols)).alias("keywords"))


def uri_paths(s, d):
    head = _of(F.col("file_id"), F.lit("file:///C:/my%20dir/"), F.lit("file:///home/a%2Bb/"), F.lit("/plain/"))
    return V.files(s, d).select("file_id", X.uri_path(F.concat(head, "file_path")).alias("path"))


def bytes_cut(s, d):
    return V.facts(s, d).select("id", X.cut_bytes(F.concat(_of(F.col("id"), F.lit("é"), F.lit("登录"), F.lit("")), F.col("summarize")), 5).alias("cut"))


def qa_scores(s, d):
    said = _of(F.col("id"), F.concat(F.lit(" "), F.col("category")), F.lit("else"), F.lit(None).cast("string"), F.col("category"))
    rows = V.memos(s, d).select(F.col("category").alias("expected"), said.alias("answer"), (F.col("id") % 8).cast("double").alias("seconds"), (F.col("id") % 5).alias("tool_calls"))
    return memory.qa_scores(rows)


def tool_durations(s, d):
    rows = V.memos(s, d).select(F.col("category").alias("tool"), (F.col("id") % 16).cast("double").alias("seconds"))
    return memory.tool_durations(rows)


def last_tag(s, d):
    return V.table(s, d, "pages").select("page_id", F.length(memory.last_tag(F.col("html"), "p")).cast("long").alias("n_chars"))


def banded_rows(s, d):
    boxes = V.symbols(s, d).select("file_id", F.col("symbol_id").alias("id"), (F.col("symbol_id") % 7 * 1.0).alias("left"), (F.col("line_start") % 13 * 0.2).alias("top"))
    return memory.banded_order(boxes, "file_id")


def _cells(s, d) -> DataFrame:
    value = _of(F.col("symbol_id"), F.lit("#REF! and #N/A"), F.col("name"), F.lit("=A1+1"), F.lit("see #N/A"), F.lit("=B2"), F.lit("#DIV/0!"))
    return V.symbols(s, d).select(F.concat(F.lit("s"), F.col("file_id").cast("string")).alias("sheet"), F.concat(F.lit("A"), F.col("symbol_id").cast("string")).alias("cell"), value.alias("value"))


def sheet_errors(s, d):
    return memory.sheet_errors(_cells(s, d)).select("error", "n", F.array_join("locations", ",").alias("locations"))


def sheet_formulas(s, d):
    return memory.formula_count(_cells(s, d))


def relationship_checks(s, d):
    """Definitions as declared relationships of their file, calls as elements that use them."""
    declared = V.symbols(s, d).select(F.col("file_id").alias("file"), F.col("name").alias("rid"), F.concat(F.lit("http://types/"), "symbol_type").alias("type"))
    callers = V.symbols(s, d).select(F.col("symbol_id").alias("caller_id"), F.col("file_id").alias("file"))
    used = V.calls(s, d).join(callers, "caller_id").select("file", _of(F.col("call_line"), F.lit("new"), F.lit("call"), F.lit("any")).alias("element"), F.col("callee_name").alias("rid"))
    return ingest.relationship_problems(declared, used, {"new": "Class", "call": "function"})


def content_types(s, d):
    f = V.files(s, d)
    parts = f.select(F.when(F.col("file_id") % 4 == 0, F.concat("file_path", F.lit(".XML"))).when(F.col("file_id") % 4 == 1, F.concat("file_path", F.lit(".png"))).otherwise(F.col("file_path")).alias("path"))
    named = f.where("file_id % 3 = 0").select(F.concat(F.lit("/"), "file_path").alias("path"))
    return ingest.undeclared_parts(parts, named, s.createDataFrame([("xml",), ("PNG",)], "extension string"))


def grep_regex(s, d):
    found = search.grep(V.text_files(s, d), "[0-9]+\\.[0-9]+|http", regex=True, ignore_case=True, include=("*1.txt", "*2.txt"))
    return found.select("file_id", "line", F.length("content").cast("long").alias("n_chars"))


def snapshot_written(s, d):
    """A snapshot written as JSON and read back."""
    made = snapshot.snapshot(V.symbols(s, d), V.calls(s, d), V.files(s, d))
    got = results.read_snapshot(s, results.write_result(made, results.fresh_folder(s)))
    return got.select("canonical_id", "name", "symbol_type", "line_start", F.size("calls").cast("long").alias("n_calls"))


QUERIES = {f.__name__: f for f in (
    symbol_search_indexed, recall_tasks, recent_tasks, match_records, map_tree, path_suffix, scope_contains, name_ignore_case, briefing_anchors, complexity_highest, complexity_top, counts_scoped, dir_children, impact_shown, impact_checklist,
    score_levels, catalog_sorted, catalog_rules, chain_first_events, chain_by_update, chain_delete, chain_progress, union_distinct, json_lists, json_or_raw, step_hints,
    times_parsed, times_normalised, keywords_han, keywords_assembled, uri_paths, bytes_cut, qa_scores, tool_durations, last_tag, banded_rows, sheet_errors,
    sheet_formulas, relationship_checks, content_types, grep_regex, snapshot_written,
)}


def _pick(value: str, *choices: str) -> str:
    return f"CASE {value} % {len(choices)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


_ASKED = """asked AS (
  SELECT q, row_number() OVER (ORDER BY min(i)) - 1 AS place FROM (
    SELECT 0 AS i, name AS q FROM symbols WHERE symbol_id = 3 UNION ALL SELECT 1, upper(name) FROM symbols WHERE symbol_id = 3 UNION ALL SELECT 2, qualified_name FROM symbols WHERE symbol_id = 7
    UNION ALL SELECT 3, name FROM symbols WHERE symbol_id = 5 UNION ALL SELECT 5, 'nowhere') GROUP BY q
)"""
_TIME = _pick("id", "strftime(timestamp, '%Y-%m-%d %H:%M:%S')", "strftime(timestamp, '%Y-%m-%dT%H:%M:%S')", "strftime(timestamp, '%Y-%m-%d')", "'nonsense'", "''")
_FIRSTS = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_HAN_RUNS = "list_transform(regexp_extract_all({t}, '[\\p{{Han}}]{{2,}}'), lambda x: left(x, 4))"
_ASCII = "list_filter(regexp_extract_all({t}, '[A-Za-z0-9_./-]+'), lambda x: length(x) BETWEEN 3 AND 40 AND lower(x) NOT IN ('http', 'https'))"
_JSON = """json_texts AS (
  SELECT id, CASE WHEN category IN ('view', 'signup') THEN content WHEN category = 'click' THEN '[' || content || ', "' || category || '"]' WHEN category = 'error' THEN '["' || entity || '"]' ELSE category || ' ' || content END AS t FROM memos
  UNION ALL SELECT -id - 1, content FROM chat_memos
)"""
_CELL = _pick("symbol_id", "'#REF! and #N/A'", "name", "'=A1+1'", "'see #N/A'", "'=B2'", "'#DIV/0!'")
_STEP_SQL = f"""steps AS (
  SELECT 'event' AS of, id, CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STEP_OF.items())} END || ' ' || content AS t FROM memos
  UNION ALL SELECT 'turn', id, content FROM chat_memos UNION ALL SELECT 'page', page_id, html FROM pages
), hinted AS (
  SELECT *, CASE WHEN regexp_matches(l, '扫描|map|结构') THEN CASE WHEN regexp_matches(l, '核对|审核|对比|对齐') THEN ' (用 full 模式查看完整代码)' WHEN regexp_matches(l, '浏览|快速') THEN ' (用 overview 模式)' ELSE ' (用 standard 模式)' END
    WHEN regexp_matches(l, '搜索|定位|查找') AND regexp_matches(l, '函数|类') THEN ' (设置 search_type=function)'
    WHEN regexp_matches(l, '影响|依赖') AND regexp_matches(l, '谁调用了|被哪里') THEN ' (设置 direction=backward)'
    WHEN regexp_matches(l, '影响|依赖') AND regexp_matches(l, '调用了谁|会影响') THEN ' (设置 direction=forward)' ELSE '' END AS hint
  FROM (SELECT *, lower(t) AS l FROM steps)
)"""

ORACLES = {
    "symbol_search_indexed": O.ORACLES["symbol_search_tiered"],
    "recall_tasks": O._with(
        "SELECT task_id, description, strftime(updated_at, '%Y-%m-%d') AS day FROM tasks WHERE " + " OR ".join(f"{c} ILIKE '%{w}%'" for w in ("urgent", "customer", "7") for c in ("description", "summary")) + " ORDER BY updated_at DESC, task_id LIMIT 40"
    ),
    "recent_tasks": O._with("SELECT task_id, summary FROM tasks ORDER BY updated_at DESC, task_id LIMIT 30"),
    "match_records": O._with(
        "SELECT file_path, CAST(line AS BIGINT) AS line, length(t) AS n_chars, CAST(instr(t, 'tion') - 1 AS INTEGER) AS first, 2 AS n_ends FROM (SELECT file_path, line, trim(content, ' ') AS t FROM lines WHERE contains(content, 'tion'))"
    ),
    "map_tree": O._with(
        """SELECT dir, CAST(depth AS INTEGER) AS depth, CAST(place AS INTEGER) AS place, of FROM kids WHERE depth = 1 AND place <= CASE WHEN of <= 20 THEN 20 WHEN of <= 40 THEN 25 ELSE 20 END
UNION ALL
SELECT k.dir, CAST(k.depth AS INTEGER), CAST(k.place AS INTEGER), k.of FROM kids k JOIN kids p ON p.dir = k.parent WHERE k.depth = 2 AND p.place <= CASE WHEN p.of <= 20 THEN 20 WHEN p.of <= 40 THEN 18 ELSE 12 END
  AND k.place <= CASE WHEN p.place <= CASE WHEN p.of <= 20 THEN 20 WHEN p.of <= 40 THEN 8 ELSE 6 END THEN 100 ELSE 3 END""",
        O._ROLLED + """, kids AS (
  SELECT *, row_number() OVER (PARTITION BY parent ORDER BY round(CASE WHEN n_symbols > 0 THEN sum_score / n_symbols ELSE 0 END, 6) DESC, dir) AS place, count(*) OVER (PARTITION BY parent) AS of
  FROM (SELECT *, CASE WHEN depth = 1 THEN '.' ELSE regexp_replace(dir, '/[^/]*$', '') END AS parent FROM rolled WHERE depth > 0)
)""",
    ),
    "path_suffix": O._with("SELECT file_id, file_path FROM files WHERE file_path LIKE '%7.txt'"),
    "scope_contains": O._with("SELECT file_id, file_path FROM files WHERE contains(file_path, '/en/doc_1')"),
    "name_ignore_case": O._with(f"SELECT symbol_id, name FROM symbols WHERE lower(name) = lower({O._Q}) OR lower(qualified_name) = lower({O._Q})"),
    "briefing_anchors": O._with(
        """SELECT CAST(place AS INTEGER) AS place, q AS query, symbol_id, name FROM (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY name <> q, symbol_id) AS k FROM asked JOIN symbols ON lower(name) = lower(q) OR lower(qualified_name) = lower(q)
) WHERE k = 1""",
        _ASKED,
    ),
    "complexity_highest": O._with(
        "SELECT score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END AS level FROM (SELECT CAST(coalesce(max(score), 0) AS DOUBLE) AS score FROM complexity WHERE name IN (SELECT q FROM asked))", _ASKED
    ),
    "complexity_top": O._with("SELECT name, CAST(score AS DOUBLE) AS score FROM complexity ORDER BY score DESC, name LIMIT 5"),
    "counts_scoped": O._with(
        "SELECT (SELECT count(*) FROM files WHERE starts_with(file_path, 'src1')) AS n_files, (SELECT count(*) FROM symbols WHERE file_id IN (SELECT file_id FROM files WHERE starts_with(file_path, 'src1'))) AS n_symbols"
    ),
    "dir_children": O._with(
        """SELECT parent, dir, CAST(row_number() OVER (PARTITION BY parent ORDER BY round(CASE WHEN n_symbols > 0 THEN sum_score / n_symbols ELSE 0 END, 6) DESC, dir) AS INTEGER) AS place
FROM (SELECT *, CASE WHEN depth = 1 THEN '.' ELSE regexp_replace(dir, '/[^/]*$', '') END AS parent FROM rolled WHERE depth > 0)""",
        O._ROLLED,
    ),
    "impact_shown": O._with(
        """SELECT root, kind, node, CAST(place AS INTEGER) AS place, of FROM (
  SELECT *, row_number() OVER (PARTITION BY root, kind ORDER BY hop, node) AS place, count(*) OVER (PARTITION BY root, kind) AS of
  FROM (SELECT *, CASE WHEN hop = 1 THEN 'direct' ELSE 'indirect' END AS kind FROM hops)
) WHERE place <= CASE WHEN kind = 'direct' THEN 10 ELSE 20 END""",
        O._reach("dst", "src", O._ROOTS20),
    ),
    "impact_checklist": O._with(
        """SELECT CAST(3 AS BIGINT) AS root, 0 AS place, 'Target: ' || qualified_name || ' (' || file_path || ')' AS line FROM symbols JOIN files USING (file_id) WHERE symbol_id = 3 AND EXISTS (SELECT 1 FROM edges WHERE dst = 3)
UNION ALL SELECT 3, CAST(row_number() OVER (ORDER BY symbol_id) AS INTEGER), 'Check Caller: ' || symbol_type || ':' || name || ' (' || file_path || ')' FROM symbols JOIN files USING (file_id) WHERE symbol_id IN (SELECT src FROM edges WHERE dst = 3)"""
    ),
    "score_levels": O._with(
        "SELECT symbol_id, score, CASE WHEN score < 20 THEN 'Simple' WHEN score < 50 THEN 'Medium' WHEN score < 80 THEN 'High' ELSE 'Extreme' END AS level FROM (SELECT symbol_id, CAST(least(100.0, 0.5 * (symbol_id % 150) + 2.0 * fan_out + fan_in) AS DOUBLE) AS score FROM fan)"
    ),
    "catalog_sorted": O._with("SELECT 'entry_' || id AS name, type FROM facts ORDER BY name LIMIT 30"),
    "catalog_rules": """WITH forms AS (
  SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5]) AS form,
    unnest([replace(p_name, ' ', '-'), p_name, replace(p_brand, '#', '--'), repeat(replace(p_name, ' ', ''), 6), '-' || lower(p_type), trim(replace(p_name, split_part(p_name, ' ', 1), ''))]) AS name,
    CASE WHEN p_size < 10 THEN '' WHEN p_size > 40 THEN '<' || p_type || '>' ELSE p_type END AS description FROM part
)
SELECT p_partkey, CAST(form AS INTEGER) AS form, name, CASE WHEN name = '' THEN 'name missing' WHEN NOT regexp_full_match(name, '[a-z0-9-]+') THEN 'name not hyphenated'
  WHEN starts_with(name, '-') OR ends_with(name, '-') OR contains(name, '--') THEN 'hyphens misplaced' WHEN length(name) > 64 THEN 'name too long'
  WHEN description = '' THEN 'description missing' WHEN regexp_matches(description, '[<>]') THEN 'description holds brackets' END AS problem
FROM forms""",
    "chain_first_events": O._with("SELECT task_id, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY id) AS place FROM chain_events) WHERE place <= 3"),
    "chain_by_update": O._with("SELECT task_id, n_events FROM (SELECT task_id, max(created_at) AS t, count(*) AS n_events FROM chain_events GROUP BY 1) ORDER BY t DESC, task_id LIMIT 20"),
    "chain_delete": O._with("SELECT task_id, count(*) AS n FROM chain_events WHERE CAST(split_part(task_id, '_', 2) AS BIGINT) % 3 <> 0 GROUP BY 1"),
    "chain_progress": O._with(
        "SELECT task_id, 'implement' AS phase_id, CAST(count(*) FILTER (event_type IN ('complete', 'pass', 'fail')) AS INTEGER) AS done, CAST(count(*) AS INTEGER) AS total, bool_and(event_type IN ('complete', 'pass', 'fail')) AS all_done FROM (SELECT DISTINCT task_id, event_type FROM chain_events) GROUP BY 1"
    ),
    "union_distinct": O._with("SELECT file_id, language || ',txt,go' AS items FROM files"),
    "json_lists": O._with(
        "SELECT id, CASE WHEN ok THEN CAST(json_array_length(t) AS INTEGER) END AS n, CASE WHEN ok THEN e0 END AS first, CASE WHEN ok THEN e1 END AS second FROM (SELECT *, starts_with(trim(t), '[') AND json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t ->> '$[0]' END AS e0, CASE WHEN json_valid(t) THEN t ->> '$[1]' END AS e1 FROM json_texts)",
        _JSON,
    ),
    "json_or_raw": O._with(
        "SELECT id, CASE WHEN ok THEN t ->> '$.k' END AS k, CASE WHEN NOT ok THEN t END AS raw FROM (SELECT *, starts_with(trim(t), '{') AND json_valid(t) AS ok FROM json_texts)", _JSON
    ),
    "step_hints": O._with("SELECT of, id, hint, length(t || hint) AS n_chars FROM hinted", _STEP_SQL),
    "times_parsed": O._with(
        f"SELECT id, CASE WHEN id % 5 = 2 THEN t || ' 00:00:00' WHEN id % 5 > 2 THEN '2024-07-01 00:00:00' ELSE replace(t, 'T', ' ') END AS time FROM (SELECT id, {_TIME} AS t FROM memos)"
    ),
    "times_normalised": O._with(
        f"SELECT id, CASE id % 5 WHEN 0 THEN replace(t, ' ', 'T') || 'Z' WHEN 1 THEN t || 'Z' WHEN 4 THEN '1970-01-01T00:00:00Z' ELSE t END AS time FROM (SELECT id, {_TIME} AS t FROM memos)"
    ),
    "keywords_han": O._with(f"SELECT id, array_to_string({_FIRSTS.format(l='w')}[1:12], ',') AS keywords FROM (SELECT id, {_HAN_RUNS.format(t='t')} AS w FROM (SELECT id, body || '{_HAN}' AS t FROM facts))"),
    "keywords_assembled": O._with(
        f"""SELECT id, array_to_string({_FIRSTS.format(l='w')}[1:8], ',') AS keywords FROM (
  SELECT id, list_concat(['sym_' || (id % 5), '缓存', 'sym_0'], list_concat(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)[1:12], h)) AS w
  FROM (SELECT id, {_ASCII.format(t='t')} AS a, {_HAN_RUNS.format(t='t')} AS h FROM (SELECT id, body || '{_HAN}' AS t FROM facts)))"""
    ),
    "uri_paths": O._with("SELECT file_id, " + _pick("file_id", "'C:/my dir/'", "'/home/a+b/'", "'/plain/'") + " || file_path AS path FROM files"),
    "bytes_cut": O._with(
        """SELECT id, CASE WHEN strlen(t) > 5 THEN (SELECT max(p) FROM (SELECT left(t, i) AS p FROM range(1, 6) r(i)) WHERE strlen(p) <= 5) || '...' ELSE t END AS cut
FROM (SELECT id, """ + _pick("id", "'é'", "'登录'", "''") + " || body AS t FROM facts)"
    ),
    "qa_scores": O._with(
        "SELECT count(*) AS n, avg(CASE WHEN id % 4 IN (0, 3) THEN 1 ELSE 0 END) AS accuracy, avg(id % 8) AS mean_seconds, avg(id % 5) AS mean_calls, CAST(sum(id % 5) AS BIGINT) AS calls FROM memos"
    ),
    "tool_durations": O._with("SELECT category AS tool, count(*) AS n, CAST(sum(id % 16) AS DOUBLE) AS total, CAST(max(id % 16) AS DOUBLE) AS longest FROM memos GROUP BY 1"),
    "last_tag": "SELECT page_id, length(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)[-1]) AS n_chars FROM pages",
    "banded_rows": O._with(
        """SELECT file_id, id, CAST(band AS INTEGER) AS band, CAST(row_number() OVER (PARTITION BY file_id ORDER BY band, l, t, id) AS INTEGER) AS place FROM folded""",
        """boxes AS (
  SELECT file_id, symbol_id AS id, symbol_id % 7 * 1.0 AS l, line_start % 13 * 0.2 AS t, row_number() OVER (PARTITION BY file_id ORDER BY line_start % 13, symbol_id % 7, symbol_id) AS k FROM symbols
), folded AS (
  SELECT file_id, id, l, t, k, 0 AS band, t AS first FROM boxes WHERE k = 1
  UNION ALL SELECT b.file_id, b.id, b.l, b.t, b.k, CASE WHEN b.t - f.first > 0.5 THEN f.band + 1 ELSE f.band END, CASE WHEN b.t - f.first > 0.5 THEN b.t ELSE f.first END
  FROM folded f JOIN boxes b ON b.file_id = f.file_id AND b.k = f.k + 1
)""",
    ),
    "sheet_errors": O._with(
        f"""SELECT error, count(*) AS n, string_agg(place, ',' ORDER BY place) FILTER (k <= 20) AS locations FROM (
  SELECT error, place, row_number() OVER (PARTITION BY error ORDER BY place) AS k FROM (
    SELECT 's' || file_id || '!A' || symbol_id AS place, CASE WHEN contains(v, '#DIV/0!') THEN '#DIV/0!' WHEN contains(v, '#REF!') THEN '#REF!' WHEN contains(v, '#N/A') THEN '#N/A' END AS error FROM (SELECT *, {_CELL} AS v FROM symbols)
  ) WHERE error IS NOT NULL) GROUP BY 1"""
    ),
    "sheet_formulas": O._with("SELECT count(*) AS n_formulas FROM symbols WHERE symbol_id % 6 IN (2, 4)"),
    "relationship_checks": O._with(
        """SELECT file_id AS file, name AS rid, 'duplicate' AS problem FROM symbols GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT file, rid, CASE WHEN kind IS NULL THEN 'missing' ELSE 'type' END FROM (
  SELECT s.file_id AS file, c.callee_name AS rid, c.call_line % 3 AS e, (SELECT max(x.symbol_type) FROM symbols x WHERE x.file_id = s.file_id AND x.name = c.callee_name) AS kind
  FROM calls c JOIN symbols s ON s.symbol_id = c.caller_id
) WHERE kind IS NULL OR (e = 0 AND kind <> 'class') OR (e = 1 AND kind <> 'function')"""
    ),
    "content_types": O._with("SELECT file_path AS path FROM files WHERE file_id % 4 > 1 AND file_id % 3 <> 0"),
    "grep_regex": O._with(
        "SELECT file_id, line, length(trim(content)) AS n_chars FROM lines WHERE regexp_matches(content, '(?i)[0-9]+\\.[0-9]+|http') AND (file_path LIKE '%1.txt' OR file_path LIKE '%2.txt')"
    ),
    "snapshot_written": O.ORACLES["snapshot"],
}
