"""The registered queries as SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from .views import SQL

_Q = "(SELECT name FROM symbols WHERE symbol_id = 3)"
#: LIKE with the wildcards of the word escaped.
_ESC = "replace(replace({w}, '%', '\\%'), '_', '\\_')"


def _like(column: str, word: str, head: str = "%", tail: str = "%") -> str:
    return f"{column} ILIKE '{head}' || {_ESC.format(w=word)} || '{tail}' ESCAPE '\\'"


def _with(body: str, more: str = "") -> str:
    return "WITH RECURSIVE " + SQL.strip() + (", " + more if more else "") + "\n" + body


_SHOWN = "symbol_id, name, symbol_type, line_start"


def _reach(a: str, b: str, roots: str) -> str:
    """All nodes within three hops of the roots with their least hop."""
    return f"""walk(root, node, hop) AS (
  SELECT root, root, 0 FROM ({roots}) UNION
  SELECT w.root, e.{b}, w.hop + 1 FROM walk w JOIN edges e ON e.{a} = w.node WHERE w.hop < 3
), direct AS (
  SELECT root, {b} AS node, n FROM edges JOIN ({roots}) r ON r.root = {a}
), near AS (
  SELECT w.root, w.node, min(w.hop) AS hop FROM walk w WHERE w.node <> w.root GROUP BY ALL
  UNION ALL SELECT root, node, 1 FROM direct WHERE root = node
), hops AS (
  SELECT near.root, near.node, near.hop, CASE WHEN near.hop = 1 THEN d.n END AS edge_count
  FROM near LEFT JOIN direct d ON d.root = near.root AND d.node = near.node
)"""


_ROOT = "SELECT CAST(3 AS BIGINT) AS root"
_ROOTS40 = "SELECT CAST(range AS BIGINT) AS root FROM range(40)"
_ROOTS20 = "SELECT CAST(range AS BIGINT) AS root FROM range(20)"


def _tier_query(i: int, q: str) -> str:
    return f"""SELECT symbol_id, name, tier, match, CAST(score AS DOUBLE) AS score, {i} AS query FROM (
  SELECT *, min(tier) OVER () AS first, row_number() OVER (PARTITION BY tier ORDER BY CASE WHEN tier = 3 THEN dist ELSE 0 END, symbol_id) AS place FROM (
    SELECT symbol_id, name, dist, tier,
           CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN CAST(0.9 AS FLOAT) WHEN 2 THEN CAST(0.8 AS FLOAT) WHEN 3 THEN 1 - dist / 4.0 ELSE 0.5 END AS score,
           CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix_suffix' WHEN 2 THEN 'substring' WHEN 3 THEN 'levenshtein_d' || dist ELSE 'stem' END AS match
    FROM (SELECT *, levenshtein(lower(name), lower({q})) AS dist,
                 CASE WHEN name = {q} THEN 0 WHEN {_like('name', q, head='')} OR {_like('name', q, tail='')} THEN 1 WHEN {_like('name', q)} THEN 2
                      WHEN levenshtein(lower(name), lower({q})) <= 3 THEN 3 WHEN length({q}) >= 4 AND {_like('name', f'left({q}, 4)', head='')} THEN 4 END AS tier FROM symbols)
    WHERE tier IS NOT NULL))
WHERE tier = first AND place <= CASE WHEN tier = 0 THEN 1 ELSE 5 END"""


_FILES_MAP = """fmap AS (
  SELECT f.file_path, regexp_replace(f.file_path, '/[^/]*$', '') AS dir, coalesce(n, 0) AS n_symbols, coalesce(k, 0) AS n_scored, mean_score
  FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, count(score) AS k, avg(score) AS mean_score FROM symbols LEFT JOIN complexity USING (name) GROUP BY 1) USING (file_id)
)"""
_ROLLED = (
    _FILES_MAP
    + """, own_dir AS (
  SELECT dir AS own, count(*) AS n_files, sum(n_symbols) AS n_symbols, sum(coalesce(mean_score * n_scored, 0)) AS sum_score FROM fmap GROUP BY 1
), rolled AS (
  SELECT dir, CASE WHEN dir = '.' THEN 0 ELSE len(string_split(dir, '/')) END AS depth, CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(n_symbols) AS BIGINT) AS n_symbols, sum(sum_score) AS sum_score
  FROM (SELECT unnest(['.', string_split(own, '/')[1], own]) AS dir, * EXCLUDE (own) FROM own_dir) GROUP BY 1
)"""
)
_FLOW = (
    lambda roots: "back AS (SELECT * FROM (WITH RECURSIVE " + _reach("dst", "src", roots) + " SELECT root, sum(edge_count) FILTER (hop = 1) AS b_dir, count(*) FILTER (hop > 1) AS b_ind FROM hops GROUP BY 1)), "
    + "forth AS (SELECT * FROM (WITH RECURSIVE " + _reach("src", "dst", roots) + " SELECT root, sum(edge_count) FILTER (hop = 1) AS f_dir, count(*) FILTER (hop > 1) AS f_ind FROM hops GROUP BY 1)), "
    + f"""cls AS ({{cls}}), scored AS (
  SELECT r.root, coalesce(cls.ext_in, 0) AS ext_in, coalesce(cls.ext_out, 0) AS ext_out, coalesce(cls.int_in, 0) AS int_in, coalesce(cls.int_out, 0) AS int_out,
         coalesce(b_dir, 0) AS b_dir, coalesce(b_ind, 0) AS b_ind, coalesce(f_dir, 0) AS f_dir, coalesce(f_ind, 0) AS f_ind, coalesce(c.score, 0) AS complexity
  FROM ({roots}) r LEFT JOIN back USING (root) LEFT JOIN forth USING (root) LEFT JOIN cls ON cls.symbol_id = r.root
  LEFT JOIN symbols s ON s.symbol_id = r.root LEFT JOIN complexity c ON c.name = s.name
)"""
)
_CLS = """SELECT s.symbol_id, CAST(coalesce(int_in, 0) AS BIGINT) AS int_in, CAST(coalesce(ext_in, 0) AS BIGINT) AS ext_in, CAST(coalesce(int_out, 0) AS BIGINT) AS int_out, CAST(coalesce(ext_out, 0) AS BIGINT) AS ext_out
  FROM symbols s
  LEFT JOIN (SELECT dst, sum(CASE WHEN a.file_id = b.file_id THEN n ELSE 0 END) AS int_in, sum(CASE WHEN a.file_id = b.file_id THEN 0 ELSE n END) AS ext_in
             FROM edges JOIN symbols a ON a.symbol_id = src JOIN symbols b ON b.symbol_id = dst GROUP BY 1) i ON i.dst = s.symbol_id
  LEFT JOIN (SELECT src, sum(CASE WHEN a.file_id = b.file_id THEN n ELSE 0 END) AS int_out, sum(CASE WHEN a.file_id = b.file_id THEN 0 ELSE n END) AS ext_out
             FROM edges JOIN symbols a ON a.symbol_id = src JOIN symbols b ON b.symbol_id = dst GROUP BY 1) o ON o.src = s.symbol_id"""
_SCORE = "CAST(50 * ext_in + ext_out + 8 * b_dir + 2 * b_ind + 2 * f_dir + f_ind + least(complexity, 40.0) / 8.0 AS DOUBLE)"
_SNAP = """base AS (
  SELECT * FROM symbols WHERE symbol_id % 10 <> 0
), target AS (
  SELECT * REPLACE (CASE WHEN symbol_id % 7 <> 0 THEN symbol_type WHEN symbol_type = 'class' THEN 'function' ELSE 'class' END AS symbol_type) FROM symbols WHERE symbol_id % 10 <> 1
), shot_a AS (
  SELECT canonical_id, arg_max(symbol_id, symbol_id) AS symbol_id, arg_max(name, symbol_id) AS name, arg_max(file_path, symbol_id) AS file_path, arg_max(symbol_type, symbol_id) AS symbol_type, arg_max(line_start, symbol_id) AS line_start
  FROM (SELECT b.*, f.file_path, CASE WHEN symbol_type = 'class' THEN 'class' ELSE 'func' END || ':' || f.file_path || '::' || name AS canonical_id FROM base b JOIN files f USING (file_id)) GROUP BY 1
), shot_b AS (
  SELECT canonical_id, arg_max(symbol_id, symbol_id) AS symbol_id, arg_max(file_path, symbol_id) AS file_path, arg_max(symbol_type, symbol_id) AS symbol_type
  FROM (SELECT b.*, f.file_path, CASE WHEN symbol_type = 'class' THEN 'class' ELSE 'func' END || ':' || f.file_path || '::' || name AS canonical_id FROM target b JOIN files f USING (file_id)) GROUP BY 1
), calls_a AS (
  SELECT caller_id, count(*) AS n, list_distinct(list(callee_name)) AS c FROM calls GROUP BY 1
), calls_b AS (
  SELECT caller_id, list_distinct(list(callee_name)) AS c FROM calls WHERE call_line < 7 GROUP BY 1
)"""
_CLASSIFIED = """classified AS (
  SELECT f.*, CASE WHEN s.file_path IS NULL THEN 'new' WHEN s.index_level = 'symbol' AND s.file_size = f.file_size AND s.file_mtime = f.file_mtime THEN 'skip_meta'
                   WHEN s.index_level = 'symbol' AND s.file_hash = f.file_hash THEN 'skip_hash' ELSE 'parse' END AS action
  FROM files f LEFT JOIN stored s ON s.file_path = f.file_path
)"""
_SIDE = (
    ("filesystem", 2, "file path read write mkdir open close stat", "", "filepath rename remove copy"),
    ("database", 2, "db sql sqlite insert update delete commit transaction", "query exec row rows", ""),
    ("network", 3, "http https grpc tcp udp socket request response listen dial", "", "websocket endpoint url api"),
    ("process", 2, "exec command spawn process fork subprocess", "run cmd", ""),
    ("state", 2, "state cache memory session lock mutex atomic", "context", ""),
)
_STAGE = (
    ("init", "init setup new bootstrap load"), ("validate", "validate check verify guard"), ("execute", "run process handle execute build index"),
    ("query", "query search map trace analyze"), ("persist", "save write insert commit persist"),
)


def _tokens_hit(text: str, words: str) -> str:
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9])({'|'.join(words.split())})([^a-z0-9]|$)')" if words else "false"


def _part_hit(text: str, words: str) -> str:
    return f"regexp_matches(lower({text}), '{'|'.join(words.split())}')" if words else "false"


def _effects(text: str) -> str:
    each = [
        f"CASE WHEN 2 * CAST({_tokens_hit(text, a)} AS INT) + CAST({_tokens_hit(text, b)} AS INT) + CAST({_part_hit(text, c)} AS INT) >= {least} THEN '{label}' END"
        for label, least, a, b, c in _SIDE
    ]
    return f"concat_ws(',', {', '.join(each)})"


def _stages(text: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_part_hit(text, words)} THEN '{label}' END" for label, words in _STAGE) + ")"


def _any(columns: str, words: str) -> str:
    return " OR ".join(f"{c} ILIKE '%{w}%'" for w in words.split() for c in columns.split())


_INTENT_ROWS = """ir AS (
  SELECT id, left(content, length(content) // 2) || ' ' || ['fix it', 'refactor', 'analysis', 'design', 'none', 'add feature update', 'migrate'][length(content) % 7 + 1] || ' ' || substr(content, length(content) // 2 + 1) AS t,
    category = 'user' AS ro, CASE WHEN contains(content, chr(10)) THEN 'REFLECT' ELSE '' END AS e FROM chat_memos
), il AS (
  SELECT *, CASE WHEN e <> '' THEN e WHEN lower(t) LIKE '%fix%' OR lower(t) LIKE '%debug%' THEN 'DEBUG' WHEN lower(t) LIKE '%refactor%' THEN 'REFACTOR' WHEN lower(t) LIKE '%analy%' THEN 'RESEARCH'
                WHEN lower(t) LIKE '%design%' THEN 'DESIGN' WHEN ro THEN 'RESEARCH' ELSE '' END AS intent FROM ir
)"""

ORACLES = {
    "symbol_exact": _with(f"SELECT {_SHOWN} FROM symbols WHERE name = {_Q}"),
    "symbol_prefix_suffix": _with(f"SELECT {_SHOWN} FROM symbols WHERE {_like('name', f'left({_Q}, 4)', head='')} OR {_like('name', f'left({_Q}, 4)', tail='')}"),
    "symbol_substring": _with(f"SELECT {_SHOWN} FROM symbols WHERE {_like('name', f'substr({_Q}, 2, 4)')}"),
    "symbol_levenshtein": _with(
        f"SELECT symbol_id, name, distance, CAST(CAST(1 - distance / 4.0 AS FLOAT) AS DOUBLE) AS score FROM (SELECT symbol_id, name, CAST(levenshtein(lower(name), lower(left({_Q}, -1) || 'x')) AS INTEGER) AS distance FROM symbols) WHERE distance <= 3 ORDER BY distance, symbol_id LIMIT 5"
    ),
    "symbol_stem": _with(f"SELECT {_SHOWN} FROM symbols WHERE {_like('name', f'left({_Q}, 4)', head='')}"),
    "symbol_search_tiered": _with(
        "\nUNION ALL ".join(_tier_query(i, q) for i, q in enumerate((_Q, f"left({_Q}, 4)", f"substr({_Q}, 2, 5)", f"left({_Q}, -2) || 'zx'", f"left({_Q}, 4) || 'qqqqqqq'")))
    ),
    "search_scope_type": _with(
        f"SELECT symbol_id, name, file_path FROM symbols JOIN files USING (file_id) WHERE {_like('name', f'left({_Q}, 3)')} AND starts_with(file_path, 'src1') AND symbol_type IN ('function', 'method')"
    ),
    "symbol_at_line": _with(
        "SELECT file_id, line, symbol_id AS owner_id, name AS owner FROM (SELECT file_id, 40 AS line, s.symbol_id, s.name, row_number() OVER (PARTITION BY file_id ORDER BY line_end - line_start, symbol_id) AS k FROM files JOIN symbols s USING (file_id) WHERE 40 BETWEEN line_start AND line_end) WHERE k = 1"
    ),
    "grep_lines": _with(
        "SELECT file_id, line, length(trim(content, ' ')) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line) AS k FROM lines WHERE contains(content, 'tion')) WHERE k <= 5"
    ),
    "grep_shown": _with(
        "SELECT file_path, line, place FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line) AS place, dense_rank() OVER (ORDER BY file_path) AS f FROM lines WHERE contains(lower(content), 'tion')) WHERE f <= 10 AND place <= 3"
    ),
    "text_owner": _with(
        "SELECT l.file_id, l.line, o.symbol_id AS owner_id, coalesce(o.name, '(global)') AS owner FROM lines l LEFT JOIN (SELECT file_id, line, arg_min(symbol_id, (line_end - line_start, symbol_id)) AS symbol_id, arg_min(name, (line_end - line_start, symbol_id)) AS name FROM lines JOIN symbols USING (file_id) WHERE line BETWEEN line_start AND line_end GROUP BY ALL) o ON o.file_id = l.file_id AND o.line = l.line WHERE contains(content, 'tion')"
    ),
    "link_calls": _with(
        "SELECT caller_id, callee_name, (SELECT s2.symbol_id FROM symbols s2 WHERE s2.name = callee_name ORDER BY CASE WHEN s2.file_id = g.file_id THEN 0 ELSE 1 END, s2.symbol_id LIMIT 1) AS callee_id, n FROM (SELECT caller_id, callee_name, file_id, count(*) AS n FROM calls JOIN symbols ON symbol_id = caller_id GROUP BY ALL) g"
    ),
    "unresolved_calls": _with(
        "SELECT caller_id AS src, symbol_id AS dst, CAST(sum(n) AS BIGINT) AS n FROM (SELECT caller_id, callee_name, count(*) AS n FROM linked WHERE callee_id IS NULL OR callee_id % 2 <> 0 GROUP BY ALL) JOIN symbols ON name = callee_name GROUP BY 1, 2"
    ),
    "callers_of": _with(f"SELECT caller_id, name, call_line FROM linked JOIN symbols ON symbol_id = caller_id WHERE callee_id = 3 OR (callee_id IS NULL AND callee_name = {_Q})"),
    "impact_backward": _with("SELECT node AS symbol_id, hop, edge_count FROM hops", _reach("dst", "src", _ROOT)),
    "impact_forward": _with("SELECT node AS symbol_id, hop, edge_count FROM hops", _reach("src", "dst", _ROOT)),
    "impact_both": _with(
        "SELECT * FROM (WITH RECURSIVE " + _reach("src", "dst", _ROOT) + " SELECT node AS symbol_id, hop, 'forward' AS direction FROM hops) UNION ALL SELECT * FROM (WITH RECURSIVE " + _reach("dst", "src", _ROOT) + " SELECT node AS symbol_id, hop, 'backward' AS direction FROM hops)"
    ),
    "impact_risk": _with(
        f"SELECT root, direct_edges, direct_nodes, indirect_nodes, CASE WHEN direct_edges + indirect_nodes <= 3 THEN 'low' WHEN direct_edges + indirect_nodes <= 10 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT r.root, CAST(coalesce(sum(edge_count) FILTER (hop = 1), 0) AS BIGINT) AS direct_edges, count(*) FILTER (hop = 1) AS direct_nodes, count(*) FILTER (hop > 1) AS indirect_nodes FROM ({_ROOTS40}) r LEFT JOIN hops USING (root) GROUP BY 1)",
        _reach("dst", "src", _ROOTS40),
    ),
    "resolve_symbol": _with(
        f"(SELECT symbol_id, name, 0 AS tier FROM symbols WHERE name = {_Q} ORDER BY symbol_id LIMIT 1) UNION ALL (SELECT symbol_id, name, CASE WHEN name = substr({_Q}, 2, 4) THEN 0 ELSE 1 END AS tier FROM symbols WHERE contains(lower(name), substr({_Q}, 2, 4)) OR contains(lower(qualified_name), substr({_Q}, 2, 4)) ORDER BY tier, symbol_id LIMIT 1)"
    ),
    "fan_in_out": _with("SELECT symbol_id, name, fan_out, fan_in FROM symbols JOIN fan USING (symbol_id)"),
    "complexity_score": _with(
        "SELECT name, fan_out, fan_in, CAST(score AS DOUBLE) AS score, concat_ws('; ', CASE WHEN fan_out > 10 THEN 'high fan-out' END, CASE WHEN fan_in > 20 THEN 'high fan-in' END) AS reasons, CASE WHEN score >= 70 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END AS level FROM complexity"
    ),
    "complexity_buckets": _with("SELECT count(*) FILTER (score >= 50) AS high, count(*) FILTER (score >= 20 AND score < 50) AS medium, count(*) FILTER (score < 20) AS low, CAST(avg(score) AS DOUBLE) AS mean_score FROM complexity"),
    "project_map_files": _with("SELECT file_path, n_symbols, n_scored, CAST(mean_score AS DOUBLE) AS mean_score FROM fmap", _FILES_MAP),
    "project_map_dirs": _with("SELECT dir, count(*) AS n_files, CAST(sum(n_symbols) AS BIGINT) AS n_symbols FROM fmap GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 120", _FILES_MAP),
    "dir_rollup": _with("SELECT dir, depth, n_files, n_symbols, CAST(sum_score AS DOUBLE) AS sum_score FROM rolled", _ROLLED),
    "dir_levels": _with(
        "SELECT dir, depth, place FROM (SELECT *, count(*) OVER (PARTITION BY depth) AS n, row_number() OVER (PARTITION BY depth ORDER BY round(sum_score, 6) DESC, dir) AS place FROM rolled) WHERE place <= CASE WHEN n <= 20 THEN n WHEN n <= 40 THEN CASE WHEN depth <= 1 THEN 25 WHEN depth = 2 THEN 8 ELSE 18 END ELSE CASE WHEN depth <= 1 THEN 20 WHEN depth = 2 THEN 6 ELSE 12 END END",
        _ROLLED,
    ),
    "map_top_per_dir": _with(
        "SELECT dir, file_path, place, CASE WHEN place <= 10 THEN 'detail' WHEN place <= 30 THEN 'summary' ELSE 'folded' END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY coalesce(mean_score, 0) DESC, file_path) AS place FROM fmap)",
        _FILES_MAP,
    ),
    "map_symbols_ranked": _with("SELECT file_id, symbol_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, line_start, symbol_id) AS place FROM symbols JOIN complexity USING (name)"),
    "dir_structure": _with("SELECT regexp_replace(file_path, '/[^/]*$', '') AS dir, count(*) AS n_files FROM files GROUP BY 1"),
    "extensions": _with("SELECT DISTINCT regexp_extract(file_path, '[.]([^./]+)$', 1) AS extension, language FROM files"),
    "naming_style": _with(
        "SELECT n, snake, camel, snake * 100.0 / n AS snake_percent, camel * 100.0 / n AS camel_percent, CASE WHEN camel > snake THEN 'camelCase' WHEN snake = 0 AND camel = 0 THEN 'mixed' ELSE 'snake_case' END AS style FROM (SELECT count(*) AS n, count(*) FILTER (contains(name, '_') AND lower(name) = name) AS snake, count(*) FILTER (regexp_matches(name, '^[a-z][a-zA-Z0-9]*$')) AS camel FROM (SELECT name FROM symbols WHERE symbol_type = 'function' ORDER BY symbol_id LIMIT 1000))"
    ),
    "naming_prefixes": _with(
        "SELECT prefix, n FROM (SELECT split_part(name, '_', 1) || '_' AS prefix, count(*) AS n FROM (SELECT name FROM symbols WHERE symbol_type = 'function' ORDER BY symbol_id LIMIT 1000) WHERE contains(name, '_') GROUP BY 1) WHERE n > (SELECT greatest(2, least(1000, count(*)) // 20) FROM symbols WHERE symbol_type = 'function') ORDER BY n DESC, prefix LIMIT 5"
    ),
    "flow_edges": _with(_CLS),
    "flow_score": _with(
        f"SELECT root, CAST(int_in AS BIGINT) AS int_in, CAST(ext_in AS BIGINT) AS ext_in, CAST(int_out AS BIGINT) AS int_out, CAST(ext_out AS BIGINT) AS ext_out, CAST(b_dir AS BIGINT) AS b_dir, b_ind, CAST(f_dir AS BIGINT) AS f_dir, f_ind, CAST(complexity AS DOUBLE) AS complexity, {_SCORE} AS flow_score FROM scored",
        _FLOW(_ROOTS40).replace("{cls}", _CLS),
    ),
    "flow_entries": _with(
        f"SELECT root, CAST(ext_in AS BIGINT) AS ext_in, CAST(b_dir AS BIGINT) AS b_dir, b_ind, flow_score, line_start FROM (SELECT *, {_SCORE} AS flow_score FROM scored) JOIN symbols ON symbol_id = root ORDER BY ext_in DESC, b_dir DESC, b_ind DESC, flow_score DESC, line_start, root LIMIT 4",
        _FLOW("SELECT symbol_id AS root FROM (SELECT symbol_id FROM symbols ORDER BY CASE WHEN symbol_type = 'function' THEN 0 ELSE 1 END, line_start, name, symbol_id LIMIT 12)").replace("{cls}", _CLS),
    ),
    "flow_labels": _with(f"SELECT id, {_effects("type || ' ' || body || ' read_file http url exec'")} AS side_effects, {_stages('body')} AS stages FROM facts"),
    "flow_related": _with(
        f"SELECT root, {_effects('placed')} AS side_effects, {_stages('bag')} AS stages FROM (SELECT root, string_agg(name || ' ' || qualified_name, ' ') AS bag, string_agg(name || ' ' || qualified_name || coalesce(' ' || file_path, ''), ' ') AS placed FROM (SELECT root, symbol_id FROM picked WHERE k <= 8 UNION ALL SELECT DISTINCT root, root FROM picked) JOIN symbols USING (symbol_id) LEFT JOIN files USING (file_id) GROUP BY 1)",
        f"""picked AS (
  SELECT root, d, node AS symbol_id, row_number() OVER (PARTITION BY root, d ORDER BY node) AS k FROM (
    SELECT r.root, 'f' AS d, dst AS node FROM ({_ROOTS20}) r JOIN edges ON src = r.root UNION ALL SELECT r.root, 'b', src FROM ({_ROOTS20}) r JOIN edges ON dst = r.root)
)""",
    ),
    "critical_paths": _with(
        "SELECT root, place, path FROM (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY min(part * 10 + k), path) AS place FROM paths GROUP BY root, path) WHERE place <= 3",
        f"""up AS (
  SELECT root, entry, name, row_number() OVER (PARTITION BY root ORDER BY first, name) AS k FROM (SELECT r.root, e.name AS entry, s.name, min(s.symbol_id) AS first FROM ({_ROOTS20}) r JOIN symbols e ON e.symbol_id = r.root JOIN edges ON dst = r.root JOIN symbols s ON s.symbol_id = src GROUP BY ALL)
), down AS (
  SELECT root, entry, name, row_number() OVER (PARTITION BY root ORDER BY first, name) AS k FROM (SELECT r.root, e.name AS entry, s.name, min(s.symbol_id) AS first FROM ({_ROOTS20}) r JOIN symbols e ON e.symbol_id = r.root JOIN edges ON src = r.root JOIN symbols s ON s.symbol_id = dst GROUP BY ALL)
), paths AS (
  SELECT up.root, 0 AS part, 0 AS k, up.name || ' -> ' || up.entry || ' -> ' || down.name AS path FROM up JOIN down ON up.root = down.root WHERE up.k = 1 AND down.k = 1
  UNION ALL SELECT root, 1, k, name || ' -> ' || entry FROM up WHERE k <= 3
  UNION ALL SELECT root, 2, k, entry || ' -> ' || name FROM down WHERE k <= 3
)""",
    ),
    "snapshot": _with(
        """SELECT canonical_id, name, symbol_type, line_start, coalesce(n, 0) AS n_calls FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY symbol_id DESC) AS k FROM (
    SELECT s.*, CASE WHEN symbol_type = 'class' THEN 'class' ELSE 'func' END || ':' || file_path || '::' || name AS canonical_id FROM symbols s JOIN files USING (file_id))
) LEFT JOIN (SELECT caller_id, count(*) AS n FROM calls GROUP BY 1) ON caller_id = symbol_id WHERE k = 1"""
    ),
    "snapshot_diff": _with(
        """SELECT canonical_id, change, CASE WHEN change = 'modified' THEN what ELSE change END AS message FROM (
  SELECT coalesce(a.canonical_id, b.canonical_id) AS canonical_id,
         concat_ws('; ', CASE WHEN a.file_path <> b.file_path THEN 'moved' END, CASE WHEN a.symbol_type <> b.symbol_type THEN 'type' END, CASE WHEN plus + minus > 0 THEN 'calls +' || plus || ' -' || minus END) AS what,
         CASE WHEN b.canonical_id IS NULL THEN 'removed' WHEN a.canonical_id IS NULL THEN 'added' WHEN a.file_path <> b.file_path OR a.symbol_type <> b.symbol_type OR plus + minus > 0 THEN 'modified' END AS change
  FROM (SELECT shot_a.*, coalesce(c, []) AS c FROM shot_a LEFT JOIN calls_a ON caller_id = symbol_id) a
  FULL JOIN (SELECT shot_b.*, coalesce(c, []) AS c FROM shot_b LEFT JOIN calls_b ON caller_id = symbol_id) b ON a.canonical_id = b.canonical_id,
  LATERAL (SELECT len(list_filter(b.c, lambda x: NOT list_contains(a.c, x))) AS plus, len(list_filter(a.c, lambda x: NOT list_contains(b.c, x))) AS minus)
) WHERE change IS NOT NULL""",
        _SNAP,
    ),
    "ingest_classify": _with("SELECT file_id, action FROM classified", _CLASSIFIED),
    "ingest_counters": _with("SELECT action, count(*) AS n FROM classified GROUP BY 1", _CLASSIFIED),
    "ingest_budget": _with(
        "SELECT CASE WHEN action IN ('new', 'parse') AND k > 50 THEN 'meta' ELSE action END AS action, count(*) AS n FROM (SELECT action, row_number() OVER (PARTITION BY action IN ('new', 'parse') ORDER BY file_path) AS k FROM classified) GROUP BY 1",
        _CLASSIFIED,
    ),
    "ingest_merge": _with(
        "SELECT file_id, file_path, file_hash, file_mtime FROM classified WHERE action IN ('new', 'parse') UNION ALL SELECT s.file_id, s.file_path, s.file_hash, s.file_mtime FROM stored s JOIN classified c ON c.file_path = s.file_path WHERE action LIKE 'skip%'",
        _CLASSIFIED,
    ),
    "ingest_replace_children": _with(
        "SELECT CASE WHEN action = 'parse' THEN symbol_id + 1000000 ELSE symbol_id END AS symbol_id, file_id FROM symbols JOIN classified USING (file_id)", _CLASSIFIED
    ),
    "ingest_deleted": _with("SELECT file_id, file_path FROM stored WHERE file_path NOT IN (SELECT file_path FROM files)"),
    "dup_content": _with("SELECT file_hash, count(*) AS n, min(file_id) AS first_id FROM files GROUP BY 1 HAVING count(*) > 1"),
    "recall_memos": _with(f"SELECT id, category, entity FROM memos WHERE category = 'purchase' AND ({_any('content entity act', '1 2 error')}) ORDER BY timestamp DESC, id DESC LIMIT 20"),
    "recall_chat": _with(f"SELECT id, category, entity FROM chat_memos WHERE {_any('content entity act', 'tion que')} ORDER BY id DESC LIMIT 50"),
    "recall_facts": _with(f"SELECT id, type FROM facts WHERE {_any('body type', 'the er')} ORDER BY id DESC LIMIT 15"),
    "recall_report": _with(
        f"(SELECT 'fact' AS section, id, type AS kind FROM facts WHERE {_any('body type', 'a')} ORDER BY id DESC LIMIT 10) UNION ALL (SELECT 'memo', id, category FROM memos WHERE {_any('content entity act', 'a')} ORDER BY timestamp DESC, id DESC LIMIT 10)"
    ),
    "timeline": _with(
        "SELECT id, category, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day FROM memos WHERE timestamp >= (SELECT max(timestamp) FROM memos) - INTERVAL 7 DAY AND contains(lower(content || ' ' || entity), 'user_1')"
    ),
    "timeline_counts": _with("SELECT CASE WHEN category IN ('view', 'click', 'purchase') THEN category ELSE 'other' END AS category, count(*) AS n FROM memos GROUP BY 1"),
    "hooks_open": _with(
        "SELECT 'hook_' || lower(to_hex(id & 1048575)) AS hook_id, coalesce(CASE WHEN id % 48 > 0 THEN (SELECT max(timestamp) FROM memos) > timestamp + to_hours(CAST(id % 48 AS BIGINT)) END, false) AS expired FROM memos WHERE category <> 'error'"
    ),
    "intent_classify": _with(
        """SELECT id, intent,
  concat_ws(',', CASE WHEN NOT ro AND regexp_matches(t, '修改|update|change') THEN 'modification' END, CASE WHEN regexp_matches(t, 'migrate|迁移|升级') THEN 'migration' END, CASE WHEN NOT ro AND regexp_matches(lower(t), '开发|新增|添加|implement|create|feature|module') THEN 'new_feature' END) AS alerts,
  concat_ws(',', CASE WHEN ro THEN 'READ_ONLY' END, CASE intent WHEN 'DESIGN' THEN 'NO_CODE_EDIT,MD_ONLY' WHEN 'RESEARCH' THEN CASE WHEN ro THEN NULL ELSE 'READ_ONLY' END WHEN 'DEBUG' THEN 'VERIFY_FIRST,NO_BLIND_REWRITE' WHEN 'REFACTOR' THEN 'INCREMENTAL,VERIFY_EACH_STEP' WHEN 'REFLECT' THEN CASE WHEN ro THEN 'EVIDENCE_BASED' ELSE 'READ_ONLY,EVIDENCE_BASED' END END) AS guardrails
FROM il""",
        _INTENT_ROWS,
    ),
    "keyword_extract": _with(
        """SELECT id, coalesce(string_agg(t, ',' ORDER BY k) FILTER (k <= 12), '') AS keywords FROM (
  SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM (
    SELECT id, t, i, row_number() OVER (PARTITION BY id, lower(t) ORDER BY i) AS first FROM (
      SELECT id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT id, list_filter(regexp_extract_all(body, '[A-Za-z0-9_./-]+'), lambda x: length(x) BETWEEN 3 AND 40 AND lower(x) NOT IN ('http', 'https')) AS w FROM facts))
  ) WHERE first = 1) GROUP BY 1"""
    ),
    "text_heads": _with(
        """SELECT id, CASE WHEN length(body) > 20 THEN left(body, 20) || '...' ELSE body END AS cut,
  CASE WHEN length(h) > 28 THEN left(h, 28) || '...' ELSE h END AS head, len(list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+'))) AS n_tokens
FROM (SELECT *, trim(CASE WHEN instr(s, '。') > 1 THEN split_part(s, '。', 1) WHEN instr(s, '；') > 1 THEN split_part(s, '；', 1) WHEN instr(s, ';') > 1 THEN split_part(s, ';', 1) WHEN instr(s, '.') > 1 THEN split_part(s, '.', 1) WHEN instr(s, chr(10)) > 1 THEN split_part(s, chr(10), 1) ELSE s END) AS h
      FROM (SELECT *, trim(body) AS s FROM facts))"""
    ),
    "path_parts": _with(
        "SELECT file_id, regexp_replace(file_path, '/[^/]*$', '') AS dir, regexp_extract(file_path, '[^/]*$') AS base, 'txt' AS extension, CAST(len(string_split(file_path, '/')) AS BIGINT) AS depth, line_count FROM files"
    ),
    "chain_event_counts": _with("SELECT task_id, event_type, count(*) AS n FROM chain_events GROUP BY 1, 2"),
    "latest_state": _with("SELECT key, value, category FROM (SELECT entity AS key, content AS value, category, row_number() OVER (PARTITION BY entity ORDER BY timestamp DESC, id DESC) AS k FROM memos) WHERE k = 1"),
    "overlay_merge": _with("SELECT id AS key, CASE WHEN id % 2 = 0 THEN 'base' ELSE 'over' END || id AS value FROM facts WHERE id % 2 = 0 OR id % 3 = 0"),
    "catalog_precedence": _with("SELECT id AS key, CASE WHEN id % 3 = 0 THEN 'project' WHEN id % 2 = 0 THEN 'home' ELSE 'install' END || id AS value FROM facts"),
    "page_tag_outline": _with("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY 1, 2"),
    "integrity_references": _with(
        "SELECT DISTINCT callee_name AS name, 'broken' AS problem FROM calls WHERE callee_name NOT IN (SELECT name FROM symbols) UNION ALL SELECT DISTINCT name, 'unreferenced' FROM symbols WHERE name NOT IN (SELECT callee_name FROM calls)"
    ),
    "integrity_unique": _with("SELECT file_id, name, count(*) AS n FROM symbols GROUP BY 1, 2 HAVING count(*) > 1"),
    "log_projection": _with(
        "SELECT id, '- [' || content || '] **' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '**: ' || category || ' (' || entity || ') ' || act AS line FROM memos ORDER BY id DESC LIMIT 100"
    ),
    "box_overlaps": _with(
        """SELECT a.file_id, a.symbol_id AS first, b.symbol_id AS second, round((least(a.line_end, b.line_end) - greatest(a.line_start, b.line_start)) * CAST(1.5 - abs(a.symbol_id % 3 - b.symbol_id % 3) AS DOUBLE), 2) AS area
FROM symbols a JOIN symbols b ON a.file_id = b.file_id AND a.symbol_id < b.symbol_id
WHERE least(a.line_end, b.line_end) - greatest(a.line_start, b.line_start) > 0.05 AND 1.5 - abs(a.symbol_id % 3 - b.symbol_id % 3) > 0.05"""
    ),
    "stream_event_counts": _with("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) || ' 00:00:00' AS day, event_type, count(*) AS n FROM chain_events GROUP BY 1, 2"),
}
