from sparkloom.operators import graph, ingest, metrics, search, snapshot


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, n long").groupBy("src", "dst").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


def hops(spark, e, root, direction):
    rows = graph.reach(e, spark.createDataFrame([(root,)], "root long"), direction).collect()
    return {r.node: r.hop for r in rows}


def test_breadth_first_finds_every_node(spark):
    t, a, b, c, d, e = range(6)
    g = edges(spark, (t, a), (t, b), (b, c), (c, d), (a, d), (d, e))
    assert hops(spark, g, t, "forward") == {a: 1, b: 1, c: 2, d: 2, e: 3}
    assert hops(spark, g, e, "backward") == {d: 1, a: 2, c: 2, b: 3, t: 3}


def test_multiplicity_and_self_loop(spark):
    g = edges(spark, (1, 2), (1, 2), (2, 2))
    rows = {r.node: r for r in graph.reach(g, spark.createDataFrame([(2,)], "root long"), "backward").collect()}
    assert rows[1].edge_count == 2 and rows[2].hop == 1 and len(rows) == 2
    got = graph.impact(g, spark.createDataFrame([(2,), (9,)], "root long")).orderBy("root").collect()
    assert (got[0].direct_edges, got[0].direct_nodes, got[0].indirect_nodes, got[0].risk) == (3, 2, 0, "low")
    assert (got[1].direct_edges, got[1].risk) == (0, "low")


def test_links_prefer_the_callers_file(spark):
    s = spark.createDataFrame([(5, 1, "foo"), (3, 2, "foo"), (7, 1, "a"), (8, 3, "b")], "symbol_id long, file_id long, name string")
    c = spark.createDataFrame([(7, "foo"), (8, "foo"), (7, "gone")], "caller_id long, callee_name string")
    got = {(r.caller_id, r.callee_name): r.callee_id for r in graph.link_calls(c, s).collect()}
    assert got == {(7, "foo"): 5, (8, "foo"): 3, (7, "gone"): None}


def test_owner_is_the_tightest_span(spark):
    s = spark.createDataFrame([(1, 1, "outer", 1, 500), (2, 1, "inner", 100, 120)], "symbol_id long, file_id long, name string, line_start int, line_end int")
    p = spark.createDataFrame([(1, 110), (1, 130), (1, 600)], "file_id long, line int")
    got = {r.line: r.owner for r in search.owners(p, s, "left").collect()}
    assert got == {110: "inner", 130: "outer", 600: None}


def test_search_tiers(spark):
    s = spark.createDataFrame([(1, "Login"), (2, "LoginUser"), (3, "a_b"), (4, "axb")], "symbol_id long, name string")
    assert [(r.name, r.tier) for r in search.tiered(s, "Login").collect()] == [("Login", 0)]
    found = search.tiered(s.where("symbol_id = 1"), "Logn").collect()[0]
    assert (found.match, round(found.score, 2)) == ("levenshtein_d1", 0.75)
    assert [r.name for r in search.substring(s, "a_b").collect()] == ["a_b"]
    assert {r.name for r in search.substring(s, "a_b", compat=True).collect()} == {"a_b", "axb"}
    assert search.tiered(s, "zzzzzzzzzz").count() == 0


def test_diff(spark):
    schema = "canonical_id string, file_path string, symbol_type string, calls array<string>"
    a = spark.createDataFrame([("x", "f", "class", ["p"]), ("m", "f", "class", []), ("t", "f", "class", []), ("c", "f", "class", ["p", "p"])], schema)
    b = spark.createDataFrame([("y", "f", "class", []), ("m", "g", "class", []), ("t", "f", "function", []), ("c", "f", "class", ["p"])], schema)
    got = {r.canonical_id: (r.change, r.message) for r in snapshot.diff(a, b).collect()}
    assert got == {"x": ("removed", "removed"), "y": ("added", "added"), "m": ("modified", "moved"), "t": ("modified", "type")}


def test_ingest_actions(spark):
    schema = "file_path string, file_hash string, file_size long, file_mtime long, index_level string"
    old = spark.createDataFrame([("same", "h", 1, 1, "symbol"), ("touched", "h", 1, 1, "symbol"), ("new_text", "h", 1, 1, "symbol"), ("gone", "h", 1, 1, "symbol"), ("meta", "h", 1, 1, "meta")], schema)
    now = spark.createDataFrame([("same", "h", 1, 1), ("touched", "h", 1, 2), ("new_text", "k", 1, 2), ("fresh", "h", 1, 1), ("meta", "h", 1, 1)], "file_path string, file_hash string, file_size long, file_mtime long")
    got = {r.file_path: r.action for r in ingest.classify(now, old).collect()}
    assert got == {"same": "skip_meta", "touched": "skip_hash", "new_text": "parse", "fresh": "new", "meta": "parse"}
    assert [r.file_path for r in ingest.deleted(old, now).collect()] == ["gone"]


def test_upsert_keeps_columns(spark):
    a = spark.createDataFrame([(1, "old", "then"), (2, "old", "then")], "k long, v string, made string")
    b = spark.createDataFrame([(2, "new", "now"), (3, "new", "now")], "k long, v string, made string")
    got = {r.k: (r.v, r.made) for r in ingest.upsert(a, b, ["k"], keep=("made",)).collect()}
    assert got == {1: ("old", "then"), 2: ("new", "then"), 3: ("new", "now")}


def test_naming(spark):
    s = spark.createDataFrame([(i, n, "function") for i, n in enumerate(["get_user", "getUser", "Foo_bar", "run"])], "symbol_id long, name string, symbol_type string")
    r = metrics.naming(s).first()
    assert (r.n, r.snake, r.camel, r.style) == (4, 1, 2, "camelCase")


def test_labels_read_paths(spark):
    """A file's path tells a side effect, but no stage."""
    from sparkloom.operators import flow

    symbols = spark.createDataFrame([(1, 10, "a", "m::a"), (2, 11, "b", "m::b"), (3, 12, "c", "m::c")], "symbol_id long, file_id long, name string, qualified_name string")
    files = spark.createDataFrame([(10, "x/plain.py"), (11, "lib/db/plain.py")], "file_id long, file_path string")
    related = spark.createDataFrame([(1, "forward", 2), (3, "forward", 1)], "root long, direction string, symbol_id long")
    got = {r.root: (r.side_effects, r.stages) for r in flow.labels(symbols, related, files).collect()}
    assert got[1][0] and not got[3][0] and got[1][1] == got[3][1]


def test_limits_reach_the_tasks(spark, sf_dir):
    """Top rows are kept by every task before the shuffle, not sorted whole by one."""
    from sparkloom.operators import metrics, search
    from sparkloom.plans import views as V
    from sparkloom.plans.queries import _files_map

    near = spark.createDataFrame([(1, 2, 1, 3)], "root long, node long, hop int, edge_count long")
    plans = [search.tiered(V.symbols(spark, sf_dir), "blue"), graph.shown(near, V.symbols(spark, sf_dir)), metrics.adaptive_levels(metrics.roll_up(_files_map(spark, sf_dir)))]
    for df in plans:
        assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_some_equal_scores_of_all(spark, sf_dir):
    from sparkloom.operators import flow
    from sparkloom.plans import views as V

    symbols = V.symbols(spark, sf_dir)
    linked = graph.link_calls(V.calls(spark, sf_dir), symbols)
    edges = graph.build_edges(linked)
    wanted = spark.range(0, 60, 7).withColumnRenamed("id", "symbol_id")
    names = {r.name for r in symbols.join(wanted, "symbol_id").collect()}
    some = {tuple(r) for r in graph.complexity_of(linked, symbols, wanted).collect()}
    assert some == {tuple(r) for r in graph.complexity(linked, symbols).collect() if r.name in names}
    ids = {r.symbol_id for r in wanted.collect()}
    every = {tuple(r) for r in flow.edge_classes(edges, symbols).collect() if r.symbol_id in ids}
    assert {tuple(r) for r in flow.edge_classes(edges, symbols, wanted).collect()} == every


def test_edges_at_some_equal_all_edges_there(spark, sf_dir):
    from sparkloom.plans import views as V

    calls, symbols, roots = V.calls(spark, sf_dir), V.symbols(spark, sf_dir), spark.range(0, 50, 9).withColumnRenamed("id", "root")
    ids = {r.root for r in roots.collect()}
    every = {tuple(r) for r in graph.build_edges(graph.link_calls(calls, symbols)).collect() if r.src in ids or r.dst in ids}
    assert {tuple(r) for r in graph.edges_at(calls, symbols, roots).collect()} == every


def test_unresolved_calls_meet_all_namesakes_in_tiles(spark):
    """Callers and symbols of a name are more than a tile of either; an id stands twice, or under two names; some values are null."""
    from collections import Counter

    symbols = [(i, "ab"[i % 2]) for i in range(23)] + [(4, "a"), (5, "a"), (None, "a"), (None, "b"), (50, None), (51, "c")]
    calls = [(i % 17, "abcx"[i % 4], None if i % 5 else 1) for i in range(120)] + [(None, "a", None), (3, None, None)]
    linked, table = spark.createDataFrame(calls, "caller_id long, callee_name string, callee_id long"), spark.createDataFrame(symbols, "symbol_id long, name string")
    want = Counter()
    for caller, name, callee in calls:
        for i, own in symbols:
            if callee is None and name is not None and name == own:
                want[caller, i] += 1
    for tile in (2, 5, 4096):
        got = [tuple(r) for r in graph.expand_unresolved(linked, table, tile).collect()]
        assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_pairs_of_unresolved_calls_are_made_last(spark):
    """There are callers times namesakes of them, so they must not be shuffled; nor are the rows that they are made of broadcast."""
    linked = spark.range(3000).selectExpr("id AS caller_id", "'f' AS callee_name", "CAST(NULL AS long) AS callee_id")
    df = graph.expand_unresolved(linked, spark.range(700).selectExpr("id AS symbol_id", "'f' AS name"))
    assert df.count() == 3000 * 700
    top = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "SortMergeJoin" in next(x for x in top if "Project" not in x)
