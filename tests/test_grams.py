import os
import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.api import Engine
from sparkloom.operators import grams, search
from sparkloom.sources.store import Store


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n):
    parts = ["get", "set", "user", "User", "Name", "na", "me", "_", "id", "X", "é", "aa", "a", "b", "parse", "Парс", "1"]
    return sorted({"".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(n)} | {"a", "ab", "", "aaaa", "aaaaaaaa", "%_x", "a" * 300})


def test_index_lets_pass_what_a_scan_finds(spark):
    rng = random.Random(3)
    names = words(rng, 400)
    table = grams.table(spark.createDataFrame([(x,) for x in names], "name string")).cache()
    queries = [q for q in {*rng.sample(names, 25), "getuser", "aa", "ab", "aaaaa", "usr", "GETUSERNAM", "zzzz", "xyzqq", "%_", "naem_id"} if grams.usable(q)]
    got = reduce(DataFrame.unionByName, [grams.candidates(table, q).withColumn("q", F.lit(q)) for q in queries])
    found = {}
    for r in got.collect():
        found.setdefault(r.q, set()).add(r.name)
    for q in queries:
        low = q.lower()
        scan = {n for n in names if low in n.lower() or distance(low, n.lower()) <= 3 or (len(q) >= 4 and n.lower().startswith(low[:4]))}
        assert scan <= found.get(q, set()), (q, scan - found.get(q, set()))
    assert sum(map(len, found.values())) < 0.35 * len(names) * len(queries)
    assert not grams.usable("a") and not grams.usable("é1") and set(grams.wanted("abab")) >= {"ab1", "ab2", "ba1", "\x01a1", "b\x021", "size0", "size5"}


def test_engine_searches_by_the_index(spark, tmp_path, monkeypatch):
    rng, root = random.Random(8), tmp_path / "proj"
    root.mkdir()
    names = [n for n in words(rng, 160) if n.isidentifier()]
    for i in range(24):
        own = names[i::24]
        (root / f"f{i}.py").write_text("".join(f"def {n}():\n    pass\n\n" for n in own) or "x = 1\n")
    e = Engine(spark, str(tmp_path / "db"), buckets=64)
    e.ingest(str(root))
    columns = ("symbol_id", "name", "file_path", "tier", "place", "match", "score", "symbol_type")
    every = e.symbols().join(e.files().select("file_id", "file_path"), "file_id").cache()
    n = names[len(names) // 2]
    for query, scope, kind in ((n, "", ""), ("getuser", "", ""), ("seruser", "", ""), ("aa", "", ""), ("user", "f1", ""), (n[:4] + "qqqqqqqq", "", "function"), ("a", "", ""), ("nothinglikeit", "", ""), ("Парс", "", "")):
        want = search.tiered(search.of_type(search.in_scope(every, scope), kind), query)
        assert sorted(map(tuple, e.search(query, scope, kind).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect())), (query, scope, kind)
    asked, real = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, schema, buckets=None: asked.append((name, None if buckets is None else len(list(buckets)))) or real(self, name, schema, buckets))
    e.search(n).collect()
    assert {t for t, _ in asked} == {"grams", "names", "symbols", "files"} and all(b is not None and b < 40 for _, b in asked), asked
    assert dict(asked)["symbols"] <= 5
    # the index follows names that come and go
    (root / "f3.py").write_text("def brandnewname():\n    pass\n")
    os.utime(root / "f3.py", (1_900_000_000, 1_900_000_000))
    e.ingest(str(root))
    assert [r.name for r in e.search("brandnew").collect()] == ["brandnewname"]
    whole = {tuple(r) for r in real(e.store, "grams", grams.TABLE).collect()}
    assert whole == {tuple(r) for r in grams.table(e.symbols().select("name").distinct()).collect()}
