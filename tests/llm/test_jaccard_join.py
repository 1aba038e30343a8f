import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm._shared import connected_components, shingle_set
from sparkloom.llm import jaccard_join
from sparkloom.llm.jaccard_join import COUNTER_BITS, CountTree, _count_table, _keys, _points, directory_keys, drop_near_copies, jaccard_components, overlap, tree_pairs


def brute(rows, k, percent):
    """(n_shingles, component) by comparing all pairs of plain word tuples."""
    def sh(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [sh(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed, families=12, size=14):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out, n = [], 0
    passage = [r.choice(words) for _ in range(60)]
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.choice([4, 9, 12, 30, 80, 300]))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                t[r.randrange(len(t))] = r.choice(words)
            if r.random() < 0.2:
                t += passage
            out.append((n, r.choice([" ", "\n", "  "]).join(t)))
            n += 1
    out += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "One  TWO"), (n + 5, "one two three")]
    return out


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_equals_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = sorted(tuple(r) for r in jaccard_components(df, k, percent).collect())
    assert got == sorted(brute(rows, k, percent))


@pytest.mark.parametrize("percent", [30, 50, 63])
def test_low_thresholds(spark, percent):
    rows = corpus(9, families=5, size=8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(df, 3, percent).collect()) == sorted(brute(rows, 3, percent))


def test_links_are_counted(spark):
    rows = [(d, t) for d, t in corpus(4, families=4, size=10)] + [(500, corpus(4)[0][1]), (501, corpus(4)[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_components(df, 3, 80, count_links=True).collect()}
    sets = [(d, set(shingle_set(t, 3).tolist())) for d, t in rows]
    for d, s in sets:
        assert got[d] == sum(bool(s and o) and 100 * len(s & o) >= 80 * len(s | o) for e, o in sets if e != d)


def test_keys_guarantee():
    """Sets within the threshold share a key, whatever the counts that order the shingles."""
    r = np.random.default_rng(3)
    for _ in range(400):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        counts = r.integers(0, 5, (2, 1 << COUNTER_BITS))
        for percent in (40, 80, 90):
            b = a.copy()
            for _ in range(int(r.integers(1, n + 1))):
                c = np.unique(np.concatenate([np.delete(b, r.integers(len(b))), r.integers(0, 1 << 63, int(r.integers(0, 3)), dtype=np.uint64) * np.uint64(2)]))
                o = overlap(a, c)
                if not len(c) or 100 * o < percent * (len(a) + len(c) - o):
                    break
                b = c
            if len(a) != overlap(a, b) or len(a) != len(b):
                assert np.intersect1d(directory_keys(a, percent, counts), directory_keys(b, percent, counts)).size


def test_copies_send_their_keys_once(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(i, text) for i in range(10000)], "doc_id long, text string").coalesce(4)
    keys = df.select("text").mapInArrow(_keys(5, 80, spark.sparkContext.broadcast(np.zeros((2, 1 << COUNTER_BITS), np.int64))), "node long, key long")
    assert keys.count() <= 4 * (296 - 237 + 1)
    assert jaccard_components(df).where("component_id = 0 and n_shingles = 296").count() == 10000 and drop_near_copies(df).count() == 1


def test_counts_add_up_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAN_IN", 3)
    rows = corpus(1)
    found = spark.createDataFrame(rows, "doc_id long, text string").repartition(11).withColumn("th", F.lit("")).mapInArrow(
        _points(3), "doc_id long, th string, n long, node long, vec binary, extra long, task long, slice long, counts binary")
    assert (_count_table(found).sum(1) == sum(len(shingle_set(t, 3)) for _, t in rows)).all()


def test_tree_bound_loses_no_pair():
    r = random.Random(5)
    sets = [shingle_set(t, 3) for _, t in corpus(7) if t and len(t.split()) > 3]
    found = {tuple(sorted((int(x), int(y)))) for i, j, _ in tree_pairs(CountTree(sets), CountTree(sets), 90, True) for x, y in zip(i, j)}
    for i, j in combinations(range(len(sets)), 2):
        o = overlap(sets[i], sets[j])
        if 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
            assert (i, j) in found
    assert r


def test_edges(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (None, None), (5, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [("5", 1, 5), ("7", 2, 7), ("7", 2, 7), ("9", 2, 7), ("None", 0, None), ("None", 2, 7)]
    kept = sorted((str(r.doc_id), r.text) for r in drop_near_copies(df).collect())
    assert ("7", "a b c d e f") in kept and ("5", "q") in kept and ("9", "a b c d e f") not in kept and len([k for k in kept if k[0] == "7"]) == 1
    assert jaccard_components(df.where("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    random.Random(2).shuffle(chain)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_ids_with_unlike_texts(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(3, a), (5, a), (5, b), (None, b + " x"), (None, "only null ids here"), (None, "only null ids here"), (6, None), (6, "")]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "doc_id long, text string, stay_id int, `_often` int, `Row_TH` int")
    out = drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("3", a), ("5", b), ("None", "only null ids here"), ("6", "None"), ("6", "")])


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:199_000])), (3, "w1 w2 w3 w4 w5 w6")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def drifting(r, n, step=2):
    """Texts of which each differs from the one before by a few words: neighbours link, distant ones don't."""
    t = [f"d{r.randrange(10**6)}" for _ in range(90)]
    out = []
    for i in range(n):
        for _ in range(step):
            t[r.randrange(len(t))] = f"d{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("pivots", [1, 6])
def test_large_families_by_pivots(spark, monkeypatch, pivots):
    """Copies of one text, a chain, and two groups that a single text joins, in blocks of 16: the same components as by all pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK_POINTS", 16)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    r = random.Random(pivots)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += drifting(r, 70)
    far = list(base)
    for i in range(0, 200, 9):  # neither linked with the copies, but by a text in between
        far[i] = f"y{i}"
    for i in range(40):
        t = list(far)
        t[r.randrange(len(t))] = f"z{i}"
        texts.append(" ".join(t))
    texts += [" ".join(base[:100] + far[100:]), *texts[:5]]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in jaccard_components(df, 3, 80).collect()) == sorted(brute(rows, 3, 80))


def test_copies_hardly_meet_in_pairs(spark, monkeypatch):
    """20,000 near copies of one text: the rows sent to pairs of blocks are few, not a multiple of all by the number of blocks."""
    sent, real = [], jaccard_join._pairs_left
    monkeypatch.setattr(jaccard_join, "_pairs_left", lambda sets: sent.append((out := real(sets)).count()) or out)
    word = F.concat(F.lit("n"), F.col("id").cast("string"))
    base = F.array(*[F.lit(f"w{i}") for i in range(60)])
    text = F.array_join(F.transform(base, lambda w, i: F.when(i == F.col("id") % 60, word).otherwise(w)), " ")
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = jaccard_components(df, 5, 80)
    assert got.where("component_id = 0").count() == 20_000 and sent and sum(sent) <= 20_000
