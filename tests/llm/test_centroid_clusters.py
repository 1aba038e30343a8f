import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import centroid_clusters as m

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def plain(rows, k=8, rounds=10, axes=64, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == axes and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, x)) for x in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [near(v)[0] for _, v in kept]
        c = [[sum(col) // own.count(j) for col in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else x for j, x in enumerate(c)]
    out = [(i, *near(v)) for i, v in kept]
    return sorted(out, key=repr), c


def got(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], SCHEMA).repartition(3)
    out, c = m.clustered(table, **options)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=repr), c


def test_equals_plain_rounds(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 9, 1) / 8 for _ in range(64)]) for i in range(250)]
    odd = [(1000, None), (1001, [0.5] * 63), (1002, [0.5] * 63 + [None]), (1003, [0.5] * 63 + [math.inf]), (1004, [math.nan] * 64), (1005, [0.0] * 64), (None, [-0.25] * 64), (1006, [])]
    rows += odd + rows[:5] + [(3, [1.0] * 64)]
    assert got(spark, rows) == plain(rows)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(20)]  # equal centroids: the smaller number wins, the others stay as they began
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:3]) == plain(rows[:3])
    one, c = got(spark, [(1, [0.5] * 64)])
    assert one == [(1, 0, 0)] and c == [[512] * 64]


def test_very_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, -1.0]) * 10.0 ** rng.choice([0, 5, 8, 20, 38]) for _ in range(64)]) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want, c = plain(rows)
    out, held = got(spark, rows)
    assert held == c and out == sorted(((i, j, d if d < 2**63 else None) for i, j, d in want), key=repr)


def test_empty_table(spark):
    assert got(spark, []) == ([], [])
    assert m.with_inertia(*m.clustered(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("size", [3, 1000, 2**20, 2**26])
def test_screen_never_errs(size):
    """Centroids so near to each other that float32 can't tell them apart, up to the largest integers of the fast path."""
    rng = np.random.default_rng(size)
    base = rng.integers(-size, size, 64)
    c = base + rng.integers(-2, 3, (40, 64))
    c[7] = c[3]
    x = np.concatenate([base + rng.integers(-2, 3, (400, 64)), c, rng.integers(-size, size, (200, 64))])
    which, far, left = m.nearest(x.astype(np.int64), c.astype(np.int64))
    exact = ((x[:, None, :] - c[None]).astype(np.int64) ** 2).sum(-1)
    assert (which == exact.argmin(1)).all() and (far == exact.min(1)).all()
    if size >= 2**20:
        assert (left > 1).mean() > 0.5


def test_screen_decides_most():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-1024, 1024, (5000, 64)), rng.integers(-1024, 1024, (8, 64))
    which, _, left = m.nearest(x, c)
    assert (left == 1).mean() > 0.99 and (which == ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)).all()


def test_inertia(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(64)]) for i in range(60)]
    table = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], SCHEMA)
    want, c = plain(rows)
    for r in m.with_inertia(*m.clustered(table)).collect():
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
