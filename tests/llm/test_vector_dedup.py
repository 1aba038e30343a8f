import numpy as np
import pytest

from sparkloom.llm.vector_dedup import FOUND, Codes, bucket_keys, key_plan, near_vectors, stored_codes

SCHEMA = "vec_id long, embedding array<float>, node string, copies int"


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((25, 32))
    x = np.concatenate([base + 0.12 * s * r.standard_normal(base.shape) for s in (0, 1, 1, 2, 2)] + [base[:3]])
    rows = [(int(i), [float(v) for v in np.float32(row)], "x", 1) for i, row in enumerate(x)]
    rows += [(900, None, "x", 1), (901, [0.0] * 32, "x", 1), (902, [float("nan")] * 32, "x", 1), (903, [], "x", 1), (904, [1.0, None], "x", 1), (905, [1.0, 2.0], "x", 1), (906, [2.0, 4.0], "x", 1)]
    got = {v.vec_id: v for v in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    found = sum(got[i].n_links for i in range(len(u)))
    assert found >= 0.98 * (near.sum() - len(u)) and all(got[i].n_links <= near[i].sum() - 1 for i in range(len(u)))
    for i in range(len(u)):
        assert got[i].kept == (got[i].component_id == i)
        if got[i].component_id != i:
            assert got[i].n_links > 0 and got[i].component_id < i
    for i in range(900, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[905].n_links, got[906].component_id) == (1, 905)


def test_copies_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, "", 0), (5, v, "", 0), (None, v, "", 0), (2, v, "", 0), (8, [-3.0, 0.0, 1.0], "", 0)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("2", 3, 2, True), ("5", 3, 2, False), ("5", 3, 2, False), ("8", 0, 8, True), ("None", 3, 2, False)]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim", [16, 63, 64, 200])
def test_estimates_are_unbiased_and_bounded(dim):
    r = np.random.default_rng(4)
    x = r.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    signs, codes, _ = stored_codes(x, np.arange(400), 40, 20, 7)
    c = Codes(dim, signs, codes)
    estimate, true = c.scaled @ c.turned.T, x @ x.T
    off = ~np.eye(len(x), dtype=bool)
    assert abs((estimate - true)[off].mean()) < 0.01
    assert (np.abs(estimate - true) <= 4 * (c.error[:, None] + c.rounding[None]) + 1e-6)[off].mean() > 0.999
    assert len(codes[0]) <= 4 * (-(-128 // dim) + 3) + (-(-128 // dim) * dim + 1) // 2


def test_recall_at_three_sizes(spark):
    """Every link within a thousandth of the threshold or closer, against brute force; larger tables have longer keys."""
    for n, bits in ((300, None), (900, 20), (900, 28)):
        a, b = pairs_at(0.951, n, 64, n)
        x = np.float32(np.concatenate([a, b])).astype(float)
        rows = [(i, [float(v) for v in y], "", 0) for i, y in enumerate(x)]
        u = x / np.linalg.norm(x, axis=1)[:, None]
        true = (u @ u.T >= 0.95).sum(1) - 1
        got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA), bits=bits).collect()}
        assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.98 * true.sum()


def test_doubles_stay_doubles(spark):
    v = [1 / 3, 0.1, 0.7]
    rows = [(1, v), (2, [x * 2 for x in v]), (3, [float(np.float32(x)) for x in v])]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def pairs_at(cosine, n, dim, seed):
    """``n`` unit vectors and their partners at exactly ``cosine``."""
    r = np.random.default_rng(seed)
    a, b = r.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_long_keys_keep_recall():
    a, b = pairs_at(0.95, 3000, 64, 3)
    for wanted in (20, 28, 31, 40):  # 31 is for about 1e8 rows, 30 GB of 64 floats
        bits, tables = key_plan(wanted, 0.95, 40)
        assert bits == wanted
        met = np.concatenate([(bucket_keys(a[i : i + 500], tables, bits, 7) == bucket_keys(b[i : i + 500], tables, bits, 7)).any(1) for i in range(0, 3000, 500)])
        assert met.mean() >= FOUND - 0.004, (bits, tables, met.mean())
    assert key_plan(18, 0.95, 40) == (18, 40) and key_plan(40, 1.0, 40) == (40, 40)
    assert key_plan(31, 0.5, 40)[0] < 31


def test_long_keys_find_pairs(spark):
    a, b = pairs_at(0.951, 300, 64, 5)
    rows = [(i, [float(v) for v in x], "", 0) for i, x in enumerate(np.concatenate([a, b]))]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), bits=31).where("n_links > 0").count()
    assert got >= 0.97 * 600
