"""Exact integer k-means: float32 products screen the centroids, integers decide what the rounding leaves open.

Vectors become integers, floor(scale * x), so distances, sums and centroids are
exact and every run gives the same clusters. For a batch of vectors one float32
matrix product estimates all inner products with the centroids. With 64 axes
and unit roundoff u = 2^-24, converting both factors and summing in any order
changes a product by at most g * |x| * |c|, where g = m u / (1 - m u) and
m = axes + 2; so each squared distance, less the vector's own square, lies in a
known interval. Only centroids whose interval reaches below the least upper end
can be nearest: if one is left, it is the nearest; where several are, their
distances are computed as integers and the lowest number wins ties. Distances
that are returned are always computed as integers.

Vectors are stored once and never shuffled: a round is one pass over them in
which a task adds up its vectors by cluster and sends count and sums per
cluster and axis. The driver holds the centroids (``k`` times ``axes`` integers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

AXES, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Integers up to this size give squared distances over 64 axes within 63 bits; larger ones go by Python's integers.
SAFE = 1 << 27
#: Vectors that one product takes.
ROWS = 8192
#: Sums of very large integers travel as two numbers, as no Spark type holds them whole.
_LIMB = 10**20
_MOST = 3.4028234663852886e38


def integers(flat: np.ndarray, axes: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the rows of ``flat``; int64, or Python integers where one of them needs more."""
    x = np.floor(flat.astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= 2.0**62:
        return np.array([int(v) for v in x], object).reshape(-1, axes)
    return x.astype(np.int64).reshape(-1, axes)


def _large(x: np.ndarray) -> np.ndarray:
    """Rows that the fast paths can't hold."""
    return (x > SAFE).any(axis=1) | (x < -SAFE).any(axis=1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance, centroids left by the screen) of the integer rows of ``x``."""
    k, axes = centroids.shape
    which, left = np.zeros(len(x), np.int64), np.full(len(x), k, np.int64)
    squares = np.zeros(len(x), object if x.dtype == object or centroids.dtype == object else np.int64)
    if not len(x):
        return which, squares, left
    slow = np.ones(len(x), bool) if _large(centroids).any() else _large(x)
    if slow.any():
        c = centroids.astype(object)
        far = squares.astype(object)
        for i in np.flatnonzero(slow):
            d = [int(v) for v in _squares(x[i].astype(object), c)]
            which[i] = d.index(min(d))
            far[i] = d[which[i]]
        squares = far
    quick = np.flatnonzero(~slow)
    if not len(quick):
        return which, squares, left
    rows, c = x[quick].astype(np.int64), centroids.astype(np.int64)
    m = (axes + 2) * 2.0**-24
    product = (rows.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    own = (c * c).sum(axis=1).astype(np.float64)
    value = own - 2 * product
    norm = np.sqrt((rows * rows).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(own)[None, :]
    # the last term covers the float64 steps above, each of them within 2^-52 of what it gives
    width = 2 * (m / (1 - m)) * norm * (1 + 2.0**-40) + 2.0**-48 * (own + 2 * np.abs(product) + norm)
    open_ = value - width <= (value + width).min(axis=1)[:, None]
    found, several = open_.argmax(axis=1), open_.sum(axis=1)
    left[quick] = several
    row, number = np.nonzero(open_[several > 1])
    if len(row):
        at = np.flatnonzero(several > 1)
        d = _squares(rows[at[row]], c[number])
        order = np.lexsort((number, d, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        found[at] = number[first]
    which[quick] = found
    squares[quick] = _squares(rows, c[found])
    return which, squares, left


def kept_vectors(table: DataFrame, axes: int = AXES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors with exactly ``axes`` components, none of them null or not finite (as a float)."""
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= _MOST))
    return table.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == axes) & fine).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))


def _batches(batches: Iterator[pa.RecordBatch], axes: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, integers(part.column("embedding").flatten().to_numpy(zero_copy_only=False), axes, scale)


def _array(rows: list[list[int]]) -> np.ndarray:
    big = max((abs(v) for row in rows for v in row), default=0) >= 2**62
    return np.array(rows, object if big else np.int64)


def cluster_sums(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums per axis of every cluster that has vectors."""
    c, axes = _array(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(c), [[0] * axes for _ in c]
        for _, x in _batches(batches, axes, scale):
            which = nearest(x, c)[0]
            wide = x.dtype == object or bool(_large(x).any())
            for j in np.unique(which):
                rows = x[which == j]
                count[j] += len(rows)
                sums = (rows.astype(object) if wide else rows).sum(axis=0)
                total[j] = [a + int(b) for a, b in zip(total[j], sums, strict=True)]
        rows = [(j, i, count[j], *divmod(total[j][i], _LIMB)) for j in range(len(c)) if count[j] for i in range(axes)]
        wide = pa.decimal128(38, 0)
        kinds = (pa.int32(), pa.int32(), pa.int64(), wide, wide)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        arrays = [pa.array([Decimal(v) for v in col] if kind == wide else col, kind) for col, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "axis", "n", "high", "low"])

    parts = vectors.mapInArrow(run, "cluster int, axis int, n long, high decimal(38,0), low decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        n, sums = found.setdefault(r["cluster"], (r["n"], [0] * axes))
        sums[r["axis"]] = int(r["high"]) * _LIMB + int(r["low"])
    return found


def assigned(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, n_screened); a squared distance that a long can't hold is null."""
    c, axes = _array(centroids), len(centroids[0])
    fits = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _batches(batches, axes, scale):
            which, squares, left = nearest(x, c)
            far = pa.array([int(v) if v <= fits else None for v in squares] if squares.dtype == object else squares, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(which.astype(np.int32)), far, pa.array(left.astype(np.int32))], names=["vec_id", "cluster", "distance", "n_screened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, n_screened int")


def seeds(vectors: DataFrame, k: int, axes: int, scale: int, prefix: str = "3:") -> list[list[int]]:
    """The integer vectors of the ``k`` smallest hashes of prefix and id; ties go by the components, null ids come last."""
    key = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(F.asc_nulls_last(key), "embedding").limit(k).collect()
    return [[int(v) for v in integers(np.array(r["embedding"], np.float64), axes, scale)[0]] for r in first]


def clustered(
    table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, axes: int = AXES, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, n_screened) of every kept vector, and the integer centroids.

    Vectors that are null, of another length, or hold null or non-finite
    components are left out. Centroids start as the kept vectors of the smallest
    hashes, fewer than ``k`` if there are fewer; ``rounds`` times every vector
    goes to its nearest centroid, ties to the smaller number, and a centroid
    becomes the floor of its vectors' mean; one without vectors stays. Repeated
    rows count one by one; null ids are kept but start no cluster before others.
    Components up to the largest float are exact. Other columns are ignored. An
    empty table gives an empty result and no centroids.
    """
    vectors = stored(kept_vectors(table, axes, id_col, vector_col))
    centroids = seeds(vectors, k, axes, scale)
    if not centroids:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, n_screened int"), []
    for _ in range(rounds):
        found = cluster_sums(vectors, centroids, scale)
        new = [[s // found[j][0] for s in found[j][1]] if j in found else c for j, c in enumerate(centroids)]
        if new == centroids:  # further rounds change nothing
            break
        centroids = new
    return assigned(vectors, centroids, scale), centroids


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows`` with cluster_inertia, inertia (null where a long can't hold the sum) and centroid_sha256."""
    spark = rows.sparkSession
    rows = stored(rows)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(total.alias("within"), F.count_if(F.col("distance").isNull()).alias("over")).collect()
    held = {r["cluster"]: None if r["over"] else int(r["within"]) for r in sums}
    whole = None if None in held.values() else sum(held.values())
    fit = lambda v: v if v is not None and v < 2**63 else None
    table = [(j, fit(held.get(j)), fit(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    per = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_inertia(rows, centroids)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sql(k: int = CLUSTERS, rounds: int = ROUNDS, axes: int = AXES, scale: int = SCALE) -> str:
    """The rounds spelt out; centroids and vectors as rows of (number or id, axis, integer)."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {axes} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {axes}
)""",
        "p AS MATERIALIZED (SELECT rid, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS axis FROM v)",
        f"""c0 AS MATERIALIZED (
  SELECT c, unnest(e) AS m, unnest(range(1, len(e) + 1)) AS axis
  FROM (SELECT e, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS c FROM v) WHERE c < {k}
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, arg_min(c, d * {k} + c) AS c, min(d) AS d
  FROM (SELECT rid, c, sum((x - m) * (x - m)) AS d FROM p JOIN c{i} USING (axis) GROUP BY rid, c) GROUP BY rid
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, axis, coalesce((s - ((s % n) + n) % n) // n, m) AS m
  FROM c{i} LEFT JOIN (SELECT c, axis, sum(x) AS s, count(*) AS n FROM p JOIN a{i} USING (rid) GROUP BY c, axis) t USING (c, axis)
)""")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY axis)) AS s FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN h ON h.c = a.c"""
