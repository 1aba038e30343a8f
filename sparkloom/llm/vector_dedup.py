"""Near-copies among embeddings from randomised-rotation binary codes.

Unit vectors are turned by random rotations. What is stored of each, once, are
the signs of the turned coordinates; the correction factor <code, turned vector>
of the signs of the first rotations, which are its binary code; the spread of
the estimates it gives; and the coordinates that the code stands for, rounded at
random to 4 bits. Dividing by the factor makes <code of x, rounded y> an unbiased
estimate of <x, y>, with an error that falls as 1/sqrt(dimension). A pair whose
upper confidence bound stays below the threshold is dropped. Vectors that still
have a partner are fetched, and these are recomputed exactly in double precision.

Which pairs are estimated at all: the signs are also cut into many short keys,
and codes that share a key meet in a bucket. Keys lengthen with the logarithm of
the row count, so that unlike vectors rarely meet, and grow in number with their
length (see ``key_plan``), so that at every row count a pair at the threshold is
found with probability of about ``FOUND`` or more (simulated: 0.989 to 0.997),
closer pairs more surely.

Skew: equal vectors collapse into one class with a count first; buckets of one
class end with their count; the others load codes, and vectors only for what the
bounds leave. Large buckets are split into blocks and processed in pairs of blocks. A pair is counted in the first bucket that holds
both, so pairs are never written out; only per-vector counts and a spanning
forest leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, made, mixed, stored

BLOCK = 512
#: Rows of small buckets that share a group, about.
SLICE = 1000
#: Probability, about, that a pair at the threshold shares a key.
FOUND = 0.99
#: The same for keys of independent bits. Bits of one rotation agree all together somewhat more rarely.
AIM = 0.997
#: Where more keys were needed for that, they are shortened instead.
MOST_TABLES = 500
#: Signs of a code, at least.
CODE_BITS = 128
#: Vectors whose sign bits are held at once.
KEY_ROWS = 1024


@lru_cache(maxsize=16)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random rotations of ``dim`` axes, side by side: (dim, count * dim)."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def unit(values) -> np.ndarray | None:
    """The vector in doubles at length 1, or None where it can't link."""
    if values is None:
        return None
    x = np.asarray([np.nan if v is None else v for v in values] if getattr(values, "dtype", None) == object or isinstance(values, list) else values, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def _classes(vectors: pd.Series) -> pd.DataFrame:
    """The class of each vector, and its components as they came: 4 bytes each where that is exact."""
    node, vec = [], []
    for values in vectors:
        x = unit(values)
        node.append(None if x is None else xxhash.xxh3_64_intdigest((x + 0.0).tobytes()) - (1 << 63))
        if x is None:
            vec.append(None)
        else:
            raw = np.asarray(values, np.float64)
            small = raw.astype(np.float32)
            vec.append(b"s" + small.tobytes() if (small == raw).all() else b"d" + raw.tobytes())
    return pd.DataFrame({"node": pd.array(node, "Int64"), "vec": vec})


def _units(vecs) -> list[np.ndarray]:
    """Unit vectors of stored components."""
    return [unit(np.frombuffer(v[1:], np.float32 if v[:1] == b"s" else np.float64)) for v in vecs]


def key_plan(bits: int, threshold: float, tables: int) -> tuple[int, int]:
    """(bits, tables): ``tables`` keys or as many more as a pair at ``threshold`` needs to share one with probability ``AIM`` if bits were independent."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi

    def needed(n: int) -> float:
        same = agree**n
        return 1 if same >= 1 else math.inf if same < 1e-12 else math.ceil(math.log(1 - AIM) / math.log1p(-same))

    while bits > 1 and needed(bits) > max(tables, MOST_TABLES):
        bits -= 1
    return bits, max(tables, int(min(needed(bits), 1e6)))


def _key_parts(signs: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables): ``bits`` signs each as a number."""
    return (signs[:, : tables * bits].reshape(len(signs), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(-1)


def bucket_keys(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """(rows, tables) keys of ``bits`` sign bits each."""
    return _key_parts(_turned(x, tables, bits, seed) > 0, tables, bits)


def _count(dim: int) -> int:
    """Rotations whose signs make up the code."""
    return -(-CODE_BITS // dim)


def _turned(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    dim = x.shape[1]
    return x @ rotations(dim, max(_count(dim), -(-tables * bits // dim)), seed)


def stored_codes(x: np.ndarray, node: np.ndarray, tables: int, bits: int, seed: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Packed signs, codes and keys of unit vectors. A code is its factors, the least coordinate, the step of rounding, the spread, and half bytes."""
    dim, count = x.shape[1], _count(x.shape[1])
    turned = _turned(x, tables, bits, seed)
    first = turned[:, : count * dim]
    factor = np.abs(first).reshape(len(x), count, dim).sum(-1) / math.sqrt(dim)  # <code, turned vector>
    spread = np.sqrt((1 / factor**2 - 1).mean(1) / max(1, dim - 1) / count)
    low = first.min(1, keepdims=True)
    step = np.maximum((first.max(1, keepdims=True) - low) / 15, 1e-12)
    dither = mixed(node.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(first.shape[1], dtype=np.uint64)[None]) / 2.0**64
    level = np.clip(np.floor((first - low) / step + dither), 0, 15).astype(np.uint8)
    if level.shape[1] % 2:
        level = np.concatenate([level, np.zeros((len(x), 1), np.uint8)], 1)
    head = np.concatenate([factor, low, step, spread[:, None]], 1).astype(np.float32)
    half = level[:, ::2] << 4 | level[:, 1::2]
    signs = turned > 0
    keys = _key_parts(signs, tables, bits)
    packed = np.packbits(signs[:, : max(tables * bits, count * dim)], axis=1)
    t = np.arange(tables, dtype=np.uint64)[None]
    hashed = mixed(keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + t * np.uint64(0xCA5A826395121157) + np.uint64(dim)).view(np.int64)
    return [r.tobytes() for r in packed], [a.tobytes() + b.tobytes() for a, b in zip(head, half, strict=True)], hashed


def _keys(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            keys, signs, codes, dims = [None] * n, [None] * n, [None] * n, np.zeros(n, np.int64)
            vecs, node = _units(pdf["vec"]), pdf["node"].to_numpy(np.int64)
            for dim in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                for a in range(0, len(at), KEY_ROWS):
                    some = at[a : a + KEY_ROWS]
                    for i, s, c, k in zip(some, *stored_codes(np.stack([vecs[i] for i in some]), node[some], tables, bits, seed), strict=True):
                        signs[i], codes[i], keys[i], dims[i] = s, c, k, dim
            yield pd.DataFrame({"node": node, "dim": dims, "signs": signs, "code": codes, "keys": keys})

    return run


class Codes:
    """What codes of one dimension say: ``scaled`` @ ``turned`` are the estimates, ``error`` and ``rounding`` the standard errors of either side."""

    def __init__(self, dim: int, signs: list[bytes], codes: list[bytes]):
        count = _count(dim)
        self.signs = np.unpackbits(np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1), axis=1)
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        head = raw[:, : 4 * (count + 3)].copy().view(np.float32)
        half = raw[:, 4 * (count + 3) :]
        level = np.stack([half >> 4, half & 15], -1).reshape(len(codes), -1)[:, : count * dim]
        factor, low, step = head[:, :count], head[:, count : count + 1], head[:, count + 1 : count + 2]
        self.error = head[:, count + 2]
        sign = np.where(self.signs[:, : count * dim] > 0, np.float32(1), np.float32(-1)).reshape(len(codes), count, dim)
        self.scaled = (sign / (math.sqrt(dim) * count * factor[..., None])).reshape(len(codes), -1).astype(np.float32)
        self.turned = low + step * level
        # a rounding error has a variance of step**2 / 4 at most; factors lie near sqrt(2 / pi)
        self.rounding = step[:, 0] / (2 * math.sqrt(count) * 0.6)


def _near_pairs(codes: Codes, left: list[np.ndarray], right: list[np.ndarray], same: bool, threshold: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, bucket by bucket, whose upper bound reaches the threshold: large buckets as matrices, small ones together."""
    few: list[tuple[np.ndarray, np.ndarray]] = []
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in zip(left, right, strict=True):
        if len(a) * len(b) >= 4096:
            near = codes.scaled[a] @ codes.turned[b].T + width * (codes.error[a][:, None] + codes.rounding[b][None]) >= threshold
            i, j = np.nonzero(np.triu(near, 1) if same else near)
            out.append((a[i], b[j]))
        else:
            i, j = np.triu_indices(len(a), 1) if same else np.indices((len(a), len(b))).reshape(2, -1)
            few.append((a[i], b[j]))
    i, j = (np.concatenate(x) if few else np.empty(0, np.int64) for x in (zip(*few, strict=True) if few else ((), ())))
    for at in range(0, len(i), 16384):
        p, q = i[at : at + 16384], j[at : at + 16384]
        near = np.einsum("ij,ij->i", codes.scaled[p], codes.turned[q]) + width * (codes.error[p] + codes.rounding[q]) >= threshold
        out.append((p[near], q[near]))
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))


def _new(parts: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share no key before table ``t``."""
    for a in range(t):
        if not len(i):
            break
        new = parts[i, a] != parts[j, a]
        i, j = i[new], j[new]
    return i, j


def _split(order: np.ndarray, bucket: np.ndarray, mine: np.ndarray, bi: int, bj: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of every bucket on either side."""
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    left = [g[mine[g] == bi] for g in groups]
    return left, left if bi == bj else [g[mine[g] == bj] for g in groups]


def _partnered(threshold: float, tables: int, bits: int, width: float):
    """The rows of a group that have, by the bounds, a partner whom they meet here first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, bi, bj = (int(pdf[c].iloc[0]) for c in ("t", "bi", "bj"))
        node, bucket, mine, dims = (pdf[c].to_numpy(np.int64) for c in ("node", "key", "block", "dim"))
        has = np.zeros(len(pdf), bool)
        for dim in np.unique(dims):  # a bucket holds one dimension
            own = np.flatnonzero(dims == dim)
            codes = Codes(int(dim), [pdf["signs"].iloc[r] for r in own], [pdf["code"].iloc[r] for r in own])
            left, right = _split(np.lexsort((node[own], bucket[own])), bucket[own], mine[own], bi, bj)
            i, j = _new(_key_parts(codes.signs, tables, bits), *_near_pairs(codes, left, right, bi == bj, threshold, width), t)
            has[own[i]] = has[own[j]] = True
        return pdf.loc[has, ["t", "part", "key", "n_blocks", "node", "block", "bi", "bj"]]

    return run


def _bucket_links(threshold: float, tables: int, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, bi, bj = (int(pdf[c].iloc[0]) for c in ("t", "bi", "bj"))
        node, copies, bucket, mine = (pdf[c].to_numpy(np.int64) for c in ("node", "copies", "key", "block"))
        vecs = _units(pdf["vec"])
        dims = np.array([len(v) for v in vecs])
        found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            x = np.stack([vecs[r] for r in own])
            signs = np.unpackbits(np.frombuffer(b"".join(pdf["signs"].iloc[r] for r in own), np.uint8).reshape(len(own), -1), axis=1)
            for a, b in zip(*_split(np.lexsort((node[own], bucket[own])), bucket[own], mine[own], bi, bj), strict=True):
                near = x[a] @ x[b].T >= threshold - 1e-9
                i, j = np.nonzero(np.triu(near, 1) if bi == bj else near)
                i, j = a[i], b[j]
                exact = np.einsum("ij,ij->i", x[i], x[j])  # the same sum whatever else is in the bucket
                i, j = _new(_key_parts(signs, tables, bits), i[exact >= threshold], j[exact >= threshold], t)
                found_i.append(own[i]), found_j.append(own[j])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        links = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
        up = np.arange(len(node))
        tree = []

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for a, b in zip(i, j, strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                tree.append((node[a], node[b]))
        has = np.flatnonzero(links)
        return pd.DataFrame(
            {
                "a": np.concatenate([node[has], np.array([e[0] for e in tree], np.int64)]),
                "b": pd.array([None] * len(has) + [e[1] for e in tree], "Int64"),
                "links": np.concatenate([links[has].astype(np.int64), np.zeros(len(tree), np.int64)]),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    tables: int = 40,
    seed: int = 7,
    width: float = 4.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    bits: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link when their cosine is at least ``threshold``. Null, empty and zero
    vectors and those with a null or non-finite component link with nothing and
    are their own component; vectors of unlike dimension never link. Equal rows
    link with each other. Rows with a null id link like others, take the
    component's smallest id that is not null, and are not kept unless they have
    no links. Other columns are ignored. An empty table gives an empty result.
    ``width`` is the half width of the confidence bounds in standard errors.
    ``tables`` is the least number of keys; ``bits``, their length, follows from
    the row count if not given.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    points = stored(rows.select("vec_id", made(F.col("embedding"), _classes, "node long, vec binary").alias("p")).select("vec_id", "p.*"))
    classes = stored(
        points.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    )
    count = classes.count()
    bits, tables = key_plan(bits or max(6, min(40, math.ceil(math.log2(max(2, count))) + 4)), threshold, tables)
    keyed = stored(classes.select("node", "vec").mapInPandas(_keys(tables, bits, seed), "node long, dim int, signs binary, code binary, keys array<long>"))
    probes = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    buckets = stored(probes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks")))
    held = int(buckets.where("n_blocks = 1").agg(F.sum("n")).first()[0] or 0)
    slices = max(1, held // (tables * SLICE))
    # small buckets share a task's group; a large one has groups of its own
    part = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(slices))).otherwise(F.col("key"))
    met = probes.join(buckets.drop("n"), "key").withColumn("part", part)
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    paired = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "t", "part", "key", "n_blocks", "node", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")
    )
    group = ["t", "part", F.col("n_blocks") > 1, "bi", "bj"]
    with_codes = paired.join(keyed.select("node", "dim", "signs", "code"), "node")
    left = stored(with_codes.groupBy(*group).applyInPandas(_partnered(threshold, tables, bits, width), "t int, part long, key long, n_blocks int, node long, block int, bi int, bj int"))
    with_vectors = left.join(keyed.select("node", "signs").join(classes.select("node", "copies", "vec"), "node"), "node")
    found = stored(with_vectors.groupBy(*group).applyInPandas(_bucket_links(threshold, tables, bits), "a long, b long, links long"))
    linked = connected_components(found.where("b is not null").select("a", "b"))
    least = linked.join(classes, "node").groupBy("root").agg(F.min("least").alias("component"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    each = (
        classes.select("node", "least", "copies")
        .join(linked, "node", "left")
        .join(least, "root", "left")
        .join(links, "node", "left")
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    return (
        points.select("vec_id", "node")
        .join(each, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))
    )


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
