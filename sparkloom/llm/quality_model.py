"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are binned by quantiles; trees of fixed depth grow
on gradient histograms and are kept as complete binary trees in flat arrays, so
that a batch of rows walks all trees at once by array indexing.

Labels are learnt from a bounded sample (``sample_rows`` ids and as many distinct
texts of them by keyed hashes, all where there are fewer); scores are given to
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import made, unused
from .language_id import held_out

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "letters", "digits", "capitals", "points", "symbols", "quotes",
    "white", "not_ascii", "log_lines", "line_length", "short_lines", "repeated_lines", "distinct_words", "top_word", "repeated_triples",
    "short_words", "capital_words", "odd_words", "marked_words", "longest_run", "sentence_length",
)

_CLASS = np.zeros((9, 256), np.float64)
for _row, _chars in enumerate(
    (
        b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?", b"#*$%&|<>~^=_\\{}[]@+/",
        b"\"'()", b" \t\n\x0b\x0c\r", bytes(range(0xC0, 0x100)), b".!?",
    )
):
    _CLASS[_row, list(_chars)] = 1


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text; null counts as empty."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, lines = text.split(), text.split("\n")
    n, w, k = len(text), max(1, len(words)), len(lines)
    letter, digit, capital, point, symbol, quote, white, wide, end = _CLASS @ np.bincount(raw, minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out[:2] = np.log1p(n), np.log1p(len(words))
    out[4:12] = letter / n, digit / n, capital / n, point / n, symbol / n, quote / n, white / n, wide / n
    out[12:14] = np.log1p(k), n / k
    out[14] = sum(len(x) < 30 for x in lines) / k
    out[15] = 1 - len(set(lines)) / k
    if len(words):
        out[2:4] = sizes.mean(), sizes.std()
        code, at, count = np.unique(np.fromiter((hash(x) for x in words), np.int64, len(words)), return_inverse=True, return_counts=True)
        out[16:18] = len(code) / w, count.max() / w
        if len(words) > 2:
            m = np.int64(len(code))
            pair = at[:-2] * m + at[1:-1]
            if m >= 2_000_000:  # else three numbers fit one
                pair = np.unique(pair, return_inverse=True)[1]
            triple = pair * m + at[2:]
            out[18] = 1 - len(np.unique(triple)) / len(triple)
        out[19] = (sizes <= 3).mean()
        out[20] = sum(x.isupper() for x in words) / w
        out[21] = sum(not x[:1].isalpha() for x in words) / w
        out[22] = sum(not x[-1:].isalnum() for x in words) / w
        out[24] = w / (1 + end)
    change = np.flatnonzero(np.diff(raw))
    out[23] = np.log1p(np.diff(np.concatenate([[-1], change, [len(raw) - 1]])).max())
    return out


class BoostedTrees:
    """Complete trees of one depth in arrays (trees, nodes) and (trees, leaves)."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float, rate: float):
        self.feature, self.threshold, self.leaf, self.base, self.rate = feature, threshold, leaf, base, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of ``x``."""
        trees = np.arange(len(self.feature))[None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        depth = (self.leaf.shape[1]).bit_length() - 1
        rows = np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        margin = self.base + self.rate * self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-margin))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 10) -> BoostedTrees:
        """Without rows of both labels the result scores a constant."""
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        base, nodes = float(np.log(mean / (1 - mean))), (1 << depth) - 1
        feature, threshold, leaf = [], [], []
        if len(y) and 0 < y.mean() < 1:
            cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
            binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
            margin = np.full(len(y), base)
            for _ in range(trees):
                p = 1 / (1 + np.exp(-margin))
                g, h = p - y, p * (1 - p)
                tf, tt = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
                node = np.zeros(len(y), np.int64)
                for level in range(depth):
                    first, width = (1 << level) - 1, 1 << level
                    best, cut = np.full(width, 1e-6), np.zeros(width, np.int64)
                    pick = np.full(width, -1)
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        at = (node - first) * (len(c) + 1) + binned[:, f]
                        size = width * (len(c) + 1)
                        gs, hs, ns = (np.cumsum(np.bincount(at, weights=v, minlength=size).reshape(width, -1), 1) for v in (g, h, np.ones(len(y))))
                        gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                        gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                        gain[(nl < least) | (nt - nl < least)] = -1
                        k = gain.argmax(1)
                        top = gain[np.arange(width), k]
                        better = top > best
                        best[better], cut[better], pick[better] = top[better], k[better], f
                    for v in np.flatnonzero(pick >= 0):
                        tf[first + v], tt[first + v] = pick[v], cuts[pick[v]][cut[v]]
                    node = 2 * node + 1 + (x[np.arange(len(y)), tf[node]] > tt[node])
                at = node - nodes
                value = -np.bincount(at, weights=g, minlength=nodes + 1) / (np.bincount(at, weights=h, minlength=nodes + 1) + ridge)
                margin += rate * value[at]
                feature.append(tf), threshold.append(tt), leaf.append(value)
        if not feature:
            feature, threshold, leaf = [np.zeros(1, np.int64)], [np.full(1, np.inf)], [np.zeros(2)]
        return cls(np.stack(feature), np.stack(threshold), np.stack(leaf), base, rate)


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"draw": pdf["draw"], "label": pdf["label"], "x": [statistics(t).tobytes() for t in pdf["text"]]})


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BoostedTrees:
    """Trees from the labelled rows of ``docs`` that aren't held out (fold 0 of 5).

    Null ids and labels are left out; an id with several labels takes the larger.
    Rows that repeat an id and its text count once, so however often ids are
    repeated ``sample_rows`` rows are gathered at most. Other columns are ignored.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").where(~held_out("id", 5, 0))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    first = known.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(first), "id")  # at most sample_rows rows
    each = rows.groupBy("id", "label", F.xxhash64(F.lit(seed), "id", "text").alias("draw")).agg(F.first("text").alias("text"))
    got = each.select("draw", "label", "text").mapInPandas(_measured, "draw long, label int, x binary").orderBy("draw").limit(sample_rows).collect()
    got = sorted(got, key=lambda r: (r["label"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"]) for r in got]) if got else np.zeros((0, len(FEATURES)))
    return BoostedTrees.fit(x, np.array([r["label"] for r in got], np.float64))


def score(docs: DataFrame, model: BoostedTrees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with score and predicted (1 from ``threshold`` on); columns of these names give way.

    Null and empty texts are scored by their all-zero statistics. Repeated rows
    get equal scores. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        p = shared.value.score(np.stack([statistics(t) for t in texts])) if len(texts) else np.zeros(0)
        return pd.DataFrame({"score": p, "predicted": (p >= threshold).astype(np.int32)})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "score", "predicted")]
    (name,) = unused(docs, "found")
    return docs.select(*kept, made(F.col(text_col), run, "score double, predicted int").alias(name)).select(*kept, f"{name}.*")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), model)
