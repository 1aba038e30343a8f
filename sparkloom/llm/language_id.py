"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (orders 1 to 4,
blended) that are present in both, normalised by the sizes of their presence
sets; frequency within a text doesn't count. Landmark texts give a Nyström map
of it, and one ridge regression per language against the rest is solved in that
map. All landmarks' presence rows and the regression weights multiply into one
(n-grams x languages) matrix, so texts are scored in batches by one product
of their presence rows with it.

N-grams are hashed to ``SIZE`` columns. The training texts are a bounded sample:
of each of the ``most_languages`` most frequent languages ``per_language``
distinct texts at most, by a keyed hash of the text; a row of it is 4 KB on the
driver. Everything else runs over all rows and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import made, unused

#: Columns of a presence row.
SIZE = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Characters taken at once of a long text.
STEP = 1 << 19
BATCH = 64
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams occur in the whole text, case aside: bool[SIZE]."""
    found = np.zeros(SIZE, bool)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, max(1, len(code)), STEP):
        c = code[start : start + STEP + max(ORDERS) - 1].astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            if len(c) < order:
                break
            n = len(c) - order + 1
            h = h[:n] * np.uint64(0x100000001B3) + c[order - 1 :] + np.uint64(1)
            if order in ORDERS:
                found[((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)] = True
    return found


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


class StringKernelModel:
    """Languages and the (n-grams x languages) matrix that scores presence rows."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, rows: np.ndarray, labels: list[str], landmarks: int = 192, ridge: float = 1e-3, seed: int = 3) -> StringKernelModel:
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros((SIZE, 0), np.float32))
        size = np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)).astype(np.float32)
        y = np.array([languages.index(v) for v in labels])
        rng, chosen = np.random.default_rng(seed), []
        for k in range(len(languages)):
            own = np.flatnonzero(y == k)
            chosen += list(rng.permutation(own)[: max(1, landmarks // len(languages))])
        z = rows[chosen] / size[chosen]
        kmm = (z @ z.T).astype(np.float64)
        value, vector = np.linalg.eigh(kmm)
        keep = value > 1e-6 * value.max()
        nystrom = vector[:, keep] / np.sqrt(value[keep])  # phi(x) = k(x, landmarks) @ nystrom
        # a few rows at a time: all of them as numbers would take 200 MB of the driver
        near = np.concatenate([(rows[a : a + BATCH] / size[a : a + BATCH]) @ z.T for a in range(0, len(rows), BATCH)])
        phi = near.astype(np.float64) @ nystrom
        weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
        target = np.where(y[:, None] == np.arange(len(languages))[None], 1.0, -1.0)
        gram = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
        solved = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
        return cls(languages, z.T @ (nystrom @ solved).astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (softmax of the margins, 0 to 1) of each text."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for a in range(0, len(at), BATCH):
            part = at[a : a + BATCH]
            rows = np.stack([presence(texts[i]) for i in part]).astype(np.float32)
            margin = (rows @ self.weights) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
            p = np.exp(3.0 * (margin - margin.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, k, row in zip(part, best, p, strict=True):
                lang[i], score[i] = self.languages[k], float(row[k])
        return lang, score


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"lang": pdf["lang"], "bits": [np.packbits(presence(t)).tobytes() for t in pdf["text"]]})


def learn(
    docs: DataFrame, per_language: int = 400, most_languages: int = 64, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> StringKernelModel:
    """Model of the rows of ``docs`` that aren't held out and have text, letters, id and language.

    The sample holds ``per_language`` distinct texts of each of the
    ``most_languages`` languages with the most rows, or all that a language has,
    however often a text, an id or a language is repeated. Other columns are
    ignored. An empty table gives a model without languages.
    """
    pool = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("id")
    )
    hashed = pool.withColumn("draw", F.xxhash64(F.lit(seed), F.col("text")))
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw", 0.02).alias("texts"))
    counts = {r["lang"]: r["texts"] for r in sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return StringKernelModel.fit(np.zeros((0, SIZE), bool), [])
    # about twice as many distinct texts as are wanted pass the threshold, so enough do whatever the estimate's error
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * per_language / max(n, 1)))])
    drawn = hashed.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("lang")))
    each = drawn.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw"))
    sample = each.withColumn("place", first).where(F.col("place") <= per_language).select("text", "lang").mapInPandas(_profiles, "lang string, bits binary").collect()
    sample = sorted(sample, key=lambda r: (r["lang"], bytes(r["bits"])))
    rows = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool) for r in sample]) if sample else np.zeros((0, SIZE), bool)
    return StringKernelModel.fit(rows, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: StringKernelModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` without its text, with the predicted language and score; columns of these names give way.

    Null texts and texts without a letter get ``und`` and score 0, as do all
    texts of a model without languages. Only languages of the model are ever
    predicted, so none beyond the most frequent ones that ``learn`` takes. Repeated rows get equal predictions;
    equal scores go to the first language by code point. Texts of any length
    count in whole. An empty table gives an empty result.
    """
    found = _predicted(docs, model, F.col(text_col))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, lang_out, score_out)]
    (name,) = unused(docs, "found")
    return docs.select(*kept, found.alias(name)).select(*kept, F.col(name)["lang"].alias(lang_out), F.col(name)["score"].alias(score_out))


def _predicted(docs: DataFrame, model: StringKernelModel, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.predict(texts.to_list())
        return pd.DataFrame({"lang": lang, "score": score})

    return made(text, run, "lang string, score double")


def reject_unknown(docs: DataFrame, model: StringKernelModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept whatever their names, whose text has a language; rows of ``und`` go.

    Repeated rows stay or go together. An empty table gives an empty result.
    """
    (name,) = unused(docs, "found")
    found = docs.withColumn(name, _predicted(docs, model, F.col(text_col)))
    return found.where(F.col(name)["lang"] != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    frame = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(frame, model)
