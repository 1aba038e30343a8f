import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import language_id, quality_model
from sparkloom.llm.language_id import StringKernelModel, presence


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    texts = [(1, "the cat and the dog", "en"), (3, "le chat et le chien", "fr"), (4, "the dog and a cat", "en"), (5, "un chien et un chat", "fr")] * 3
    docs = spark.createDataFrame([(i, t, l, 0.5) for i, (_, t, l) in enumerate(texts)], "doc_id long, text string, lang string, score double")
    m = language_id.learn(docs)
    assert m.languages == ["en", "fr"]
    odd = spark.createDataFrame([(1 << 60, None, None, 1.0), (None, "123 !?", "x", 1.0), (2, "", "x", 1.0), (2, "le chat", "x", 1.0), (3, "the dog " * 50000, "x", 1.0)], docs.schema)
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.identify(odd, m).collect())
    assert got == [("1152921504606846976", "und"), ("2", "fr"), ("2", "und"), ("3", "en"), ("None", "und")]
    kept = language_id.reject_unknown(odd, m)
    assert kept.columns == docs.columns and kept.count() == 2
    none = language_id.learn(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}


def test_kernel_map_matches_plain_ridge():
    """With all texts as landmarks the map scores as plain kernel ridge regression on n-gram sets."""
    texts = ["aa bb", "aa bc", "xx yy", "xy yy", "aa ab bb", "yy xx x"]
    labels = ["a", "a", "x", "x", "a", "x"]
    m = StringKernelModel.fit(np.stack([presence(t) for t in texts]), labels, landmarks=12)
    queries = ["aa bb cc", "yy xx zz", "bb", "x y aa"]

    def grams(t):
        return {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}

    def kernel(s, t):
        return len(grams(s) & grams(t)) / np.sqrt(len(grams(s)) * len(grams(t)))

    y = np.array([[1.0, -1.0] if x == "a" else [-1.0, 1.0] for x in labels])
    k = np.array([[kernel(s, t) for t in texts] for s in texts])
    # weights 1/3 for each row (three rows a language)
    alpha = np.linalg.solve(k + 1e-3 * 3 * np.eye(len(texts)), y)
    want = np.array([[kernel(q, t) for t in texts] for q in queries]) @ alpha
    rows = np.stack([presence(q) for q in queries]).astype(np.float32)
    got = rows @ m.weights / np.sqrt(rows.sum(1, keepdims=True))
    assert np.abs(got - want).max() < 0.02
    assert m.predict(queries[:2])[0] == ["a", "x"]
    a, b = presence("abab"), presence("ab")
    assert a.sum() > b.sum() and (a & b).sum() == b.sum()
    assert (presence("q" * 10) == presence("q" * (language_id.STEP * 2 + 7))).all()


def test_samples_are_bounded(spark):
    """Repeated ids, texts and languages don't make the sample grow."""
    from pyspark.sql import functions as F

    many = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("the dog "), (F.col("id") % 900).cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 90).cast("string")).alias("lang"), F.lit(1).alias("found"), F.lit(2).alias("_found"))
    m = language_id.learn(many, per_language=5, most_languages=3)
    assert len(m.languages) == 3
    found = language_id.identify(many, m)
    assert found.columns == ["doc_id", "lang", "found", "_found", "lang_pred", "score"] and found.where("found <> 1 or _found <> 2").count() == 0
    kept = language_id.reject_unknown(many, m)
    assert kept.columns == many.columns and kept.where("_found <> 2").count() == 0
    assert language_id.identify(many.where("false"), m).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    real = quality_model.BoostedTrees.fit
    quality_model.BoostedTrees.fit = classmethod(lambda cls, x, y: seen.append(len(y)) or real(x, y))
    try:
        model = quality_model.learn(many, labels, sample_rows=50)
    finally:
        quality_model.BoostedTrees.fit = real
    assert seen == [50]
    assert quality_model.score(many, model).columns == ["doc_id", "lang", "found", "_found", "score", "predicted"]


def test_statistics_equal_plain_ones():
    import math

    texts = ["Aa bb, c9 Aa bb, c9 x!\nshort\nshort\n", "one", "É É É É", "a\tb  c\x0b#$ \"q\" 'r' AAAA.\n" * 3, "ÀB éé?  !! 123 4,5 a_b " * 7]
    for t in texts:
        raw, words, lines = t.encode(), t.split(), t.split("\n")
        n, w, k = len(t), len(words), len(lines)
        share = lambda chars: sum(b in chars for b in raw) / n
        sizes = [len(x) for x in words]
        mean = sum(sizes) / w
        triples = [tuple(words[i : i + 3]) for i in range(w - 2)]
        run = best = 1
        for a, b in zip(raw, raw[1:]):
            run = run + 1 if a == b else 1
            best = max(best, run)
        low, up = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        want = [
            math.log1p(n), math.log1p(w), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / w), share(low + up), share(b"0123456789"), share(up), share(b".,;:!?"),
            share(b"#*$%&|<>~^=_\\{}[]@+/"), share(b"\"'()"), share(b" \t\n\x0b\x0c\r"), share(bytes(range(0xC0, 0x100))), math.log1p(k), n / k, sum(len(x) < 30 for x in lines) / k,
            1 - len(set(lines)) / k, len(set(words)) / w, max(words.count(x) for x in words) / w, 1 - len(set(triples)) / len(triples) if triples else 0,
            sum(s <= 3 for s in sizes) / w, sum(x.isupper() for x in words) / w, sum(not x[0].isalpha() for x in words) / w, sum(not x[-1].isalnum() for x in words) / w,
            math.log1p(best), w / (1 + sum(b in b".!?" for b in raw)),
        ]
        assert np.allclose(quality_model.statistics(t), want), t
    assert not quality_model.statistics(None).any() and not quality_model.statistics("").any()


def test_first_tree_equals_a_plain_search():
    """The root of the first tree is the split of the greatest gain over all features and values; its leaves are regularised means."""
    r = np.random.default_rng(8)
    x, y = r.integers(0, 9, (60, 3)).astype(float), r.integers(0, 2, 60).astype(float)
    m = quality_model.BoostedTrees.fit(x, y, trees=1, depth=1, least=5)
    p = y.mean()
    g, h = p - y, np.full(60, p * (1 - p))
    gain = lambda a: g[a].sum() ** 2 / (h[a].sum() + 1)
    best = max((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(3) for c in np.unique(x[:, f]) if 5 <= (x[:, f] <= c).sum() <= 55)
    f, c = m.feature[0, 0], m.threshold[0, 0]
    left = x[:, f] <= c
    assert f == best[1] and (left == (x[:, f] <= best[2])).all()
    assert np.allclose(m.leaf[0], [-g[a].sum() / (h[a].sum() + 1) for a in (left, ~left)])


def test_quality_held_out(spark, sf_dir):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_model.op9_quality_classifier(spark, "/root/testdata/sf0.01").join(lab, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "word " * 40000, 1), (3, "a", 1)], "doc_id long, text string, predicted int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.learn(docs, none)
    got = quality_model.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and {r.score for r in got.collect()} == {0.5}
    assert quality_model.score(docs.where("false"), model).count() == 0


def test_trees_learn_a_rule():
    r = np.random.default_rng(2)
    x = r.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    m = quality_model.BoostedTrees.fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    # flat traversal equals a walk node by node
    for row, p in zip(x[:20], m.score(x[:20]), strict=True):
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf, strict=True):
            n = 0
            while n < len(f):
                n = 2 * n + 1 + int(row[f[n]] > t[n])
            total += m.rate * leaf[n - len(f)]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-9


def test_folds(spark):
    import zlib

    got = spark.range(50).select("id", language_id.held_out("id").alias("h"), language_id.held_out("id", 5, 0).alias("q")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) and r.q == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert spark.range(1).select(F.lit(None).cast("long").alias("i")).select(language_id.held_out("i")).first()[0] is False


def test_sample_goes_by_distinct_texts(spark, monkeypatch):
    """A text that fills most of a language leaves the sample as large as other languages' samples."""
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    many = spark.range(60_000).select("id", F.lit("the one text that is said over and over").alias("text"), F.lit("en").alias("lang"))
    some = lambda lang, first: spark.range(first, first + 900).select("id", F.concat(F.lit(f"{lang} words "), letters).alias("text"), F.lit(lang).alias("lang"))
    docs = many.unionByName(some("en", 100_000)).unionByName(some("de", 200_000)).withColumnRenamed("id", "doc_id")
    seen, real = [], StringKernelModel.fit
    monkeypatch.setattr(StringKernelModel, "fit", lambda rows, names, *more: seen.append(list(names)) or real(rows, names, *more))
    language_id.learn(docs)
    assert {x: seen[0].count(x) for x in set(seen[0])} == {"en": 400, "de": 400}
