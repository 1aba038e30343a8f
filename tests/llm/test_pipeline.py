from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import pii
from sparkloom.llm._shared import stored
from sparkloom.llm.jaccard_join import jaccard_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "123", "en", None, 3)], docs.schema)
    docs, seen = docs.unionByName(odd), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir))
        seen[name] = (docs, out)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        docs = out
    assert list(seen) == ["language_id", "ngram_jaccard_join", "pii_surrogates", "source_mix", "sentencepiece"]
    before, after = seen["language_id"]
    assert {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()} == {10**6, 10**6 + 1}
    before, after = seen["ngram_jaccard_join"]
    want = {r.component_id for r in jaccard_components(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    before, after = seen["pii_surrogates"]
    both = before.select("doc_id", F.col("text").alias("old")).join(after, "doc_id")
    has = F.coalesce(F.size(pii.found_entities(F.col("old"))), F.lit(0)) > 0
    assert both.count() == before.count() and both.where(has != (F.col("old") != F.col("text"))).count() == 0
    before, after = seen["source_mix"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    _, ids = seen["sentencepiece"]
    assert ids.where("not round_trip").count() == 0 and ids.count() == after.count()


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_on_odd_tables(spark, sf_dir):
    names = ("row_id", "row_th", "stay_id", "found", "digest", "own_digest", "attempts", "shard", "place", "copy", "take", "m_id", "entities", "unit")
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(1) for c in names}).limit(40)
    for docs in (base.where("false"), base.unionByName(base)):
        empty = docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, sf_dir))
            assert out.isEmpty() == empty
            if name != "sentencepiece":
                assert out.columns == docs.columns and out.where(" or ".join(f"{c} <> 1" for c in names)).isEmpty()
            docs = out
