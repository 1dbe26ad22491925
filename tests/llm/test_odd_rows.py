"""Rows that real tables hold: uneven and repeated ids, clashing names, very long texts."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import fingerprint, langid, quality, simhash, suffix_dedup

from test_fingerprint import check

SF = "/root/testdata/sf0.001"


def test_fingerprint_of_uneven_ids(spark, monkeypatch):
    far = [(-(1 << 63), "lowest", "x"), ((1 << 63) - 1, "highest", "x"), ((1 << 62) + 1, "a b a b", "x")]
    near = [(k, f"text {k % 5} of {k}", "x") for k in range(40)]
    check(spark, near + far, monkeypatch, 5)
    check(spark, near + far + [(None, "no id", "x")] * 3 + [(7, "again", "x")] * 12, monkeypatch, 5)


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PER_LANG", 20)
    seen = []
    monkeypatch.setattr(langid, "Model", lambda langs, weights: None)
    monkeypatch.setattr(langid, "train", lambda texts, langs, n: seen.append(len(texts)))
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    langid.fit(hot)
    assert 1 <= seen[0] <= 60


def test_quality_sample_takes_an_id_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "Model", lambda texts, labels: seen.append(texts))
    docs = spark.range(500).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1)], "doc_id long, quality int")
    quality.fit(docs, labels)
    assert seen == [["text 0", "text 1"]]


def test_repeats_of_rows_without_an_id(spark):
    shared = "the same passage stands in several rows that have no id, and it is longer than a hundred bytes by far " * 2
    rows = [(1, shared), (None, shared + "one"), (None, "two " + shared), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.deduplicate(df).collect()}
    assert found[None, len(shared) + 3] >= len(shared) and found[None, len(shared) + 4] >= len(shared) and found[None, 0] == 0


def test_stages_carry_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit(1)).withColumn("predicted", F.lit(None).cast("string")).withColumn("t", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF).cache()
        assert docs.count() and docs.filter("score = 'own' AND lang_pred = 1 AND predicted IS NULL AND t = 2").count() == docs.count()
    assert docs.schema["score"].dataType.simpleString() == "string"


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 200_000))
    df = spark.createDataFrame([(1, long, "en"), (2, long[1000:], "en"), (3, "x" * 1_000_000, "en"), (4, "short text", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_bytes for r in suffix_dedup.deduplicate(df).collect()} == {1: len(long), 2: len(long) - 1000, 3: 1_000_000, 4: 10}
    assert {r.doc_id for r in simhash.simhash_components(df).collect()} == {1, 2, 3, 4}
    assert {r.doc_id: r.n_chars for r in fingerprint.fingerprint_documents(df).collect()} == {1: len(long), 2: len(long) - 1000, 3: 1_000_000, 4: 10}
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"en"}
