"""The corpus pipeline: language ID, quality, near-duplicates, suffix-array
deduplication and packing, each over all that the stage before it kept.

All stages but the last return the columns of documents. A null table or column follows
the operators' own rules; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import langid, near_copies, packing, quality, simhash, suffix_dedup
from sluice.llm.common import released, table, written
from sluice.llm.entries import tokenizer_path

#: Least confidence of a language, least quality score.
SURE = 0.3
GOOD = 0.3


def apart(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs under names that no result column has, and the names of its id and text."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the recurrent network names with confidence SURE;
    `und` (no letters, no text) goes. It is learnt from the documents given."""
    model = langid.fit(docs)
    own, id_, text = apart(docs)
    found = langid.predict(own, model, text_col=text, id_col=id_, carry=[c for c in own.columns if c != id_])
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(own.columns).toDF(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of GOOD or more, learnt from the labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own, id_, text = apart(docs)
    found = quality.score(own, model, text_col=text, id_col=id_, carry=[c for c in own.columns if c != id_], threshold=GOOD)
    return found.filter("predicted = 1").select(own.columns).toDF(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops near copies (five-word shingles, Jaccard of 0.8 or more) of documents of a
    smaller id: those that op8's fingerprints group with one, verified on the whole sets of shingles, and then
    those that differ in more bits than its search reaches."""
    return near_copies.keep_one(simhash.keep_one(docs, verify=near_copies.copies_of))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that an earlier document, or the same one earlier, has."""
    return suffix_dedup.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("repeats", unrepeated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        released(spark)
    return docs


#: The trained models and the packing can't be expressed in SQL; tests/llm/test_pipeline.py
#: holds the stages against plain versions.
ORACLE_SQL = None
