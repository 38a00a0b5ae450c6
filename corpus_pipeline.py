"""The pipeline over `documents`: from raw texts to packed sequences, every stage a Spark job.

Each stage takes what its predecessor kept. All but the last return the columns of documents; n_chars
follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import jaccard, linededup, packing, pii, quality
from lavra.sources.scratch import written
from lavra.sources.tables import table

#: Key of the surrogates; a deployment sets its own.
PII_KEY = "pipeline"
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _like(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars counted anew where there is one."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; documents stay, with what is left of them."""
    return _like(linededup.drop_repeated_passages(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; documents stay."""
    return _like(pii.pseudonymise(docs, PII_KEY), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 4096 tokens."""
    with open(WORD_TOKENIZER, encoding="utf-8") as f:
        return packing.pack_documents(docs, f.read())


STAGES = [
    ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates),
    ("pii", pii_surrogates), ("best_fit_packing", packed),
]
#: The classifier's fit and the keyed and 64-bit hashes have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
