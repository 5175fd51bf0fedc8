"""Training-data pipeline over documents: language ID, toxicity, n-gram Jaccard join, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written and read again as the
next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import jaccard_join, langid, packing, toxicity
from corpusmill.llm.common import shared_folder, table



def least_language_score(languages: int) -> float:
    """Below this score a language counts as unknown: with odds of 9 to 7 against each of the others, 0.3 of four languages."""
    return 9 / (9 + 7 * (max(languages, 1) - 1))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) and those whose language is uncertain."""
    model = langid.learn(docs)
    found = langid.predict(docs, model, keep_columns=True)
    return found.where((found["lang_pred"] != langid.UNDETERMINED) & (found["score"] >= least_language_score(len(model.languages)))).select(docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.5 or more."""
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), keep_columns=True)
    return found.where(found["toxicity"] < 0.5).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group that shares 0.8 of its five-word shingles or more, by links."""
    return jaccard_join.without_near_copies(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("ngram_jaccard_join", one_of_near_copies), ("packing", packed)]
ORACLE_SQL = None  # two stages learn from the data, and SQL doesn't encode tokens


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{number}_{name}")
            docs = spark.read.parquet(path)
    return docs
