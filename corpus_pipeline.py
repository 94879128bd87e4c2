"""A corpus pipeline of five operators: toxicity, language, near duplicates, benchmark passages, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcensus.llm import bpe, decontamination, jaccard, langid, toxicity
from linkcensus.llm.common import remainder, stored

#: A document is rejected if its language is unknown or has less than this part of the evidence.
LEAST_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, by a model of the labelled ones that are not held out.

    An empty table or one without labels rejects nothing. Null and empty texts stay.
    """
    model = toxicity.train(docs.filter(remainder("doc_id", 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.scored(docs, model, into="_toxicity")  # a column `score` of the table stays as it is
    return scored.filter("_toxicity < 0.5").select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; those without a letter, or with a weak verdict, go."""
    model = langid.train(docs.filter(remainder("doc_id", 5) != 0))
    found = langid.identify(docs, model, into=("_lang_pred", "_lang_score"))
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return jaccard.one_of_each_group(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, and digests of them and of the bytes decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.with_tokens(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(encoded, "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("byte_bpe", tokens),
]

#: SQL can express neither the learnt models nor the token merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
