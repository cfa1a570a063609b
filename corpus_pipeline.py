"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokens. Each stage reads what the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm import byte_bpe, exact_dedup, langid_ecoc, mixing, probminhash
from evidence_engine.plans.materialize import shared_dir

#: Texts of fewer bytes hold too few trigrams to be told from noise; they stay if they have a letter.
LEAST_BYTES = 20



def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, without a letter, or too far from every codeword. lang becomes the predicted one where it was null.

    The classifiers learn from the rows that have a language, and so does the limit: texts like nearly all of those stay.
    Without any such row, all texts with a letter stay.
    """
    model = langid_ecoc.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # the row goes through as one column, so that no name of it can clash with those of the prediction; the text goes beside it, once
    rest = [c for c in docs.columns if c.lower() != "text"]
    told = langid_ecoc.predict(docs.select("text", F.struct(*rest).alias("row")), model)
    limit = langid_ecoc.loss_limit(docs, model)
    fits = (F.col("loss") <= limit) | (F.octet_length("text") < LEAST_BYTES)
    kept = told.filter((F.col("lang_pred") != langid_ecoc.UNKNOWN) & fits)
    lang = F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang")
    return kept.select(*[lang if c.lower() == "lang" else F.col("text").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z, the row of the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id."""
    return probminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: weights 5, 2, 1, a budget of 150 % of the words, no document more than twice."""
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (binary, little-endian unsigned 32-bit), round_trip: whether the ids decode to the text."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.tokenized(docs, *vocabulary).select("doc_id", "source", "n_tokens", "ids", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: SQL cannot express the output codes of the first stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
