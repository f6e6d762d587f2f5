"""Corpus pipeline: five stages over ``documents``, each one operator.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; ``run`` writes every stage's result as Parquet into the shared
checkpoint folder and reads it again. All but the last return the columns of
``documents``:

1. ``language_id``: rows whose language cannot be told (no letters, or a score
   under 0.3) go.
2. ``simhash_near_dedup``: of each group of near-duplicates (three-word shingles,
   at most three differing bits) the smallest id stays.
3. ``suffix_array_dedup``: 200-byte strings that occur earlier are cut out of the
   text, keeping the first copy; ``n_chars`` becomes the length of what is left.
4. ``benchmark_decontamination``: documents that hold a benchmark item go.
5. ``sentencepiece``: identifiers of the text, and the text they decode to.

Null and empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectio.llm import common, decontaminate, encode, language, simhash, suffix_dedup

PIECES = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, min_score=0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, size=3, bits=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.clean_texts(docs, length=200, mode="first")
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode.encode(docs.select("doc_id", "text", "lang", "source"), common.tokenizer_path(PIECES)).select("doc_id", "lang", "source", "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

# SQL can express neither the fitted language model nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        # What a stage wrote on its way goes when its result is written.
        with common.scratch(spark) as tables:
            docs = tables.keep(stage(spark, docs, sf_dir))
    return docs
