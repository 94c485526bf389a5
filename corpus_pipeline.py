"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

language ID (documents without an identified language go) -> n-gram Jaccard join (one document
of each group stays) -> benchmark decontamination (contaminated documents go) -> mixing sources
(documents are repeated as often as the mix takes them) -> token-id output (the index of the
written files).
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import decontaminate, jaccard, language, mixing, queries, token_files
from skyledger.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found; null and letterless texts go."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents that are linked on five-word shingles at 0.8 (op5 takes three words and 0.9)."""
    return jaccard.keep_one(docs, size=5, share=Fraction(4, 5))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words stand in benchmark windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of the sources takes them."""
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mixed corpus, and their index by document."""
    folder = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), queries.END_ID)
    return token_files.read_index(spark, folder)


STAGES = [
    ("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources), ("token_ids", write_token_ids),
]

#: SQL can't express the language profiles, the recursive join and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
