"""From raw documents to token ids: quality, near duplicates, decontamination, mixture, binary output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as
Parquet in the shared folder and reads it as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamella.llm.common import stored
from lamella.llm.decontaminate import drop_contaminated
from lamella.llm.mixing import sample
from lamella.llm.ngram_join import keep_one
from lamella.llm.quality import keep_good
from lamella.llm.token_output import new_container, read_summaries, write_tokens

#: The share of tokens that the mixture keeps.
BUDGET = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at least 0.8 alike in their sets of five words, the document of the smallest id stays."""
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that source, language and topic meet their target shares of tokens."""
    return sample(docs, budget=BUDGET)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written and read back: doc_id, start, n_tokens, ids_crc32, n_bytes."""
    return read_summaries(spark, write_tokens(docs, new_container(spark), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_documents.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
