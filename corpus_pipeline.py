"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  What a stage decides takes effect:

* language: documents whose language is unknown (no letter, or a score below
  one half) go;
* lines: lines that are boilerplate of a document's source go from its text,
  and ``n_chars`` follows the text;
* near_duplicates: one document stays of each component of texts whose five-word
  shingles have a Jaccard similarity of 0.8 or more;
* decontamination: documents that hold a window of a benchmark item go;
* tokens: byte-level BPE ids, decoded again, as counts and digests.

``ORACLE_SQL`` is None: language scores, XXH64 shingles and BPE have no SQL;
the stages are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import byte_bpe, decontaminate, language_id, line_dedup, shingle_dedup
from deltaweave.llm.queries import token_digests
from deltaweave.llm.scratch import heaps_give_back, keep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn_from(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(docs, F.col("source"))
    n_chars = F.when(F.col("dropped_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_give_back(spark)
    return shingle_dedup.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_give_back(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_digests(byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
