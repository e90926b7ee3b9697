"""A corpus pipeline over `documents` in five stages; each works on all rows that the one before it kept.

1. quality rules: rows that fail the base figures or the fertility bands go;
2. near-duplicates: SimHash groups of five-word shingles and what min-hashes add to them, every pair checked on whole sets of shingles: texts with a Jaccard similarity of 0.8 or more are linked transitively, and of each group the smallest id stays;
3. suffix-array dedup: byte strings of 50 that a smaller id has too are cut out; texts of which nothing is left go;
4. mixing: rows are sampled to source, language and topic targets at the tokens that came in; rows of rare cells repeat;
5. SentencePiece: the ids of each text, and the text that they decode to.

The mixing targets follow the stage's own tokens, flattened; a sampling stage is the only one that drops clean rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptsieve.llm import files, mixing, near_copies, pieces, quality, suffixes
from scriptsieve.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs, words=5)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can't express the tokenisers; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage returns is written to the shared folder and read again, and removed when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
        if k:
            files.remove(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
