"""The corpus pipeline: each stage reads, as a Parquet table, what the one before it kept.

Language identification drops what it rejects; of each group of near copies the document of the
least id stays; repeated passages are cut out; documents that leak a benchmark item go; the rest
are encoded as byte-level BPE ids. All stages but the last return the columns of documents.

Defined results: documents without a letter, null and empty ones among them, are rejected with those
whose language isn't sure; with no language to learn from, all are. Rows without an id are judged like others, by
their text; of rows of equal id and text one stays at most. An empty table gives an empty table. Further columns
of documents are carried to the last stage, whatever their names, which returns its own columns alone. Each stage's docstring
says what its operator does with ties, long texts and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe, language_id, ngram_join, storage, substring_dedup, template_decontam


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from four fifths of the documents, by the CRC-32 of the id."""
    return language_id.keep_identified(docs, language_id.train_from_table(docs, ~language_id.held_out("doc_id", 5, 0)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of the ids and of the text decoded from them."""
    return byte_bpe.encode_table(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE encoding", encode),
]

#: Hashed subwords, MinHash bands and BPE merges are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with storage.Scratch(spark, "pipeline") as scratch:
        for k, (_, stage) in enumerate(STAGES):
            made = stage(spark, docs, sf_dir)
            made = scratch.result(made) if k == len(STAGES) - 1 else scratch.written(made, "stage")
            if k:
                scratch.drop(docs)
            docs = made
    return docs
