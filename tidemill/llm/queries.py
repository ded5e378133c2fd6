"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe, language_id, merkle, ngram_join, periodic_runs, reshard, simhash_golay, substring_dedup, suffix_tree_lm, template_decontam, toxicity, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.held_out("doc_id", 5, 0)
    found = language_id.predict(docs, language_id.train_from_table(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_groups(_table(spark, sf_dir, "documents"))


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.held_out("doc_id", 7, 2)
    found = suffix_tree_lm.score(_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "tree_score")


def op5_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old shard of a document is the hash of its source, so a large source fills one."""
    old_shard = F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "utf-8")), F.lit(16))
    return reshard.reshard(_table(spark, sf_dir, "documents"), old_shard, shards=16)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_table(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, with_ids=False)


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "first_word", "n_words", "kept_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train_from_table(docs, _table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.labelled_groups(), "url string, label string, word_group string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.model_from_table(labelled, group="word_group"), url_filter.RULES)


def op11_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_groups(_table(spark, sf_dir, "documents"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """id and text of documents; where h, the CRC-32 of the id, is a multiple of 10, the words from a = h / 10 modulo their number on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = F.try_mod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.transform(F.array(words), repeated)[0]  # the lambda's variable keeps the words from being found anew for each of them
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(planted, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.find_runs(_with_planted_runs(_table(spark, sf_dir, "documents"))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(_table(spark, sf_dir, "embeddings"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_template_decontamination": template_decontam.ORACLE_SQL, "op3_ngram_jaccard_join": ngram_join.ORACLE_SQL, "op7_merkle_fingerprint": merkle.ORACLE_SQL, "op8_substring_dedup": substring_dedup.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
