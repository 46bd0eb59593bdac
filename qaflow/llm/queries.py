"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, decontaminate, html_crf, huffman_tokens, jaccard_join, kd_shards, line_templates, phrases, simhash, superminhash, toxicity, warc, whitening
from .common import table


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_tokens.read_tokens(spark, huffman_tokens.write_tokens(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(spark, warc.archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_decode(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


Q = {
    f.__name__: f
    for f in (op1_line_templates, op2_huffman_tokens, op3_decontaminate, op4_warc, op5_kd_shards, op6_jaccard_join, op7_bpe_tree, op8_simhash, op9_toxicity, op10_html_crf, op11_whitening, op12_phrases, op13_superminhash)
}
ORACLES = {"op1_line_templates": line_templates.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op4_warc": warc.ORACLE, "op6_jaccard_join": jaccard_join.ORACLE, "op12_phrases": phrases.ORACLE, "op13_superminhash": superminhash.ORACLE}
