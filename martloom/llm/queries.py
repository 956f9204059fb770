"""The registered queries of this subpackage and the SQL that checks those which SQL can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.llm import alignment, ann, bpe, conversation_repair, line_dedup, packing, pii, secrets, simhash, substring_dedup, topk, toxicity, warc
from martloom.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[secrets.span_count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.span_text(True).cast("binary"), 256).alias("base_sha256"), secrets.span_text(False).alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, 5)


def op6_columns(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_columns(packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.span_count(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.span_text(kinds=pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"), pii.span_text().alias("spans"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(broken, "present", digest=True).withColumnRenamed("repaired", "repaired_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_substrings, op3_secrets, op4_toxicity, op5_topk, op6_packing, op7_simhash, op8_ann, op9_bpe, op10_pii, op11_lines, op12_conversations, op13_alignment)}
ORACLE: dict[str, str] = {"op1_warc": warc.oracle_sql(), "op11_lines": line_dedup.oracle_sql()}
