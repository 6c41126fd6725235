"""The registered queries of this package: each operator over its whole table."""

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from metertide.llm.codes import codebooks_sha256, compress_vectors, with_label_error
from metertide.llm.conversations import repair_reports
from metertide.llm.imatch import edited_fingerprints
from metertide.llm.language import held_out, identify_languages, learn_languages
from metertide.llm.licenses import scan_licenses
from metertide.llm.mixing import mix_to_targets
from metertide.llm.packing import pack
from metertide.llm.quality import learn_quality, score_quality
from metertide.llm.simhash import near_duplicates
from metertide.llm.substrings import repeated_passages
from metertide.llm.topk import top_k
from metertide.llm.triejoin import jaccard_join
from metertide.llm.urls import judge_urls
from metertide.workspace import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 4, 2)
    langs, model = learn_languages(documents.filter(F.col("doc_id").isNotNull() & ~apart))
    return identify_languages(documents, langs, model).select(
        "doc_id", apart.alias("held_out"), "lang_pred", "score", "mixture"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=64, limit=3)
    digits = F.lpad(F.lower(F.hex("w0")), 16, "0")
    return found.select(
        "doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, apart = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = learn_quality(documents, table(spark, sf_dir, "labels").filter(~apart))
    return score_quality(documents, model).select(
        "doc_id", apart.alias("held_out"), "score", "predicted", "saved"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_error(materialize(coded, "vector-codes")).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_reports(table(spark, sf_dir, "conversations"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_top_k": op10_top_k,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}
