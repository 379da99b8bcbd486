"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import fingerprints, licenses, merkle, mixing, quality, secrets, url_filter, vector_codes
from factlake.llm.cover_tree import near_pairs
from factlake.llm.common import stored
from factlake.llm.language_id import held_out, identify, language_model
from factlake.llm.ngram_join import ngram_join
from factlake.llm.packing import token_pieces, with_slots
from factlake.llm.token_counts import count_tokens

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.log_ratios(docs))
    base = F.filter("spans", lambda s: s.kind != "random")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans")
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), width=3, share=90)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    digests = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return with_slots(digests)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "lang_pred", "score")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_halves(_table(spark, sf_dir, "documents"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    finds, statements = F.col("finds"), F.col("statements")
    base = F.filter(finds, lambda f: f.kind == "base")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["word"]).alias("first_word"), F.array_max(base["word"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"), joined(F.concat(F.filter(finds, lambda f: f.kind != "exception")["label"], F.flatten(statements["labels"]))).alias("labels"),
        licenses.stated(finds, statements).alias("score"), licenses.freedom(finds, statements).alias("freedom"),
        F.array_join(F.filter(statements["form"], lambda f: f.isNotNull()), "; ").alias("expressions"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(fifth, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    found = merkle.merkle_manifest(_table(spark, sf_dir, "documents"), claimed={"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scans, op2_quality_classifier, op3_mixing_sources, op4_ngram_jaccard_join, op5_best_fit_packing, op6_token_counts, op7_embedding_near_dedup, op8_url_filters, op9_language_id, op10_document_fingerprints, op11_license_scans, op12_merkle_manifest, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing_sources": mixing.ORACLE, "op8_url_filters": url_filter.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
