"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents`` (doc_id, text, lang, source, n_chars), so a stage can be left out or run alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import mixing, secrets
from factlake.llm.common import stored
from factlake.llm.language_id import identify, language_model
from factlake.llm.ngram_join import ngram_join
from factlake.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: n-grams of so many words, at least so similar (per cent).
WORDS, SHARE = 5, 80
#: Tokenizer of the packed sequences, and their length.
TOKENIZER, SEQUENCE = "word_bpe_49k.json", 2048


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach.

    Texts without letters (null and empty ones among them) go, and so do those in which half of what the
    strangest labelled text knows of the learned languages' 3-grams is not reached. Where no row is
    labelled nothing can be told and texts go; an empty table stays empty; repeated rows and rows without
    an id are judged alike; texts are read whole.
    """
    model = language_model(docs)
    found = identify(docs.select(*COLUMNS), model, COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("familiar") >= model.least_familiar)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates, once.

    Null, empty and blank texts link with nothing and stay, as do rows that no id names. Of rows that
    share an id each different text stays once, with the smallest of its other columns. Texts are
    compared whole; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    groups = ngram_join(docs, width=WORDS, share=SHARE)
    kept = stored(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    once = docs.join(kept.where("n = 1"), "doc_id", "left_semi")
    often = docs.join(kept.where("n > 1"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return once.select(*COLUMNS).unionAll(often.select("doc_id", "text", "rest.*")).unionAll(docs.where("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by ``[REDACTED]``; documents without any stay as they are.

    A null text counts as empty and becomes so; repeated rows stay repeated; texts are read whole; an
    empty table stays empty.
    """
    ratios = secrets.log_ratios(docs)
    found = secrets.scan_secrets(docs, ratios, keep=["doc_id", "lang", "source", "n_chars"])
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw each source to an equal share of the mix; a document may stand in it several times or not at all.

    Rows without a source are a source of their own; rows without an id, and rows that share one, share a
    draw. Texts, null ones too, are carried along unread; an empty table stays empty.
    """
    return mixing.mix_sources(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences: one row for each piece, with its identifiers and its place.

    A null or empty text is one piece with the end mark alone; long ones are cut into full pieces and a
    rest; repeated rows are packed as often as they stand there; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path(TOKENIZER), SEQUENCE)


STAGES = [
    ("language", language_stage),
    ("ngram_dedup", dedup_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither the language model nor packing is SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
