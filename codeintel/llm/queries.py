"""The queries of the ten operators over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, matroska, near_dup, packing, pii, secrets, token_counts, token_files, toxicity
from .common import table

#: A deployment passes its own; pseudonyms link only what has the same key.
PII_KEY = "demonstration-key"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY)


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_id_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op7_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op8_token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


QUERIES = {f.__name__: f for f in (op1_matroska, op2_line_blocks, op3_feistel_pseudonyms, op4_latent_decontamination, op5_secret_ownership, op6_token_files, op7_toxic_crf, op8_token_sections, op9_minhash, op10_best_fit)}


ORACLE_SQL: dict[str, str] = {}
