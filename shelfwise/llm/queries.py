"""The driver's queries of this package: each applies one operator, with production
parameters, to its whole table and derives the contract's columns from the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    ann, best_fit_packing, decontamination, jaccard_join, language_id, lexical, license_scan, lm_scoring, merkle, quality,
    secret_scan, sharding, substring_dedup)
from shelfwise.llm.common import held_out, table
from shelfwise.llm.oracle import ORACLE_SQL

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs)).select("doc_id", "spans")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans) -> F.Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed("spans").alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = quality.training_labels(table(spark, sf_dir, "labels"))
    held = held_out(F.col("doc_id"), 4, 2).alias("held_out")
    return quality.judge(docs, labels, quality.fit(docs, labels)).select("doc_id", held, "host", "path", "n_words", "doc_quality", "site_quality", F.col("quality_score").alias("score"),
                                                                         "doc_toxic", "site_toxic", "toxic_score", "keep")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 7, 2)
    scored = lm_scoring.score_documents(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return sharding.uniform_shards(rows, "doc_id", 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.document_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(n_chars: F.Column) -> F.Column:
        return merkle.digest(merkle.field_text(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))

    changed = F.when(held_out(F.col("doc_id"), 7, 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), leaf(changed).alias("now"))
    known = merkle.manifest(leaves, "leaf", "lang", ["doc_id"])
    folded = known.withColumn("folded_root", merkle.fold(F.col("now"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_substring_dedup, op3_best_fit_packing, op4_quality, op5_jaccard_join, op6_lm_scoring, op7_sharding,
    op8_decontamination, op9_language_id, op10_ann, op11_lexical_search, op12_merkle, op13_license_scan)}

__all__ = ["ORACLE_SQL", "QUERIES"]
