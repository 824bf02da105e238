"""The registered queries: each operator over its whole table, with production
parameters.  They derive the columns of their contracts from what the operators
return and add no path of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (binpacking, fingerprints, licenses, lines, lm, negatives, packing, pieces, quality, rules, simhash,
               spelling, tokenfiles)
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(documents(spark, sf_dir))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), "byte")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_token_files(documents(spark, sf_dir), tokenfiles.token_folder(spark),
                                            tokenizer_path("word_bpe_49k.json"), "word")
    return tokenfiles.read_token_files(manifest)


def op5_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, documents(spark, sf_dir, "labels"), lambda d: not quality.held_out(d))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(documents(spark, sf_dir))


def op9_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_and_decode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.quantised(rows.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


def op12_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpacking.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), "byte")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lz_fingerprints, op2_hilbert_packing, op3_line_dedup, op4_token_files,
                            op5_quadratic_discriminant, op6_line_first_rules, op7_elias_fano_lm,
                            op8_license_compression, op9_streaming_viterbi, op10_simhash_groups, op11_shared_list_negatives,
                            op12_grouping_packing, op13_spelling_variants, pipeline)}
