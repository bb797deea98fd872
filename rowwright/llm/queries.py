"""Registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosstok, feast, gam, imatch, lbl, linebloom, minmax, mixing, pseudonyms, recipes, sql, wordpiece, wrapper

#: A key for demonstration; a deployment passes its own secret.
KEY = b"replace this key"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, folder, "documents"), KEY)


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op3_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.main_texts(table(spark, folder, "pages"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return wordpiece.count_pieces(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op5_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = recipes.exact_copies(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_mix(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return gam.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


def op9_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.near_copies(table(spark, folder, "documents"))


def op10_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    return lbl.score_texts(table(spark, folder, "documents"))


def op11_feast(spark: SparkSession, folder: str) -> DataFrame:
    found = feast.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_common_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = linebloom.drop_common_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = crosstok.aligned(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), keep=lambda groups: F.sha2(groups, 256))
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (
    op1_pseudonyms, op2_byte_bpe, op3_wrapper, op4_token_counts, op5_exact_copies, op6_mix, op7_quality, op8_imatch,
    op9_near_copies, op10_log_bilinear, op11_feast, op12_common_lines, op13_token_alignment)}
SQL = {name: text for name, text in sql.SQL.items() if name in QUERIES}
