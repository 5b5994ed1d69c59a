"""Queries that work on one document at a time, and those that deal documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farspark.llm import licenses, mixing, packing, token_counts as tc
from farspark.llm.registry import query
from farspark.llm.tables import table

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, BYTES).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, ["doc_id", "piece"])


@query("op7_license_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.size("phrases")
    base = F.transform("phrases", lambda h: h["label"])
    kept = F.transform("detections", lambda h: h["label"])
    starts = F.transform("phrases", lambda h: h["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, kept)).alias("labels"),
        F.when(n > 0, F.lit(licenses.PHRASE_SCORE)).otherwise(
            F.coalesce(F.array_max(F.transform("detections", lambda h: h["score"])), F.lit(0.0))).alias("score"))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), mixing.words(F.col("text")).alias("size"), F.array("source").alias("members"))
    mixed = mixing.mix(sized, ["doc_id", "text_hash"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tc.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
