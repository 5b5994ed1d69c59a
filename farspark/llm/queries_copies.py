"""Queries about copies of documents and of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farspark.llm import jaccard, substrings
from farspark.llm.registry import query
from farspark.llm.tables import table


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = F.transform("removed", lambda s: s["stop"] - s["start"])
    return cut.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.when(F.size("removed") > 0, substrings.as_text()("kept")).otherwise(F.col("text")).alias("text"))
