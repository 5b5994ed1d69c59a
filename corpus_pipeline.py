"""The training-data pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame. All but the last return the
columns of `documents`. Documents are told apart by `doc_id` and a hash of their text, so null ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farspark.llm import jaccard, mixing, packing, substrings, toxicity
from farspark.llm.tables import held_out, table
from farspark.operators.settle import settle, temporaries

TOKENIZER = "byte_bpe_50k.json"
TOXIC_FROM = 0.5
#: A passage of just over fifty short words may have 150 bytes, so the operator's shortest strings are used.
PASSAGE_BYTES = 128


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from the labels that are not held out. A null text is scored as empty.

    What stays is settled here: that bounds the bytes a Python worker is sent at once, and so the memory the next stage finds taken.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return settle(toxicity.score(docs, model, name="_toxic").filter(F.col("_toxic") < TOXIC_FROM).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays, one without an id only where none has one.

    Documents are named by id and text hash, so repeated and null ids take nothing with them; of rows equal in both one stays.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), name.alias("_name"), F.col("text").alias("_text"))  # so that no column can clash
    with temporaries(spark):
        found = jaccard.near_duplicates(rows.select("_name", "_text"), key="_name", text="_text")
        stay = settle(found.filter(F.col("component_id") == F.col("_name")).select(F.col("_name").alias("_kept")).distinct(), keep=True)
    kept = rows.join(stay, F.col("_name") == F.col("_kept"), "left_semi").withColumns({"_id": F.col("_name.id"), "_hash": F.col("_name.hash")})
    return kept.dropDuplicates(["_id", "_hash"]).select("_doc.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again are cut out of the texts; characters cut in part go as a whole. No document goes.

    The result is settled here, as in `drop_toxic`: two functions in a row are two Python workers for each task.
    """
    with temporaries(spark):
        cut = substrings.remove_repeats(docs, length=PASSAGE_BYTES)
        changed = F.size("removed") > 0
        text = F.when(changed, substrings.as_text()("kept")).otherwise(F.col("text"))
        new = cut.withColumn("_text", text)
        return settle(new.select(*(
            F.col("_text").alias(c) if c == "text" else F.when(changed, F.length("_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars"
            else F.col(c) for c in docs.columns)), keep=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all up to three times."""
    names = {"_id": F.col("doc_id"), "_hash": F.xxhash64("text")}
    sized = docs.select(*(c.alias(n) for n, c in names.items()), mixing.words(F.col("text")).alias("size"), F.array("source").alias("members"))
    with temporaries(spark):
        mixed = mixing.mix(sized, ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.max("copies").alias("_copies"))
        copies = settle(mixed.filter("_copies > 0"), keep=True)
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    both = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), TOKENIZER)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained model and a hash-seeded choice are not for SQL; the pipeline is tested stage by stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name not in ("toxicity", "suffix_array_dedup", STAGES[-1][0]):  # these two are settled already
            docs = settle(docs)
    return docs
