"""A stated query set against all rows, in blocks of bounded size.

Rows are dealt into blocks of about `BLOCK_ROWS`, queries into blocks of about `QUERY_ROWS`, and every pair of blocks is
one task's work: what a task holds does not grow with either table. Equal vectors are one row with the smallest ids that
can be in any answer, so a vector that fills a third of a table costs no more than another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
SALTS = 16
RESULT = "query_id long, vec_id long, score {0}"


def finite(vector: str) -> Column:
    """Vectors that take part: not null or empty, all components there and finite."""
    value = F.col(vector)
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return value.isNotNull() & (F.size(value) > 0) & F.coalesce(good, F.lit(False))


def distinct_vectors(rows: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """One row per vector: `vec` and `ids`, its `keep` smallest distinct ids in order. Limits apply before each shuffle."""
    rows = rows.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("vec")).filter(F.col("_id").isNotNull())
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    for part in (["vec", "_salt"], ["vec"]):
        rows = rows.withColumn("_n", F.dense_rank().over(W.partitionBy(*part).orderBy("_id"))).filter(F.col("_n") <= keep).drop("_n")
    return rows.groupBy("vec").agg(F.array_sort(F.collect_set("_id")).alias("ids"))


def vectors_of(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def spread_ids(best: list[tuple], own: int, k: int) -> list[tuple]:
    """The k best (score, id) of classes (score, ids), without the query itself: higher score first, then smaller id."""
    found = [(-score, i) for score, ids in best for i in ids if i != own]
    return [(i, -s) for s, i in sorted(found)[:k]]


def search(rows: DataFrame, queries: DataFrame, k: int, kernel: Callable, score_type: str, key: str, vector: str,
           block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best rows for each query: query_id, rank, vec_id, score.

    `kernel(vectors, ids, query_vectors, query_ids, k)` yields (query id, [(id, score)]) for one pair of blocks. Only vectors
    of the query's length are candidates. Repeated ids of equal vectors count once.
    """
    from farspark.operators.settle import settle

    classes = settle(distinct_vectors(rows.filter(finite(vector)), key, vector, k + 1).withColumn("dim", F.size("vec")))
    asked = settle(queries.filter(finite(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("query_id"), F.col(vector).alias("vec")).dropDuplicates().withColumn("dim", F.size("vec")))
    n_blocks = max(1, -(-classes.count() // block_rows))
    n_query = max(1, -(-asked.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = classes.withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(n_blocks)).cast("int")).withColumn("q_block", every(n_query))
    right = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int")).withColumn("block", every(n_blocks))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            ids = a.column("ids").to_pylist()
            for query, best in kernel(vectors_of(a, "vec"), ids, vectors_of(b, "vec"), b.column("query_id").to_pylist(), k):
                out += [(query, i, s) for i, s in best]
        kind = pa.int64() if score_type == "long" else pa.float64()
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind)],
                        names=["query_id", "vec_id", "score"])

    cells = ["dim", "block", "q_block"]
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(pair, RESULT.format(score_type))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
