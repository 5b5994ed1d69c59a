"""Exact search for the highest integer inner products by pivot tables.

Each row keeps its distances to many pivots. By the triangle inequality the distance of a query to a row is at
least the largest difference of their distances to a pivot, and an inner product follows from the distance and the two norms:
a lower bound for the one is an upper bound for the other. Rows are evaluated in the order of their bounds until no bound
reaches the k-th best score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from farspark.llm import blocks

PIVOTS = 32
AT_ONCE = 256
SCALE = 1024
#: Below this a double holds every partial sum of products exactly.
SAFE = 1 << 21


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the row whose nearest pivot is furthest."""
    first = vectors - vectors.mean(0)
    picked = [int(np.argmax((first * first).sum(1)))]
    gap = np.full(len(vectors), np.inf)
    while len(picked) < min(n, len(vectors)):
        away = vectors - vectors[picked[-1]]
        gap = np.minimum(gap, (away * away).sum(1))
        picked.append(int(np.argmax(gap)))
    return vectors[picked]


def kernel(vectors, ids, queries, query_ids, k, pivots=PIVOTS):
    """Search one block of rows for each query of a block."""
    exact = max(np.abs(vectors).max(), np.abs(queries).max()) < SAFE
    as_int = vectors.astype(np.int64)
    chosen = choose_pivots(vectors, pivots)
    squares = (vectors * vectors).sum(1)
    table = np.sqrt(np.maximum(squares[:, None] + (chosen * chosen).sum(1) - 2 * vectors @ chosen.T, 0)).T.copy()
    for query, query_id in zip(queries, query_ids):
        own = float(query @ query)
        to_pivot = np.sqrt(((chosen - query) ** 2).sum(1))
        least = np.zeros(len(vectors))
        for distances, d in zip(table, to_pivot):
            np.maximum(least, np.abs(distances - d), out=least)
        # Rounding of the distances is far below one part in a hundred million.
        bound = (own + squares - least * least) / 2 + 1e-8 * (own + squares) + 1
        turn = np.argsort(-bound)
        score, row, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(turn):
            got = turn[at:at + AT_ONCE]
            at += AT_ONCE
            new = np.rint(vectors[got] @ query).astype(np.int64) if exact else as_int[got] @ query.astype(np.int64)
            row, score = np.concatenate([row, got]), np.concatenate([score, new])
            if len(row) > k + 1:
                cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                row, score = row[score >= cut], score[score >= cut]
                if at < len(turn) and bound[turn[at]] < cut:
                    break
        yield query_id, blocks.spread_ids([(int(s), ids[r]) for s, r in zip(score, row)], query_id, k)


def scaled(vector: Column) -> Column:
    """Every component x as floor(1024 * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def highest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest integer inner products for each query, itself left out: query_id, rank (from 1), vec_id, score.

    Exact; ties go to the smaller id. Null or empty vectors and those with a null or non-finite component take no part, as rows
    or as queries; so do null ids. With fewer than k candidates all of them come. Other columns of the inputs are
    ignored; empty tables give none. Scores are 64-bit.
    """
    whole = [df.filter(blocks.finite(vector)).select(F.col(key), scaled(F.col(vector)).alias(vector)) for df in (rows, queries)]
    return blocks.search(*whole, k, kernel, "long", key, vector)
