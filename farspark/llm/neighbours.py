"""Approximate nearest neighbours by low-dimensional stable projections.

Unit vectors are projected on a few Gaussian directions. For two vectors at distance d, the squared projected
distance over d squared follows a chi-square law with as many degrees of freedom. Projections are cut into the leaves of a
kd-tree; a query takes leaves by their projected distance, verifies their rows by true cosine, and stops once a row
nearer than its k-th best would have been projected inside the searched radius with probability `CONFIDENCE`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from farspark.llm import blocks

DIMENSIONS = 8
CONFIDENCE = 0.97
LEAF = 32
LEAVES_AT_ONCE = 8
SEED = 5


def chi_square(x: float, degrees: int) -> float:
    """Distribution function of the chi-square law for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    if half > 700:
        return 1.0
    for j in range(degrees // 2):
        total += term
        term *= half / (j + 1)
    return 1 - math.exp(-half) * total


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Leaves of a kd-tree: rows are halved at the median of the widest coordinate until `size` or fewer are left."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


def kernel(vectors, ids, queries, query_ids, k, dimensions=DIMENSIONS, confidence=CONFIDENCE):
    """Search one block of rows for each query of a block."""
    norms, lengths = np.sqrt((vectors * vectors).sum(1)), np.sqrt((queries * queries).sum(1))
    keep = norms > 0
    vectors, norms, ids = vectors[keep], norms[keep], [i for i, ok in zip(ids, keep) if ok]
    if not len(vectors):
        return
    directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], dimensions))
    points = vectors / norms[:, None] @ directions
    cells = leaves(points)
    order = np.concatenate(cells)
    ends = np.cumsum([len(c) for c in cells])
    low = np.array([points[c].min(0) for c in cells])
    high = np.array([points[c].max(0) for c in cells])
    vectors, norms = vectors[order], norms[order]
    for query, length, query_id in zip(queries, lengths, query_ids):
        if not length:
            continue
        at = query / length @ directions
        beyond = np.maximum(low - at, 0) + np.maximum(at - high, 0)
        far = (beyond * beyond).sum(1)
        turn = np.argsort(far)
        score, row, next_, batch = np.zeros(0), np.zeros(0, np.int64), 0, LEAVES_AT_ONCE
        while next_ < len(turn):
            got = np.concatenate([np.arange(ends[c] - len(cells[c]), ends[c]) for c in turn[next_:next_ + batch]])
            next_ += batch
            row = np.concatenate([row, got])
            score = np.concatenate([score, vectors[got] @ query / (norms[got] * length)])
            if len(row) > k + 1:
                # One more than k, in case the query itself is among them; a tie with the last one stays.
                cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                row, score = row[score >= cut], score[score >= cut]
                if next_ < len(turn):
                    kth = max(2 - 2 * min(1.0, float(cut)), 1e-12)
                    if chi_square(far[turn[next_]] / kth, dimensions) >= confidence:
                        break
        yield query_id, blocks.spread_ids([(float(s), ids[order[r]]) for s, r in zip(score, row)], query_id, k)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of largest cosine found for each query, itself left out: query_id, rank (from 1), vec_id, score.

    The cosine is that of the original vectors in double precision; ties go to the smaller id. Null, empty or zero vectors and
    those with a null or non-finite component take no part, as rows or as queries; so do null ids. With fewer than k
    candidates all of them come. Every row is indexed; other columns of the inputs are ignored; empty tables give none.
    """
    return blocks.search(rows, queries, k, kernel, "double", key, vector)
