"""Toxicity, neighbours and exact search against plain numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from farspark.llm import exact_topk, neighbours, toxicity


def rows_with_oddities(n=600, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, dim)).astype(np.float32)
    vectors[200:420] = vectors[200]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows[10] = (10, None)
    rows[20] = (20, [float("nan")] + [0.5] * (dim - 1))
    rows[30] = (30, [float("inf")] + [0.5] * (dim - 1))
    rows[40] = (40, [None] + [0.5] * (dim - 1))
    rows[50] = (50, [0.0] * dim)
    rows[60] = (60, [])
    rows[70] = (70, [1.0, 2.0])
    return rows + [(None, [0.1] * dim), rows[5]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def whole(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def test_exact_top_k_equals_brute_force(spark):
    rows = rows_with_oddities()
    df = frame(spark, rows)
    got = {}
    for r in exact_topk.highest(df, df.filter("vec_id % 10 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and whole(v)}
    for q in (i for i in vectors if i % 10 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])))
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert set(got) == {i for i in vectors if i % 10 == 0 and len(vectors[i]) > 2}


def test_large_components_are_scored_in_integers():
    big = np.array([[2.0 ** 30, 3.0], [2.0 ** 30 + 1, 5.0], [1.0, 1.0]])
    found = dict(exact_topk.kernel(big, [[1], [2], [3]], big[:1], [1], 2))
    assert found[1] == [(2, 2 ** 30 * (2 ** 30 + 1) + 15), (3, 2 ** 30 + 3)]


def test_neighbours_find_what_brute_force_finds(spark):
    rows = rows_with_oddities(1500)
    df = frame(spark, rows)
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vectors = {i: np.array(v, np.float64) for i, v in rows if i is not None and whole(v) and any(v)}
    hits = total = 0
    for q in (i for i in vectors if i % 10 == 0 and len(vectors[i]) > 2):
        cosine = lambda v: float(v @ vectors[q] / (np.sqrt(v @ v) * np.sqrt(vectors[q] @ vectors[q])))
        best = sorted((-round(cosine(v), 12), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:5]
        assert len(got[q]) == 5 and all(abs(s - cosine(vectors[i])) < 1e-12 for i, s in got[q])
        hits += len({i for _, i in best} & {i for i, _ in got[q]})
        total += 5
    assert hits / total >= 0.9
    assert [i for i, _ in got[300]] == [200, 201, 202, 203, 204]
    assert not {10, 20, 30, 40, 50, 60, 70} & set(got)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_chi_square_of_two_degrees_is_exponential():
    assert abs(neighbours.chi_square(3.0, 2) - (1 - math.exp(-1.5))) < 1e-12 and neighbours.chi_square(1e6, 8) == 1.0


def test_windows_are_the_ngrams_of_words():
    text, bits = b"Ab, cde f", 17
    grams = set()
    folded = b" ab  cde f "
    for n in toxicity.SIZES:
        for i in range(len(folded) - n + 1):
            if b" " not in folded[i + 1:i + n - 1]:
                grams.add(folded[i:i + n])
    one = lambda g: toxicity.windows(np.frombuffer(g, np.uint8), len(g), bits)[0]
    assert set(toxicity.bag(text, bits)) == {one(g) for g in grams}
    long = b"lorem ipsum " * 40_000
    assert (toxicity.bag(long) == toxicity.bag(b"lorem ipsum lorem ipsum lorem ipsum")).all()


def toxic_corpus(n=500, seed=0):
    rng = np.random.default_rng(seed)
    clean = ["river", "stone", "cloud", "garden", "window", "letter", "market", "winter", "bridge", "music"]
    rude = ["blargface", "snurkface", "grumpwit", "snotwit"]
    rows = []
    for i in range(n):
        words = list(rng.choice(clean, 60))
        if i % 3 == 0:
            words[int(rng.integers(60))] = str(rng.choice(rude))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_learns_and_knows_unseen_misspellings(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert model.bias == again.bias and (model.weights == again.weights).all()
    fresh = toxic_corpus(200, 9)
    extra = [(1000, "river stone blarrgface window"), (1001, "river stone cloud window"), (1002, None), (1003, ""), (1004, "a")]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in fresh] + [(i, t, "x") for i, t in extra], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in fresh)
    assert right / len(fresh) > 0.95 and got[1000] > 0.5 > got[1001]
    assert all(0 <= s <= 1 for s in got.values()) and got[1002] == got[1003]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_without_two_classes_scores_the_prior(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).filter(F.col("score") >= 0.5).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).count() == 2
