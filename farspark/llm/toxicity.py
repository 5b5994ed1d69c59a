"""Toxicity from subword bags: character n-gram embeddings, averaged, under a linear softmax.

An n-gram is a window of bytes of a lower-cased text, within a word or with the gap on either side of it. It is hashed to
a bucket, and a text is the bag of its distinct buckets: their embeddings are averaged and go into a softmax of two classes. Distinct,
because a long text repeats its common n-grams and would drown a few rare ones. Embeddings and softmax are trained together in
numpy on the driver, from a bounded sample: `SAMPLE` labelled rows of each class, those with the smallest hash of their
id. In training every step sees half of each bag, so no word is known by a single n-gram, and a misspelling that was
never seen shares enough of them. The bias is set on a fifth of the sample that took no part.

Average and softmax are linear, so a fitted model is one number per bucket and a bias. Each row is scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farspark.llm.workers import releasing
from farspark.operators.settle import settle

SAMPLE = 4000
#: Distinct n-grams of a training text that reach the driver; a text of over ten thousand words has more.
MOST_NGRAMS = 1 << 14
BUCKET_BITS = 17
SIZES = (3, 4, 5)
DIM = 4
EPOCHS = 8
#: A small sample is gone through more often, up to so many steps.
MIN_STEPS = 150
BATCH = 256
RATE = 0.05
GAIN = 30.0
SEEN = 0.5
#: Windows handled at once, which bounds memory whatever the length of a text.
STEP = 1 << 18

_GAP = 32
_FOLD = np.full(256, _GAP, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[[36, 42, 64]] = [36, 42, 64]  # $ * @ stand in for letters


def windows(part: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Buckets of the windows of `size` bytes whose gaps are at their ends only."""
    n = len(part) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = part.astype(np.uint32)
    value = np.full(n, size, np.uint32)
    for i in range(size):
        value = value * np.uint32(0x01000193) ^ code[i:i + n]
    gap = part == _GAP
    inside = gap[1:1 + n].copy()
    for i in range(2, size - 1):
        inside |= gap[i:i + n]
    value = value[~inside]
    value ^= value >> np.uint32(15)
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def bag(text: bytes | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """The distinct buckets of one text, in order."""
    there = np.zeros(1 << bits, bool)
    buf = _FOLD[np.frombuffer(b" " + (text or b"") + b" ", np.uint8)]
    for at in range(0, len(buf), STEP):
        part = buf[at:at + STEP + max(SIZES) - 1]
        for size in SIZES:
            there[windows(part, size, bits)] = True
    return np.flatnonzero(there).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Logit = bias + mean of `weights` over the distinct buckets of a text."""

    weights: np.ndarray
    bias: float
    bits: int = BUCKET_BITS

    def logit(self, buckets: np.ndarray) -> float:
        return self.bias + (float(self.weights[buckets].mean()) if len(buckets) else 0.0)


def cut_point(logits: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """The logit that parts the classes with the fewest expected errors where label 1 has the share `prior`."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum()) * prior
    wrong = np.concatenate([[0], np.cumsum(1 - y)]) / max(1, (1 - y).sum()) * (1 - prior)
    cost = missed + (1 - prior) - wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def train(bags: Sequence[np.ndarray], labels: np.ndarray, prior: float, bits: int = BUCKET_BITS,
          dim: int = DIM, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Fit embeddings and softmax with Adam on cross-entropy; `prior` is the share of label 1 among all labelled rows.

    Without both classes there is nothing to separate: the score is the prior everywhere.
    """
    rng = np.random.default_rng(seed)
    n, positive = len(labels), int(labels.sum())
    if not 0 < positive < n:
        return Model(np.zeros(1 << bits), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))), bits)
    table = (rng.standard_normal((1 << bits, dim)) * 0.05).astype(np.float32)
    soft = (rng.standard_normal((dim, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [table, soft, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    aside = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    learn = np.flatnonzero(~aside)
    step, batches = 0, -(-len(learn) // BATCH)
    epochs = max(epochs, -(-MIN_STEPS // batches))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(learn), batches):
            picked = [b[rng.random(len(b)) < SEEN] for b in (bags[r] for r in rows)]
            sizes = np.array([len(b) for b in picked])
            rows, sizes = rows[sizes > 0], sizes[sizes > 0]
            if not len(rows):
                continue
            index = np.concatenate(picked)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = GAIN * np.add.reduceat(table[index], starts) / sizes[:, None].astype(np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = GAIN * (p @ soft.T) / sizes[:, None].astype(np.float32)
            order = np.argsort(index, kind="stable")
            touched, first = np.unique(index[order], return_index=True)
            down = np.add.reduceat(back[np.repeat(np.arange(len(rows)), sizes)[order]], first)
            step += 1
            for k, (grad, at) in enumerate(((down, touched), (mean.T @ p, slice(None)), (p.sum(0), slice(None)))):
                m, v = moments[k]
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.99 * v[at] + 0.01 * grad * grad
                params[k][at] -= rate * (m[at] / (1 - 0.9 ** step)) / (np.sqrt(v[at] / (1 - 0.99 ** step)) + 1e-8)
    model = Model((GAIN * (table @ (soft[:, 1] - soft[:, 0]))).astype(np.float64), float(bias[1] - bias[0]), bits)
    judge = np.flatnonzero(aside) if 0 < labels[aside].sum() < aside.sum() else np.arange(n)
    middle = cut_point(np.array([model.logit(bags[r]) for r in judge]), labels[judge], prior)
    return Model(model.weights, model.bias - middle, bits)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled rows per class, those with the smallest hash of `key`.

    `labels` has `key` and `label` (0 or 1; null is no label). Labels without a document and documents without a label are
    no examples. The sample's keys, at most twice `sample`, are broadcast to find their texts; of rows that share a key one is taken, the one
    of the smallest text hash. Their bags of n-grams are what the driver receives, at most `MOST_NGRAMS` of each, those of smallest number:
    a bound of 4 * 2 * sample * MOST_NGRAMS bytes, whatever the texts.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter("_label in (0, 1)")
    draw = [known.filter(F.col("_label") == c).distinct().orderBy(F.xxhash64("_key"), "_key").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(draw[0].unionByName(draw[1]))
    rows = docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    @releasing
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(bag(t.as_buffer().to_pybytes()))[:MOST_NGRAMS] for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_order"), batch.column("_label"), pa.array(found, pa.list_(pa.int32()))], ["turn", "label", "buckets"])

    held = rows.join(chosen, rows["_doc"] == F.col("_key")).select("_key", "_label", F.xxhash64("_key", "_text").alias("_order"), "_text")
    first = held.groupBy("_key", "_label").agg(F.min("_order").alias("_order"))
    sampled = held.join(first, ["_key", "_label", "_order"], "left_semi").dropDuplicates(["_key", "_label"]).select("_order", "_label", "_text")
    got = settle(sampled.mapInArrow(bags, "turn long, label int, buckets array<int>")).toArrow().sort_by([("turn", "ascending"), ("label", "ascending")])
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    column = got.column("buckets").combine_chunks()
    flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return train([flat[i:j] for i, j in zip(cuts[:-1], cuts[1:])], got.column("label").to_numpy().astype(np.int64), prior)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of label 1 for every whole text, from 0 to 1; a column called `name` is replaced.

    A text without any window (null, empty, shorter than a trigram with its gaps) gets the model's bias alone. Rows are scored
    one by one, so repeated rows repeat their score, other columns stay, and an empty table gives an empty one.
    """
    @F.arrow_udf("double")
    @releasing
    def chance(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            z = np.array([model.logit(bag(t.as_buffer().to_pybytes(), model.bits)) for t in column], np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return df.withColumn(name, chance(F.coalesce(F.col(text), F.lit(""))))
