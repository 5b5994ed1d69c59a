"""The held-out likelihood ratio: features, two-fold fit, scoring by the other fold, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farspark.errors import RefusedError
from farspark.functions.expressions import ARM_CLIP, ARM_RAMP_SIGMA, FEATURES, arm_gate, keep_above, log_likelihood_ratio, lr_features
from farspark.functions.kernels import coefficient_coherence, lag_rotation
from farspark.operators.bounded import WIDTH, pairs_above, with_slack
from farspark.operators.settle import settle, temporaries
from farspark.operators.slides import SlidePlan, cluster_local_max
from farspark.operators.sums import array_sum, blocks
from farspark.schemas import names

RIDGE = 1e-3
NEWTON_PASSES = 20
#: Largest gradient, per row, at which a fit is settled.
KKT = 1e-11
PAIR_BATCH = 1 << 14
NORM_FIELDS = ("mu_a", "sd_a", "mu_b", "sd_b")
MODEL_SCHEMA = (
    "fold int, mu array<double>, sd array<double>, beta array<double>, "
    "norm struct<mu_a double, sd_a double, mu_b double, sd_b double>"
)


@dataclass(frozen=True)
class Model:
    """One fold's fit: feature standardisation, coefficients (intercept first) and score norm."""

    fold: int
    mu: tuple[float, ...]
    sd: tuple[float, ...]
    beta: tuple[float, ...]
    norm: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        wanted = {"mu": len(FEATURES), "sd": len(FEATURES), "beta": 1 + len(FEATURES)}
        wrong = [f"{field}: {len(getattr(self, field))}, not {n}" for field, n in wanted.items() if len(getattr(self, field)) != n]
        if wrong:
            raise ValueError(f"model of fold {self.fold}, numbers in {'; '.join(wrong)}")


def models_frame(spark: SparkSession, models: Sequence[Model]) -> DataFrame:
    rows = [(m.fold, list(m.mu), list(m.sd), list(m.beta), m.norm) for m in models]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def load_models(frame: DataFrame) -> dict[int, Model]:
    """The two-fold model table as numbers: two rows of two dozen doubles."""
    rows = frame.limit(3).collect()
    if sorted(r["fold"] for r in rows) != [0, 1]:
        raise RefusedError("a held-out model needs exactly the folds 0 and 1")
    return {
        r["fold"]: Model(
            r["fold"], tuple(r["mu"]), tuple(r["sd"]), tuple(r["beta"]), tuple(r["norm"]) if r["norm"] else None
        )
        for r in rows
    }


def fold_join(rows: DataFrame, assignment: DataFrame, key: str = "span_start") -> DataFrame:
    """Attach `fold` by span start in whole microseconds; a row whose span has no fold stops the query."""
    us = F.rint(F.col(key) * 1e6).cast("bigint")
    known = assignment.select(us.alias("_us"), "fold").distinct()
    joined = rows.withColumn("_us", us).join(known, "_us", "left").drop("_us")
    stray = F.raise_error(F.lit("a row's span is not one the model was fitted on")).cast("int")
    return joined.withColumn("fold", F.coalesce(F.col("fold").cast("int"), stray))


def standardise_held_out(df: DataFrame, models: dict[int, Model]) -> DataFrame:
    """sigma_a and sigma_b of a fold-g row by the norm of fold 1-g, the one that will score it."""
    if any(m.norm is None for m in models.values()):
        raise RefusedError("the model carries no per-fold norms; refit it")
    for c, (mu, sd) in (("a", (0, 1)), ("b", (2, 3))):
        by_fold = lambda at: F.when(F.col("fold") == 0, models[1].norm[at]).when(F.col("fold") == 1, models[0].norm[at])
        df = df.withColumn(f"sigma_{c}", (F.col(f"score_{c}") - by_fold(mu)) / by_fold(sd))
    return df


def score_held_out(df: DataFrame, models: dict[int, Model], features: Sequence[Column] | None = None) -> DataFrame:
    """Add loglr: each row by the model fitted on the other fold, as one code-generated expression per fold."""
    features = lr_features() if features is None else features
    score = lambda m: log_likelihood_ratio(features, m.mu, m.sd, m.beta)
    by_other = F.when(F.col("fold") == 0, score(models[1])).when(F.col("fold") == 1, score(models[0]))
    return df.withColumn("loglr", by_other)


# --- fitting --------------------------------------------------------------------------------


def _bounded_step(gradient: np.ndarray, hessian: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The least point of the quadratic model that keeps to its lower bounds, by trying bounds until none is broken or pulls."""
    held = np.zeros(len(at), dtype=bool)
    for _ in range(2 * len(at)):
        free = ~held
        step = np.where(held, low - at, 0.0)
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], -gradient[free] - hessian[np.ix_(free, held)] @ step[held])
        broken = free & (at + step < low)
        if broken.any():
            held |= broken
            continue
        pulled = held & (gradient + hessian @ step < 0)
        if not pulled.any():
            break
        held &= ~pulled
    return step


def fit_lr(rows: DataFrame, label: str = "label", fold: int = 0, norm=None, features: Sequence[str] = FEATURES) -> Model:
    """Balanced logistic regression with a small ridge and a coherence coefficient that cannot be negative.

    Features are standardised by population moments first and settled as blocks of doubles. Newton's method: a pass over the rows
    adds up the loss, the gradient and the matrix of second derivatives, some fifty numbers, and the driver solves for the next point.
    """
    with temporaries(rows.sparkSession):
        return _fit(rows, label, fold, norm, features)


def _fit(rows: DataFrame, label: str, fold: int, norm, features: Sequence[str]) -> Model:
    with temporaries(rows.sparkSession):
        d = settle(rows.select(F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]))
        moments = d.agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1"), *[F.avg(f).alias(f"m_{f}") for f in features],
            *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
        ).first()
        n, n1 = moments["n"], int(moments["n1"] or 0)
        if not n or n1 in (0, n):
            raise RefusedError("a fit needs rows of both classes")
        mu = tuple(moments[f"m_{f}"] for f in features)
        sd = tuple(moments[f"s_{f}"] + 1e-9 for f in features)
        centre, scale = np.array([0.0, *mu]), np.array([1.0, *sd])
        standardised = settle(blocks(d, lambda rows: (rows - centre) / scale), keep=True)
    size = len(features) + 1
    weights = np.array([n / (2.0 * (n - n1)), n / (2.0 * n1)])
    ridge = np.array([0.0, *[2.0 * RIDGE] * len(features)])
    low = np.array([-np.inf, *[0.0 if f == "coherence" else -np.inf for f in features]])

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def kernel(rows: np.ndarray) -> np.ndarray:
            y, z = rows[:, 0], rows[:, 1:]
            w, m = weights[(y == 1).astype(int)], z @ beta[1:] + beta[0]
            e = np.exp(-np.abs(m))
            loss = w @ (np.maximum(m, 0.0) + np.log1p(e) - y * m)
            p = np.where(m >= 0, 1.0, e) / (1 + e)
            slope, curve = w * (p - y), w * e / (1 + e) ** 2
            hessian = np.empty((size, size))
            hessian[0, 0] = curve.sum()
            hessian[0, 1:] = hessian[1:, 0] = curve @ z
            hessian[1:, 1:] = z.T @ (z * curve[:, None])
            return np.concatenate([[loss, slope.sum()], slope @ z, hessian.reshape(-1)])

        got = array_sum(standardised, size, kernel, 1 + size + size * size)
        hessian = got[1 + size :].reshape(size, size) + np.diag(ridge)
        return got[0] + 0.5 * float(ridge @ beta**2), got[1 : 1 + size] + ridge * beta, hessian

    beta = np.zeros(size)
    loss, gradient, hessian = sums(beta)
    for _ in range(NEWTON_PASSES):
        if np.isnan(loss):  # a row with NULL or NaN, whatever the coefficients
            return Model(fold, mu, sd, (float("nan"),) * size, norm)
        left = np.where((beta <= low) & (gradient > 0), 0.0, gradient)
        if np.abs(left).max() <= KKT * n:
            break
        step = _bounded_step(gradient, hessian, beta, low)
        share = 1.0
        while True:
            tried = np.maximum(beta + share * step, low)
            new_loss, new_gradient, new_hessian = sums(tried)
            if new_loss <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 4  # the model's least point lies too far out
        beta, loss, gradient, hessian = tried, new_loss, new_gradient, new_hessian
    return Model(fold, mu, sd, tuple(map(float, beta)), norm)


# --- provenance -----------------------------------------------------------------------------


def provenance_status(background_meta: DataFrame, foreground_meta: DataFrame, on: str = "campaign_id") -> DataFrame:
    """Run metadata of both sides joined, with `provenance` (verified, unverified or mismatched) and the `problem` of a mismatch.

    What either side does not know cannot be checked; without both checkpoints a row is unverified.
    """
    fields = ("checkpoint", "model_id", "gate_applied")
    f = foreground_meta.select(on, *[F.col(c).alias(f"_f_{c}") for c in fields])
    j = background_meta.select(on, *fields).join(f, on)
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"_f_{c}"), F.lit(False))
    problem = (
        F.when(differs("checkpoint"), F.lit("background and foreground come from different checkpoints"))
        .when(differs("model_id"), F.lit("background and foreground were ranked by different models"))
        .when(differs("gate_applied"), F.lit("the gate was applied to one side only"))
    )
    known = F.col("checkpoint").isNotNull() & F.col("_f_checkpoint").isNotNull()
    status = F.when(problem.isNotNull(), F.lit("mismatched")).when(known, F.lit("verified")).otherwise(F.lit("unverified"))
    return j.select(on, *fields, status.alias("provenance"), problem.alias("problem"))


def provenance_match(background_meta: DataFrame, foreground_meta: DataFrame, on: str = "campaign_id") -> DataFrame:
    """`provenance_status` that stops on a mismatch: other checkpoint, other model, or a gate on one side only."""
    j = provenance_status(background_meta, foreground_meta, on)
    refused = F.raise_error(F.col("problem")).cast("string")
    return j.withColumn("provenance", F.when(F.col("problem").isNotNull(), refused).otherwise(F.col("provenance"))).drop("problem")


def require_provenance(background_meta: DataFrame, foreground_meta: DataFrame, on: str = "campaign_id") -> DataFrame:
    """The status of every campaign, after a mismatch has been refused before any work is done on the rows."""
    status = settle(provenance_status(background_meta, foreground_meta, on))
    bad = status.filter(F.col("problem").isNotNull()).first()
    if bad is not None:
        raise RefusedError(f"{on} {bad[on]}: {bad['problem']}")
    return status


def single_checkpoint(grid: DataFrame) -> str | None:
    found = [r[0] for r in grid.select("checkpoint").distinct().limit(2).collect()]
    if len(found) > 1:
        raise RefusedError("grid shards were scored with different checkpoints")
    return found[0] if found else None


# --- dense slides ---------------------------------------------------------------------------

_DENSE_OUT = (
    "span_start double, lag_index int, k bigint, i bigint, j bigint, "
    + ", ".join(f"{f} double" for f in FEATURES) + ", stat double"
)


def bound_parts(grid: DataFrame, floor: float, models: dict[int, Model] | None = None) -> DataFrame:
    """(span_start, n, i, part_a, part_b, need): a pair can be above `floor` only where part_a + part_b > need.

    With `models` the likelihood ratio is linear in the features of either channel and in the coherence, which lies between 0 and 1;
    without, the statistic is the net sigma, the sum of its parts.
    """
    if models is None:
        parts = {c: F.col(f"sigma_{c}") / F.lit(float(np.sqrt(2.0))) for c in "ab"}
        need = F.lit(float(floor))
    else:
        names_of = {c: (f"sigma_{c}", f"centroid_{c}", f"gated_arm_{c}") for c in "ab"}

        def by_other(of) -> Column:
            return F.when(F.col("fold") == 0, of(models[1])).when(F.col("fold") == 1, of(models[0]))

        def term(m: Model, feature: str, value: Column) -> Column:
            at = FEATURES.index(feature)
            return (value - F.lit(m.mu[at])) / F.lit(m.sd[at]) * F.lit(m.beta[at + 1])

        def part(m: Model, c: str) -> Column:
            values = (F.col(f"sigma_{c}"), F.col(f"centroid_{c}"), arm_gate(f"arm_{c}", f"sigma_{c}"))
            return reduce(add, [term(m, f, x) for f, x in zip(names_of[c], values)])

        def rest(m: Model) -> Column:
            at = FEATURES.index("coherence")
            best = max((x - m.mu[at]) / m.sd[at] * m.beta[at + 1] for x in (0.0, 1.0))
            return F.lit(float(floor - m.beta[0] - best))

        parts = {c: by_other(lambda m, c=c: part(m, c)) for c in "ab"}
        need = by_other(rest)
    return grid.select(
        "span_start", "n", "i", *[with_slack(p.cast("double")).alias(f"part_{c}") for c, p in parts.items()], need.alias("need"))


def dense_slides(
    grid: DataFrame, plan: SlidePlan, stride_s: float, first_bin: int, n: int, lag_samples: int, floor: float, half: int,
    models: dict[int, Model] | None = None, a_block: int = 1024, lag_block: int = 256, width: int = WIDTH,
) -> DataFrame:
    """The pairs of every lag above `floor` where coherence is an input, clustered, with their features.

    With `models` the statistic is the held-out log likelihood ratio; without, the net sigma. Pairs that no coherence
    could lift above the floor are passed over by their bounds, blocks first, before a coefficient moves. The others
    meet their coefficients by (span, block of a, block of lags), so a task's input depends on the two block sizes only and holds
    the windows that its pairs use.

    Grid columns: span_start, n, i, fold, sigma_x, centroid_x, arm_x, re_x, im_x for x in a, b.
    """
    pairs = settle(pairs_above(bound_parts(grid, floor, models), plan, stride_s, half, width))
    return cluster_local_max(scored_pairs(grid, pairs, plan, stride_s, first_bin, n, lag_samples, floor, models, a_block, lag_block), "stat", half)


def scored_pairs(
    grid: DataFrame, pairs: DataFrame, plan: SlidePlan, stride_s: float, first_bin: int, n: int, lag_samples: int, floor: float,
    models: dict[int, Model] | None = None, a_block: int = 1024, lag_block: int = 256,
) -> DataFrame:
    """Features and statistic of the listed pairs, those above `floor`. `pairs` is read three times and should be settled."""
    step = max(1, round(plan.step_s / stride_s))
    top = (plan.n_lags + 1) // 2
    keys = ["span_start", "ablk", "lblk"]
    dealt = pairs.select("*", F.floor(F.col("i") / a_block).alias("ablk"), F.floor((F.expr(f"k div {step}") + top) / lag_block).alias("lblk"))
    used = dealt.select(*keys, F.lit("a").alias("side"), F.col("i").alias("pos")).unionByName(
        dealt.select(*keys, F.lit("b").alias("side"), F.col("j").alias("pos"))).distinct()
    side = lambda x: grid.select(
        "span_start", F.lit(x).alias("side"), F.col("i").alias("pos"), "fold",
        *[F.col(f"{c}_{x}").cast("double").alias(c) for c in ("sigma", "centroid", "arm")],
        F.col(f"re_{x}").alias("re"), F.col(f"im_{x}").alias("im"))
    windows = used.join(side("a").unionByName(side("b")), ["span_start", "side", "pos"])
    windows = windows.select(*[F.col(c).alias(c) for c in windows.columns])  # fresh ids: both sides come from one list of pairs
    scoring = None if models is None else {g: (np.array(m.mu), np.array(m.sd), np.array(m.beta)) for g, m in models.items()}
    root2 = float(np.sqrt(2.0))
    columns = names(_DENSE_OUT)

    def arm(g, s):
        return np.clip(g, -ARM_CLIP, ARM_CLIP) * np.clip(s / ARM_RAMP_SIGMA, 0.0, 1.0)

    def run(key, wide: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = {x: rows.sort_values("pos") for x, rows in wide.groupby("side")}
        if len(sides) == 2 and len(listed):
            values = {x: {c: rows[c].to_numpy(float) for c in ("sigma", "centroid", "arm")} for x, rows in sides.items()}
            spectra = {x: np.stack(rows["re"].to_list()) + 1j * np.stack(rows["im"].to_list()) for x, rows in sides.items()}
            rotation = lag_rotation(first_bin, spectra["a"].shape[1], n, lag_samples)
            fold = int(wide["fold"].iloc[0])
            for begin in range(0, len(listed), PAIR_BATCH):
                some = listed.iloc[begin : begin + PAIR_BATCH]
                at = {x: np.searchsorted(sides[x]["pos"].to_numpy(), some[c].to_numpy()) for x, c in (("a", "i"), ("b", "j"))}
                la, lb = ({c: v[at[x]] for c, v in values[x].items()} for x in "ab")
                f = np.column_stack([
                    la["sigma"], lb["sigma"], coefficient_coherence(spectra["a"][at["a"]], spectra["b"][at["b"]], rotation, n),
                    la["centroid"], lb["centroid"], arm(la["arm"], la["sigma"]), arm(lb["arm"], lb["sigma"]),
                ])
                if scoring is None:
                    stat = (la["sigma"] + lb["sigma"]) / root2
                else:
                    mu, sd, beta = scoring[1 - fold]
                    stat = beta[0] + ((f - mu) / sd) @ beta[1:]
                keep = stat > floor
                if keep.any():
                    d = pd.DataFrame(f[keep], columns=list(FEATURES))
                    for c in ("span_start", "lag_index", "k", "i", "j"):
                        d[c] = some[c].to_numpy()[keep]
                    d["stat"] = stat[keep]
                    out.append(d[columns])
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    return windows.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, _DENSE_OUT)


def fit_lr_two_fold(
    grid: DataFrame, foreground: DataFrame, norms: dict[int, tuple], stride_s: float, first_bin: int, n: int,
    lag_samples: int, half: int, fit_lags: int = 60, step_s: float = 4.0, floor: float = 0.0,
) -> list[Model]:
    """One model per fold: noise rows from a short slide set of that fold's spans, signal rows from its foreground.

    `grid` and `foreground` carry fold and raw scores; each fold is standardised by its own norm.
    """
    plan = SlidePlan(fit_lags, step_s)
    models = []
    for g in (0, 1):
        own = lambda df: standardise_by(df.filter(F.col("fold") == g), norms[g])
        noise = dense_slides(own(grid), plan, stride_s, first_bin, n, lag_samples, floor, half).select(*FEATURES)
        signal = own(foreground).select(*lr_features())
        rows = noise.withColumn("label", F.lit(0)).unionByName(signal.withColumn("label", F.lit(1)))
        models.append(fit_lr(rows, fold=g, norm=tuple(norms[g])))
    return models


def standardise_by(df: DataFrame, norm: Sequence[float]) -> DataFrame:
    mu_a, sd_a, mu_b, sd_b = (float(x) for x in norm)
    return df.withColumn("sigma_a", (F.col("score_a") - mu_a) / sd_a).withColumn("sigma_b", (F.col("score_b") - mu_b) / sd_b)


def fold_norms(norm: DataFrame) -> dict[int, tuple]:
    """Per-fold norms (two rows) as numbers."""
    rows = norm.limit(3).collect()
    if sorted(r["fold"] for r in rows) != [0, 1]:
        raise RefusedError("expected norms of exactly the folds 0 and 1")
    return {r["fold"]: tuple(r[c] for c in NORM_FIELDS) for r in rows}


def keep_loud(df: DataFrame, floor: float) -> DataFrame:
    return df.filter(keep_above("loglr", floor))
