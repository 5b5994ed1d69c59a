"""End-to-end reports: compositions of the operators, each returning DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from farspark.errors import RefusedError
from farspark.functions.expressions import (
    COHERENCE_LAG_SAMPLES,
    FAR_SNR_EDGES,
    REPORT_MASS_EDGES,
    bin_index,
    is_glitch,
    is_massive,
    lr_features,
    net_sigma,
)
from farspark.operators import efficiency as eff
from farspark.operators import far as rates
from farspark.operators import folds, ranking, slides, volume
from farspark.operators.calibration import efficiency_at_quantile, shape_stats, spearman, tile_properties
from farspark.operators.bounded import loudest_slides
from farspark.operators.ordered import percentiles, union_all
from farspark.operators.records import record_problems
from farspark.operators.series import coherence_rows
from farspark.operators.settle import settle
from farspark.operators.slides import cluster_local_max
from farspark.schemas import require_columns

CURVE_TARGETS = (100.0, 10.0, 1.0, 0.1)
REPORT_TARGETS = (100.0, 10.0, 1.0)
RANKED_TARGETS = (100.0, 30.0, 10.0, 3.0, 1.0)


@dataclass(frozen=True)
class Band:
    """How stored coefficients map to frequency: first bin, window length, lag half-range."""

    first_bin: int
    n: int
    lag_samples: int = COHERENCE_LAG_SAMPLES


@dataclass(frozen=True)
class FarCurve:
    """Slide background with what is needed to judge a foreground by it."""

    triggers: DataFrame
    norm: dict[str, float]
    plan: slides.SlidePlan
    stride_s: float
    half: int
    floor: float
    trials: int

    @property
    def livetime_yr(self) -> float:
        return self.plan.background_livetime_yr

    def thresholds(self, targets: Sequence[float] = CURVE_TARGETS) -> DataFrame:
        return rates.thresholds_at_far(
            self.triggers, "net_sigma", self.livetime_yr, targets, self.trials, ["channel"], below_floor="drop"
        )

    def totals(self) -> DataFrame:
        strict = F.avg((F.col("channel") == "strict").cast("double"))
        return self.triggers.agg(
            F.count(F.lit(1)).alias("n_stored"), F.max("net_sigma").alias("loudest"),
            F.coalesce(strict, F.lit(0.0)).alias("strict_fraction"),
        ).select(
            "*", F.lit(self.plan.n_lags).alias("n_lags"),
            F.lit(self.plan.coincident_livetime_s).alias("coincident_livetime_s"),
            F.lit(self.livetime_yr).alias("background_livetime_yr"),
            F.lit(self.trials / self.livetime_yr).alias("floor_per_yr"),
        )


def with_channel(df: DataFrame) -> DataFrame:
    """strict or general, by coherence and both centroids; everything is general where those are not measured."""
    if not {"coherence", "centroid_a", "centroid_b"} <= set(df.columns):
        return df.withColumn("channel", F.lit("general"))
    strict = is_massive("coherence", "centroid_a", "centroid_b")
    return df.withColumn("channel", F.when(strict, F.lit("strict")).otherwise(F.lit("general")))


def far_curve(
    grid: DataFrame, stride_s: float, n_lags: int = 2000, step_s: float = 4.0, cluster_s: float = 4.0, floor: float = 6.0,
    trials: int = 4, band: Band | None = None,
) -> FarCurve:
    """Slide background of a score grid, branched into channels.

    Normalise, slide with the floor built into the pairing, cluster, then fetch centroids and coefficients for
    the survivors only. The triggers are written once, because thresholds and totals read them several times.
    """
    require_columns(grid, ("span_start", "i", "score_a", "score_b"), "score grid")
    half = slides.cluster_half(cluster_s, stride_s)
    plan = slides.capped_plan(grid, n_lags, step_s, stride_s, half)
    norm = slides.norm_values(slides.sigma_norm(grid))
    sized = slides.standardise(slides.with_span_size(grid.select("span_start", "i", "score_a", "score_b")), norm)
    triggers = slides.slide_triggers(sized, plan, stride_s, floor, half)
    wide = [c for c in ("centroid_a", "arm_a", "re_a", "im_a") if c in grid.columns]
    if wide:
        triggers = slides.trigger_lookup(triggers, grid, wide, [f"{c[:-2]}_b" for c in wide])
    if band is not None and "re_a" in grid.columns:
        triggers = coherence_rows(triggers, band.first_bin, band.n, band.lag_samples).drop("re_a", "im_a", "re_b", "im_b")
    return FarCurve(settle(with_channel(triggers)), norm, plan, stride_s, half, floor, trials)


def foreground_stat(foreground: DataFrame, norm: dict[str, float]) -> DataFrame:
    """Foreground on the background's scale, in its channel."""
    out = slides.standardise(foreground, norm).withColumn("net_sigma", net_sigma("sigma_a", "sigma_b"))
    return with_channel(out)


def quotable_thresholds(thresholds: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Thresholds of the targets every channel resolves, and none under a gated floor."""
    checked = thresholds.withColumn("quotable", F.col("resolved"))
    if floors is not None:
        checked = rates.refuse_below_floor(thresholds, floors)
    bad = checked.filter(~F.col("quotable")).select("far_per_yr").distinct()  # at most one row per target
    return thresholds.join(F.broadcast(bad), "far_per_yr", "left_anti")


def efficiency_report(
    background: DataFrame, foreground: DataFrame, livetime_yr: float, targets: Sequence[float] = REPORT_TARGETS,
    trials: int = 4, stat: str = "net_sigma", gated: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Efficiency of a judged foreground against a channelled background, with the refusals of each target.

    `gated` is the gate's output (channel, stat, kept): its survivors replace the background and the foreground
    must pass the same gate (hm, lm).
    """
    floors = None
    if gated is not None:
        eff.require_foreground(foreground, ["hm", "lm"])
        floors = eff.gate_kept(gated, stat)
        background = gated.filter("kept")
        foreground = foreground.withColumn("passes_gate", ~is_glitch("hm", "lm"))
    else:
        foreground = foreground.withColumn("passes_gate", F.lit(True))
    ranked = rates.rank_table(background, stat, ["channel"], foreground=foreground)
    thresholds = quotable_thresholds(rates.thresholds_from(ranked, stat, livetime_yr, targets, trials, ["channel"]).drop("n_above"), floors)
    judged = rates.own_channel_threshold(foreground, thresholds, stat, ["channel"], inclusive=False)
    judged = judged.withColumn("found", F.col("found") & F.col("passes_gate"))
    member = (F.col("channel") == "strict") & F.col("passes_gate")
    strict = ranked.filter(F.col("channel") == "strict").drop("channel")
    # Nothing can be said about a channel without background, so its rate is not the smallest but infinite.
    rated = rates.far_from(ranked, foreground, stat, livetime_yr, trials, ["channel"])
    out = {
        "thresholds": thresholds,
        "efficiency": eff.efficiency(judged, by=["far_per_yr"]),
        "scanned": rates.scanned_from(strict, foreground, stat, livetime_yr, trials, member),
        "loudest": rates.loudest_from(ranked, stat, ["channel"]).filter("n > 0"),
    }
    if "network_snr" in foreground.columns:
        out["vs_snr"] = eff.efficiency_vs_snr(judged, by=["far_per_yr"])
        banded = settle(rated.select(bin_index("network_snr", FAR_SNR_EDGES).alias("snr_band"), "far_per_yr"))
        out["far_quantiles"] = rates.injection_far_quantiles(banded, "snr_band")
    if "total_mass" in foreground.columns:
        out["vs_mass"] = eff.efficiency_vs_mass(judged, by=["far_per_yr"], edges=REPORT_MASS_EDGES)
    if {"coherence", "centroid_a", "centroid_b"} <= set(foreground.columns):
        out["vetoes"] = eff.veto_rates(foreground)
    return out


# --- ranked search --------------------------------------------------------------------------


@dataclass(frozen=True)
class LrFit:
    models: list[ranking.Model]
    assignment: DataFrame
    sanity: DataFrame


def lr_fit(
    grid: DataFrame, foreground: DataFrame, stride_s: float, band: Band, fit_lags: int = 60, step_s: float = 4.0,
    cluster_s: float = 4.0, floor: float = 0.0,
) -> LrFit:
    """Alternate spans between two folds and fit one model per fold on its own spans only."""
    assignment = folds.alternating_folds(grid)
    norms = ranking.fold_norms(slides.sigma_norm(ranking.fold_join(grid, assignment), ["fold"]))
    tagged = ranking.fold_join(slides.with_span_size(grid), assignment)
    signal = ranking.fold_join(foreground, assignment)
    half = slides.cluster_half(cluster_s, stride_s)
    models = ranking.fit_lr_two_fold(
        tagged, signal, norms, stride_s, band.first_bin, band.n, band.lag_samples, half, fit_lags, step_s, floor
    )
    by_fold = {m.fold: m for m in models}
    held = ranking.score_held_out(ranking.standardise_held_out(signal, by_fold), by_fold)
    # Read five times. With the search for a value's cell in one stage, the score would make code too long to be compiled.
    held = settle(held.select("fold", "loglr"))
    sanity = percentiles(held, "loglr", {"median_loglr": 0.5}, ["fold"])
    return LrFit(models, assignment, sanity)


def score_foreground(foreground: DataFrame, assignment: DataFrame, models: dict[int, ranking.Model]) -> DataFrame:
    tagged = ranking.standardise_held_out(ranking.fold_join(foreground, assignment), models)
    return ranking.score_held_out(tagged, models, lr_features())


def lr_background(
    grid: DataFrame, assignment: DataFrame, models: dict[int, ranking.Model], stride_s: float, band: Band,
    n_lags: int = 2000, step_s: float = 4.0, cluster_s: float = 4.0, keep_above: float = -2.0,
) -> tuple[DataFrame, slides.SlidePlan]:
    """Likelihood ratio at every slid pair, coherence included, kept above a floor and clustered."""
    mismatch = folds.span_set_equality(grid, assignment).first()
    if mismatch["only_in_a"] or mismatch["only_in_b"]:
        raise RefusedError("background spans are not the ones the model was fitted on; refit")
    if "checkpoint" in grid.columns:
        ranking.single_checkpoint(grid)
    half = slides.cluster_half(cluster_s, stride_s)
    plan = slides.capped_plan(grid, n_lags, step_s, stride_s, half)
    tagged = ranking.standardise_held_out(ranking.fold_join(slides.with_span_size(grid), assignment), models)
    dense = ranking.dense_slides(
        tagged, plan, stride_s, band.first_bin, band.n, band.lag_samples, keep_above, half, models
    )
    return dense.withColumnRenamed("stat", "loglr"), plan


def lr_far(
    background: DataFrame, foreground: DataFrame, livetime_yr: float, targets: Sequence[float] = RANKED_TARGETS,
    trials: int = 4, stat: str = "loglr", provenance: tuple[DataFrame, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Thresholds, achieved rates and efficiency of a ranked search, from a fresh or a stored background.

    Targets the livetime cannot resolve are left out. The foreground is checked before anything runs, and so is `provenance`, the run
    metadata of background and foreground: a mismatch is refused, the status of each campaign is among the results.
    """
    eff.require_foreground(foreground, [stat, "network_snr"])
    checked = {"provenance": ranking.require_provenance(*provenance)} if provenance else {}
    found = rates.thresholds_from(rates.rank_table(background, stat), stat, livetime_yr, targets, trials)
    thresholds = found.drop("n_above")
    judged = rates.own_channel_threshold(foreground, thresholds, stat, [], inclusive=False)
    quoted = [t for t in targets if t >= rates.resolvable_floor(livetime_yr, trials)]
    last = judged.filter(F.col("far_per_yr") == F.lit(min(quoted) if quoted else None).cast("double"))
    return {
        "thresholds": thresholds,
        "achieved": found.select(
            "far_per_yr", "threshold", "n_above", (F.lit(float(trials)) * F.col("n_above") / F.lit(float(livetime_yr))).alias("achieved_far_per_yr")),
        "efficiency": eff.efficiency(judged, by=["far_per_yr", "threshold"]),
        "vs_snr": eff.efficiency_vs_snr(last),
        **checked,
    }


def lr_rescore(
    stored: DataFrame, meta: DataFrame, foreground: DataFrame, foreground_meta: DataFrame, assignment: DataFrame,
    models: dict[int, ranking.Model], keep_above: float | None = None, targets: Sequence[float] = RANKED_TARGETS, trials: int = 4,
) -> dict[str, DataFrame]:
    """The ranked search on a background that an earlier run stored: only the foreground is scored.

    `meta` is that run's one row (campaign_id, checkpoint, model_id, gate_applied, keep_above, n_lags, background_livetime_yr). Its model and checkpoint must
    be the foreground's, and it must have kept everything above `keep_above` where the caller needs that. Livetime and floor
    are taken from it, nothing is written back, and its row is among the results as it was read.
    """
    run = meta.limit(2).collect()
    if len(run) != 1:
        raise RefusedError(f"a stored background has one row of metadata, not {len(run)}")
    if keep_above is not None and run[0]["keep_above"] > keep_above:
        raise RefusedError(f"the stored background was cut at {run[0]['keep_above']}, above the floor {keep_above} asked for")
    if stored.filter(~(F.col("loglr") > F.lit(run[0]["keep_above"]))).limit(1).count():
        raise RefusedError("the stored background holds triggers under the floor its metadata states")
    scored = score_foreground(foreground, assignment, models)
    out = lr_far(stored, scored, run[0]["background_livetime_yr"], targets, trials, provenance=(meta, foreground_meta))
    return out | {"run": meta}


def vt_seed(
    background: DataFrame, foreground: DataFrame, livetime_yr: float, distance_max_mpc: float, n_attempted: int,
    targets: Sequence[float] = RANKED_TARGETS, trials: int = 4, stat: str = "loglr", cosmology: dict | None = None,
    provenance: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Comoving volume of one scored volumetric campaign at each resolvable target, after its `provenance` has been checked."""
    volume.require_volumetric(foreground)
    if provenance:
        ranking.require_provenance(*provenance)
    thresholds = rates.thresholds_at_far(background, stat, livetime_yr, targets, trials, below_floor="drop")
    weighted = volume.comoving_weight(foreground, **(cosmology or {}))
    return volume.volume_rank_error(weighted, background, stat, thresholds, distance_max_mpc, n_attempted)


def vt_facts(foreground: DataFrame, n_attempted: int, weight_col: str = "weight", cosmology: dict | None = None) -> DataFrame:
    """What a volume rests on, in one row: injections attempted and lost, the largest redshift and the range of the weights.

    `warning` tells when more than one in a hundred attempts is missing from the foreground; they count as not found.
    """
    weighted = foreground if {"z", weight_col} <= set(foreground.columns) else volume.comoving_weight(foreground, **(cosmology or {}))
    facts = weighted.agg(F.count(F.lit(1)).alias("n_kept"), F.max("z").alias("z_max"),
                         F.min(weight_col).alias("weight_min"), F.max(weight_col).alias("weight_max"))
    lost = F.lit(n_attempted).cast("bigint") - F.col("n_kept")
    text = F.concat(F.lit("lost "), lost, F.lit(" of "), F.lit(n_attempted).cast("bigint"), F.lit(" attempted injections"))
    return facts.select(
        F.lit(n_attempted).cast("bigint").alias("n_attempted"), "n_kept", lost.alias("n_lost"), "z_max", "weight_min", "weight_max",
        F.when(lost > 0.01 * n_attempted, text).alias("warning"))


def vt_report(per_seed: dict[str, DataFrame]) -> DataFrame:
    """Volumes of several seeds as means and ranges per target."""
    return volume.volume_over_seeds(union_all([d.withColumn("seed", F.lit(s)) for s, d in per_seed.items()]))


# --- comparisons ----------------------------------------------------------------------------


def gate_report(
    triggers: DataFrame, windows: DataFrame, columns: Sequence[str], k: int,
    score: Callable[[DataFrame], DataFrame] = lambda df: df, stat: str = "net_sigma",
) -> dict[str, DataFrame]:
    """Gate the k loudest triggers of each channel.

    `windows` holds what is known per distinct window, `score` turns the looked-up pair into hm and lm.
    """
    top = rates.top_k_per_channel(triggers, stat, k, ties=["span_start", "lag_index", "i"])
    needed = slides.wanted_windows(top)
    have = windows.join(needed, ["span_start", "channel", "idx"], "left_semi")
    gated = score(slides.window_lookup(top, have, columns)).withColumn("kept", ~is_glitch("hm", "lm"))
    return {"gated": gated, "summary": eff.gate_kept(gated, stat), "windows": needed}


def baseline_seeds(
    background: DataFrame, foreground: DataFrame, stat: str, livetime_yr: float, targets: Sequence[float] = RANKED_TARGETS,
    trials: int = 4, strict: str = "strict",
) -> dict[str, DataFrame]:
    """Per-seed efficiency where every channel of the seed resolves the target, and its spread over seeds."""
    keys = ["seed", "channel"]
    thresholds = rates.thresholds_at_far(background, stat, livetime_yr, targets, trials, keys, below_floor="drop")
    bad = thresholds.filter(~F.col("resolved")).select("seed", "far_per_yr").distinct()
    good = thresholds.join(bad, ["seed", "far_per_yr"], "left_anti")
    asked = foreground.join(F.broadcast(good.select("seed", "far_per_yr").distinct()), "seed")  # seeds x targets rows
    judged = asked.join(good.select(*keys, "far_per_yr", "threshold"), [*keys, "far_per_yr"], "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(float("inf")))
    )
    judged = judged.withColumn("found", F.col(stat) > F.col("threshold"))
    per_seed = eff.efficiency(judged, by=["seed", "far_per_yr"])
    edges = rates.edge_point(
        background.filter(F.col("channel") == strict), foreground, stat, livetime_yr, trials,
        member=F.col("channel") == strict,
    )
    return {
        "per_seed": per_seed, "summary": eff.seed_summary(per_seed), "edges": edges, "edge_range": rates.edge_range(edges),
        "ceiling": rates.resolvable_ceiling(background, stat, livetime_yr, targets, trials, keys),
    }


def front_end_report(
    tiles: DataFrame, score_x: str, score_y: str, row_id: str, is_signal: Column, data: str = "data"
) -> dict[str, DataFrame]:
    """Two front ends on the same tiles: shapes, rank agreement, what each score tracks, and matched efficiency."""
    noise = tiles.filter(~is_signal)
    props = settle(tile_properties(noise, data).drop(data))
    tracked = [
        spearman(props, s, p, row_id).select(F.lit(s).alias("score"), F.lit(p).alias("property"), "spearman")
        for s in (score_x, score_y) for p in ("tile_mean", "tile_std", "tile_fraction")
    ]
    return {
        "shape": union_all([shape_stats(noise, s).withColumn("score", F.lit(s)) for s in (score_x, score_y)]),
        "agreement": spearman(props, score_x, score_y, row_id),
        "properties": union_all(tracked),
        "efficiency": union_all([
            efficiency_at_quantile(tiles, s, is_signal).withColumn("score", F.lit(s)) for s in (score_x, score_y)
        ]),
    }


def matched_far_run(
    parts: DataFrame, selection: slides.Selection, grid: DataFrame, plan: slides.SlidePlan, stride_s: float,
    foreground: DataFrame, stat: str, v_generated_gpc3: float | None = None, targets: Sequence[float] = (1.0, 0.1),
    half: int = 0, a_cols=("sigma_a",), b_cols=("sigma_b",), audit: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The one pass over the evaluation fold: background and foreground through one selection, then the metrics.

    `parts` are segments with their split. The read is judged against the trail `audit` first; its own audit row is among the
    results, for the caller to append. Of slid pairs within `half` points of a lag only the loudest counts. Where the selection
    states a bound of its statistic, only pairs that can matter for the targets are formed.
    """
    request = folds.read_request(parts.sparkSession, "final", "eval", selection.name or "matched-far", "matched_far_run")
    reads = folds.require_granted(settle(folds.judge_reads(request, parts, audit)))
    spans = parts.filter(F.col("split") == "eval").select(F.col("start_s").alias("span_start")).distinct()
    held = grid.join(spans, "span_start", "left_semi")
    years = plan.background_livetime_yr
    if selection.parts is not None:
        wanted = max(rates.allowed_count(t, years, selection.trials) for t in targets) + 1
        background = loudest_slides(held, plan, stride_s, selection, stat, wanted, half, a_cols, b_cols)
    else:
        background = settle(cluster_local_max(slides.run_slides(held, plan, stride_s, selection, half, a_cols, b_cols), stat, half))
    judged = selection(foreground)
    out = {
        "efficiency": eff.efficiency_at_far(judged, background, stat, years, targets, selection.trials),
        "audit": folds.granted_reads(reads),
    }
    if v_generated_gpc3 is not None:
        out["volume"] = volume.sensitive_volume(
            judged, background, stat, years, targets, v_generated_gpc3, trials=selection.trials
        )
    if "total_mass" in judged.columns:
        thresholds = rates.thresholds_at_far(background, stat, years, targets[:1], selection.trials)
        found = rates.own_channel_threshold(judged, thresholds, stat, [], targets[:1])
        out["vs_mass"] = eff.efficiency_vs_mass(found)
    return out


def fold_report(segments: DataFrame, eval_fold: int = 1, n_folds: int = 2, val_frac: float = 0.2, bg_frac: float = 0.3) -> DataFrame:
    """Livetime, count and bounds of every fold and split, after the folds have been checked to be disjoint."""
    folded = folds.assert_disjoint_folds(settle(folds.gps_grouped_folds(segments, n_folds)))
    labelled = folds.train_eval_labels(folded, eval_fold)
    train = labelled.filter(F.col("split") == "train").drop("split")
    parts = folds.three_way_split(train, val_frac, bg_frac)
    by_fold = folds.fold_summary(folded).select(F.concat(F.lit("fold_"), F.col("fold")).alias("part"), *_SUMMARY)
    by_split = folds.fold_summary(labelled.drop("fold").unionByName(parts.drop("fold")), "split")
    return by_fold.unionByName(by_split.select(F.col("split").alias("part"), *_SUMMARY))


_SUMMARY = ("n_segments", "livetime_s", "span_start", "span_end")


def results_table(records: DataFrame) -> DataFrame:
    """The running table of records, each with what keeps it from supporting a claim."""
    return record_problems(records).select("name", "verdict", F.size("seeds").alias("n_seeds"), "valid", "problems")
