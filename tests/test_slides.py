import numpy as np
import pytest
from pyspark.sql import functions as F

from farspark.errors import RefusedError
from farspark.functions import expressions as X
from farspark.operators.bounded import loudest_slides, pairs_above
from farspark.operators import ranking, slides
from farspark.plans import reports

N, STEP, HALF, FLOOR = 61, 4, 2, 1.2


def numbers(seed=0, spans=3):
    rng = np.random.default_rng(seed)
    return {float(s): (rng.standard_t(3, N), rng.standard_t(3, N)) for s in range(spans)}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(s, i, N, float(a[i]), float(b[i])) for s, (a, b) in numbers().items() for i in range(N)]
    return spark.createDataFrame(rows, "span_start double, i bigint, n bigint, sigma_a double, sigma_b double")


def brute(half=HALF, floor=FLOOR, lags=14):
    out = set()
    for s, (a, b) in numbers().items():
        for idx in range(1, lags + 1):
            k = (idx + 1) // 2 * STEP * (1 if idx % 2 else -1)
            net = (a + np.roll(b, k)) / np.sqrt(2)
            for i in range(N):
                if net[i] >= net[max(0, i - half) : i + half + 1].max() and net[i] > floor:
                    out.add((s, idx, i, (i - k) % N))
    return out


def keys(df):
    return {(r["span_start"], r["lag_index"], r["i"], r["j"]) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_triggers_equal_brute_force(grid, parts):
    plan = slides.SlidePlan(14, float(STEP))
    assert keys(slides.slide_triggers(grid.repartition(parts), plan, 1.0, FLOOR, HALF)) == brute()


def test_pruned_and_full_slides_agree_at_any_floor(grid):
    plan = slides.SlidePlan(14, float(STEP))
    full = slides.time_slide(grid, plan, 1.0, HALF).withColumn("net_sigma", X.net_sigma("sigma_a", "sigma_b"))
    assert full.count() == 3 * N * 14
    for floor in (-1.5, 0.0, 2.0):
        want = slides.cluster_local_max(full, "net_sigma", HALF).filter(X.keep_above("net_sigma", floor))
        assert keys(want) == keys(slides.slide_triggers(grid, plan, 1.0, floor, HALF)) == brute(floor=floor)


def test_blocks_do_not_change_clusters(grid):
    plan = slides.SlidePlan(4, float(STEP))
    full = slides.time_slide(grid, plan, 1.0, HALF).withColumn("net_sigma", X.net_sigma("sigma_a", "sigma_b"))
    whole = keys(slides.cluster_local_max(full, "net_sigma", 5))
    assert all(keys(slides.cluster_local_max(full, "net_sigma", 5, block=b)) == whole for b in (5, 6, 13))
    assert slides.cluster_local_max(full, "net_sigma", 0).count() == full.count()


def test_ties_are_all_kept(spark):
    flat = spark.createDataFrame([(0.0, 1, i, 1.0) for i in range(9)], "span_start double, lag_index int, i bigint, net_sigma double")
    assert slides.cluster_local_max(flat, "net_sigma", 2).count() == 9


def test_ladder(spark):
    with pytest.raises(ValueError, match="step"):
        slides.SlidePlan(10, 0.012)
    lags = [r["lag_s"] for r in slides.slide_plan(spark, 6, 4.0).orderBy("lag_index").collect()]
    assert lags == [4.0, -4.0, 8.0, -8.0, 12.0, -12.0]
    with_zero = slides.slide_plan(spark, 10, 4.0, include_zero=True)
    s = slides.slide_plan_summary(with_zero, 1000.0).first()
    assert (s["n_lags"], s["min_abs_lag_s"], s["background_livetime_s"]) == (11, 4.0, 10_000.0)


def test_ladder_wraps_onto_itself(spark):
    n, step = 14396, 4
    lags = slides.slide_plan(spark, 2 * (n // step - 1), float(step))
    assert slides.distinct_pairings(lags, n, 1.0).count() == n // step - 1 == slides.capped_lags(10**6, n, 4.0, 1.0)


def test_selection_must_keep_its_lag(grid):
    plan = slides.SlidePlan(4, 4.0)
    with pytest.raises(RefusedError):
        slides.run_slides(grid, plan, 1.0, lambda df: df.select("sigma_a"))


def test_windows_are_deduplicated_and_looked_up(spark, grid):
    t = slides.slide_triggers(grid, slides.SlidePlan(14, 4.0), 1.0, FLOOR, HALF)
    windows = slides.wanted_windows(t)
    want = {(s, "a", i) for s, _, i, _ in brute()} | {(s, "b", j) for s, _, _, j in brute()}
    assert {tuple(r) for r in windows.collect()} == want
    back = slides.window_lookup(t, windows.withColumn("twice", F.col("idx") * 2), ["twice"])
    assert back.filter("twice_a <> 2 * i or twice_b <> 2 * j or twice_a is null").count() == 0


# --- dense slides: coherence at every pair --------------------------------------------------

BINS, WINDOW, LAGS = 6, 64, 5


def dense_numbers(seed=3, spans=2, n=37):
    rng = np.random.default_rng(seed)
    return {
        float(s): {c: dict(sigma=rng.normal(size=n), centroid=rng.uniform(100, 300, n), arm=rng.normal(size=n) * 4,
                           z=rng.normal(size=(n, BINS)) + 1j * rng.normal(size=(n, BINS))) for c in "ab"}
        for s in range(spans)
    }


@pytest.fixture(scope="module")
def dense_grid(spark):
    return dense_frame(spark, dense_numbers(), 37)


def dense_frame(spark, data, n):
    rows = []
    for s, d in data.items():
        for i in range(n):
            row = [s, n, int(s) % 2, i]
            for c in "ab":
                x = d[c]
                row += [float(x["sigma"][i]), float(x["centroid"][i]), float(x["arm"][i]), x["z"][i].real.tolist(), x["z"][i].imag.tolist()]
            rows.append(tuple(row))
    cols = "span_start double, n bigint, fold int, i bigint, " + ", ".join(
        f"sigma_{c} double, centroid_{c} double, arm_{c} double, re_{c} array<double>, im_{c} array<double>" for c in "ab")
    return spark.createDataFrame(rows, cols)


def dense_brute(models, floor, lags, step, half, data=None, size=37):
    tau, f = np.arange(-LAGS, LAGS + 1), np.arange(3, 3 + BINS)
    turn = np.exp(2j * np.pi * np.outer(f, tau) / WINDOW)
    gate = lambda g, s: np.clip(g, -6, 6) * np.clip(s / 3, 0, 1)
    out = {}
    for s, d in (data or dense_numbers()).items():
        a, b = d["a"], d["b"]
        for idx in range(1, lags + 1):
            k = (idx + 1) // 2 * step * (1 if idx % 2 else -1)
            j = (np.arange(size) - k) % size
            za, zb = a["z"], b["z"][j]
            coh = np.abs(4 * ((za * zb.conj()) @ turn).real / WINDOW).max(1) / (
                2 * ((np.abs(za) ** 2).sum(1) + (np.abs(zb) ** 2).sum(1)) / WINDOW)
            feats = np.column_stack([a["sigma"], b["sigma"][j], coh, a["centroid"], b["centroid"][j],
                                     gate(a["arm"], a["sigma"]), gate(b["arm"][j], b["sigma"][j])])
            m = models[1 - int(s) % 2]
            stat = m.beta[0] + ((feats - np.array(m.mu)) / np.array(m.sd)) @ np.array(m.beta[1:])
            for i in range(size):
                if stat[i] > floor and stat[i] >= stat[max(0, i - half) : i + half + 1].max():
                    out[s, idx, i, int(j[i])] = stat[i]
    return out


@pytest.mark.parametrize("blocks", [(1024, 256), (8, 3), (5, 1), (16, 7)])
def test_dense_slides_equal_brute_force_for_any_blocking(dense_grid, blocks):
    models = {g: ranking.Model(g, (0.1, 0, 0.3, 200, 200, 0, 0), (1, 1.1, 0.2, 60, 60, 2, 2), (g, 1, 0.5, 2, -0.3, 0.2, 0.1, 0.4)) for g in (0, 1)}
    out = ranking.dense_slides(dense_grid, slides.SlidePlan(16, 2.0), 1.0, 3, WINDOW, LAGS, 0.5, 2, models, *blocks)
    got = {(r["span_start"], r["lag_index"], r["i"], r["j"]): r["stat"] for r in out.collect()}
    want = dense_brute(models, 0.5, 16, 2, 2)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_that_no_coherence_can_lift_are_passed_over(spark, seed):
    """Also where coefficients are negative, the bound loses nothing; at floor -2 under a tenth of the pairs is transformed."""
    models = {g: ranking.Model(g, (0, 0, 0.3, 200, 200, 0, 0), (1, 1, 0.2, 60, 60, 2, 2), beta) for g, beta in enumerate(
        [(-9.0, 1.5, 1.4, 0.6, -0.3, 0.2, 0.3, 0.4), (-9.0, 1.6, -1.2, -0.7, 0.3, -0.2, -0.5, 0.4)])}
    data = dense_numbers(seed, spans=3, n=150)
    grid = dense_frame(spark, data, 150)
    plan = slides.SlidePlan(30, 3.0)
    pairs = pairs_above(ranking.bound_parts(grid, -2.0, models), plan, 1.0, 2, width=16)
    assert 0 < pairs.count() < 0.1 * 30 * 3 * 150
    out = ranking.dense_slides(grid, plan, 1.0, 3, WINDOW, LAGS, -2.0, 2, models, 32, 7, width=16)
    want = dense_brute(models, -2.0, 30, 3, 2, data, 150)
    got = {(r["span_start"], r["lag_index"], r["i"], r["j"]): r["stat"] for r in out.collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("width, zero, per_span", [(4, False, False), (7, True, False), (64, False, True), (1, True, True)])
def test_pairs_above_equal_all_pairs(spark, width, zero, per_span):
    rng = np.random.default_rng(width)
    sizes = {0.0: 45, 1.0: 7, 2.0: 2, 3.0: 23}
    nan = float("nan")
    data = {s: (rng.normal(size=n), rng.normal(size=n)) for s, n in sizes.items()}
    data[0.0][0][3] = nan
    rows = [(s, n, i, float(data[s][0][i]), None if (s, i) == (3.0, 5) else float(data[s][1][i]), 0.7 + s / 10) for s, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "span_start double, n bigint, i bigint, part_a double, part_b double, need double")
    plan = slides.SlidePlan(21, 2.0, include_zero=zero, per_span=per_span)
    got = sorted(map(tuple, pairs_above(frame, plan, 1.0, 1, width).collect()))
    want = []
    for s, n in sizes.items():
        most = min(21, max(0, n // 2 - 1)) if per_span else 21
        for idx in range(0 if zero else 1, most + 1):
            k = (idx + 1) // 2 * 2 * (1 if idx % 2 else -1)
            for i in range(n):
                j = (i - k) % n
                if n > abs(k) and n > 2 and (s, j) != (3.0, 5) and data[s][0][i] + data[s][1][j] > 0.7 + s / 10:
                    want.append((s, idx, k, i, j))
    assert got == sorted(want) and want


def test_held_out_medians_read_settled_scores(spark, dense_grid, monkeypatch):
    rng = np.random.default_rng(8)
    scores = [F.col(f"sigma_{c}").alias(f"score_{c}") for c in "ab"]
    grid = dense_grid.select("*", *scores).drop("n", "fold", "sigma_a", "sigma_b")
    names = ("score_a", "score_b", "coherence", "centroid_a", "centroid_b", "arm_a", "arm_b")
    rows = [(float(i % 2), *map(float, rng.normal((2, 2, 0.5, 200, 200, 0, 0), (1, 1, 0.1, 30, 30, 2, 2)))) for i in range(60)]
    foreground = spark.createDataFrame(rows, "span_start double, " + ", ".join(f"{c} double" for c in names))
    read, plain = [], reports.percentiles
    monkeypatch.setattr(reports, "percentiles", lambda df, *rest: read.append(df) or plain(df, *rest))
    fit = reports.lr_fit(grid, foreground, 1.0, reports.Band(3, WINDOW, LAGS), 6, 2.0, 4.0)
    got = {r["fold"]: r["median_loglr"] for r in fit.sanity.collect()}
    models = {m.fold: m for m in fit.models}
    scored = reports.score_foreground(foreground, fit.assignment, models).select("fold", "loglr").collect()
    assert got == {g: pytest.approx(np.median([r["loglr"] for r in scored if r["fold"] == g]), rel=1e-12) for g in (0, 1)}
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert read[0].columns == ["fold", "loglr"] and "Join" not in plan and "Project" not in plan


def test_dense_net_sigma_equals_the_pruned_slide(dense_grid):
    plan = slides.SlidePlan(16, 2.0)
    dense = ranking.dense_slides(dense_grid, plan, 1.0, 3, WINDOW, LAGS, 0.8, 2, a_block=8, lag_block=5)
    assert keys(dense) == keys(slides.slide_triggers(dense_grid, plan, 1.0, 0.8, 2))


def test_far_curve_report(spark, grid):
    raw = grid.select("span_start", "i", F.col("sigma_a").alias("score_a"), F.col("sigma_b").alias("score_b"))
    curve = reports.far_curve(raw, 1.0, 2000, 4.0, 4.0, 1.0)
    assert curve.plan.n_lags == N // 4 - 1 and curve.plan.coincident_livetime_s == 3 * N
    t = curve.totals().first()
    assert t["n_stored"] == curve.triggers.count() and t["strict_fraction"] == 0.0
    assert curve.thresholds().count() == 0  # seconds of background resolve none of the targets


def test_a_short_span_takes_no_lags_from_the_others(spark, dense_grid):
    sizes = {0.0: 41, 1.0: 13, 2.0: 2}  # 9, 2 and no lags of 4 s; the last is not longer than a cluster
    rng = np.random.default_rng(8)
    data = {s: (rng.normal(size=n), rng.normal(size=n)) for s, n in sizes.items()}
    rows = [(s, i, float(a[i]), float(b[i])) for s, (a, b) in data.items() for i in range(len(a))]
    curve = reports.far_curve(spark.createDataFrame(rows, "span_start double, i bigint, score_a double, score_b double"), 1.0, floor=0.5)
    assert curve.plan.n_lags == 9 and curve.plan.coincident_livetime_s == 56.0
    assert curve.plan.background_livetime_s == 9 * 41 + 2 * 13
    m = curve.norm
    want = set()
    for s, lags in ((0.0, 9), (1.0, 2)):
        a, b = (data[s][0] - m["mu_a"]) / m["sd_a"], (data[s][1] - m["mu_b"]) / m["sd_b"]
        for idx in range(1, lags + 1):
            k = (idx + 1) // 2 * 4 * (1 if idx % 2 else -1)
            net = (a + np.roll(b, k)) / np.sqrt(2)
            want |= {(s, idx, i, (i - k) % len(a)) for i in range(len(a)) if net[i] >= net[max(0, i - 2):i + 3].max() and net[i] > 0.5}
    assert keys(curve.triggers) == want

    short = dense_grid.filter("span_start = 0 or i < 9").withColumn("n", F.when(F.col("span_start") == 0, 37).otherwise(9).cast("bigint"))
    plan = slides.capped_plan(short, 100, 2.0, 1.0, 2)
    assert plan.n_lags == 17 and plan.background_livetime_s == 17 * 37 + 3 * 9
    dense = keys(ranking.dense_slides(short, plan, 1.0, 3, WINDOW, LAGS, 0.8, 2))
    assert dense == keys(slides.slide_triggers(short, plan, 1.0, 0.8, 2)) and max(k[1] for k in dense if k[0] == 1.0) <= 3


@pytest.mark.parametrize("points", [[0, 1, 2, 4], [1, 2, 3, 4], [0, 1, 1, 3]])
def test_spans_with_gaps_are_refused(spark, points):
    grid = spark.createDataFrame([(0.0, i, 1.0, 1.0) for i in points], "span_start double, i bigint, score_a double, score_b double")
    with pytest.raises(Exception, match="without gaps"):
        slides.with_span_size(grid).collect()


def test_dense_slides_refuse_a_missing_point(spark, dense_grid):
    with pytest.raises(Exception, match="not in the grid"):
        ranking.dense_slides(dense_grid.filter("i <> 4"), slides.SlidePlan(16, 2.0), 1.0, 3, WINDOW, LAGS, 0.5, 2).collect()


@pytest.mark.parametrize("wanted, half, zero", [(5, 0, False), (40, 2, False), (40, 2, True), (10**6, 2, False)])
def test_loudest_slides_are_those_of_all_pairs(spark, wanted, half, zero):
    rng = np.random.default_rng(wanted)
    sizes = {0.0: 90, 1.0: 40, 2.0: 4}
    rows = [(s, n, i, float(rng.normal()), float("nan") if (s, i) == (1.0, 7) else float(rng.gamma(1.0))) for s, n in sizes.items() for i in range(n)]
    grid = spark.createDataFrame(rows, "span_start double, n bigint, i bigint, sigma_a double, sigma_b double")
    plan = slides.SlidePlan(20, 2.0, include_zero=zero)
    # Not the sum itself but something below it, and a cut of its own.
    stat = F.col("sigma_a") + F.col("sigma_b") - F.abs(F.sin(F.col("sigma_a") * 9)) * 0.3
    sel = slides.Selection(lambda df: df.filter("sigma_a > -1").withColumn("s", stat), parts=(F.col("sigma_a"), F.col("sigma_b")))
    every = slides.cluster_local_max(slides.run_slides(grid, plan, 1.0, sel, half), "s", half).filter("not isnan(s)")
    want = sorted(((r["s"], r["span_start"], r["lag_index"], r["i"], r["j"]) for r in every.collect()), reverse=True)
    found = loudest_slides(grid, plan, 1.0, sel, "s", wanted, half, width=16).filter("not isnan(s)").collect()
    got = sorted(((r["s"], r["span_start"], r["lag_index"], r["i"], r["j"]) for r in found), reverse=True)
    assert len(got) >= min(wanted, len(want))
    assert got == want[: len(got)]
    assert wanted > 1000 or len(got) < len(want)
    with pytest.raises(RefusedError, match="no bound"):
        loudest_slides(grid, plan, 1.0, slides.Selection(lambda df: df), "s", 3)
