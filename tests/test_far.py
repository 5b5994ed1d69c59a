import numpy as np
import pytest
from pyspark.sql import functions as F

from farspark.errors import RefusedError
from farspark.functions import expressions as X
from farspark.operators import efficiency as eff, far, volume


def frame(spark, x, column="stat"):
    return spark.createDataFrame([(float(v),) for v in x], f"{column} double")


@pytest.fixture(scope="module")
def line(spark):
    return frame(spark, range(100))


def rate(spark, line, x, trials):
    return far.far_of(frame(spark, [x]), line, "stat", 10.0, trials).first()["far_per_yr"]


def test_rates_are_inclusive_scale_with_trials_and_are_never_zero(spark, line):
    assert rate(spark, line, 50.0, 1) == pytest.approx(5.0)
    assert rate(spark, line, 50.0, 2) == pytest.approx(10.0)
    assert rate(spark, line, 1e6, 4) == pytest.approx(0.4)
    with pytest.raises(ValueError):
        far.far_of(line, line, "stat", 0.0)


def test_trials_factor():
    assert X.trials_factor() == 4 and X.trials_factor(n_arms=1) == 2


def test_threshold_refuses_to_extrapolate_and_flags_a_floor(spark, line):
    with pytest.raises(RefusedError, match="below what"):
        far.thresholds_at_far(line, "stat", 2.0, [0.01])
    assert far.thresholds_at_far(line, "stat", 2.0, [0.01], below_floor="drop").count() == 0
    rows = {r["far_per_yr"]: r for r in far.thresholds_at_far(line, "stat", 10.0, [2.0, 40.0, 400.0]).collect()}
    assert rows[2.0]["threshold"] == 95.0 and rows[2.0]["resolved"]
    assert rows[40.0]["threshold"] == 0.0 and not rows[40.0]["resolved"]
    assert rows[400.0]["threshold"] == 0.0


def test_threshold_round_trips(spark):
    x = np.random.default_rng(1).normal(size=20000)
    bg = frame(spark, x)
    thr = far.thresholds_at_far(bg, "stat", 100.0, [1.0]).first()["threshold"]
    assert thr == np.sort(x)[-25]
    assert far.far_of(frame(spark, [thr]), bg, "stat", 100.0).first()["far_per_yr"] <= 1.0 + 1e-9


def test_efficiency_interval_volume_and_ratio(spark):
    rng = np.random.default_rng(2)
    bg, x = frame(spark, rng.normal(size=20000)), rng.normal(4.5, 1.0, size=1000)
    fg = frame(spark, x)
    e = eff.efficiency_at_far(fg, bg, "stat", 100.0, [1.0]).first()
    assert 0.5 < e["efficiency"] <= 1.0 and e["lo"] <= e["efficiency"] <= e["hi"]
    vol = volume.sensitive_volume(fg, bg, "stat", 100.0, [1.0], 10.0, 0.5)
    v = vol.first()
    assert 0 < v["v_sens_gpc3"] <= 10 and v["vt_gpc3_yr"] == pytest.approx(0.5 * v["v_sens_gpc3"])
    p = e["efficiency"]
    assert v["v_sens_err_gpc3"] == pytest.approx(10 * np.sqrt(p * (1 - p) / 1000))
    better = volume.sensitive_volume(fg.select((F.col("stat") + 0.5).alias("stat")), bg, "stat", 100.0, [1.0], 10.0)
    r = volume.vt_ratio(better, vol).first()
    assert r["ratio"] > 1 and r["ratio_err"] > 0
    with pytest.raises(Exception, match="zero"):
        volume.vt_ratio(vol, vol.withColumn("v_sens_gpc3", F.lit(0.0))).collect()


def test_wilson_at_the_boundary(spark):
    lo, hi = X.wilson_interval(F.lit(0), F.lit(100))
    r = spark.range(1).select(lo, hi).first()
    assert r["lo"] == 0.0 and r["hi"] > 0.0
    lo, hi = X.wilson_interval(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(lo, hi).first()) == (0.0, 0.0)


def test_nan_never_passes_and_an_empty_channel_cannot_be_beaten(spark):
    fg = spark.createDataFrame([("a", float("nan")), ("a", 9.0), ("b", 9.0)], "channel string, stat double")
    thr = spark.createDataFrame([("a", 100.0, 5.0)], "channel string, far_per_yr double, threshold double")
    got = far.own_channel_threshold(fg, thr, "stat").orderBy("channel", "stat").collect()
    assert [r["found"] for r in got] == [True, False, False]
    assert got[2]["threshold"] == float("inf")


def test_efficiency_vs_keeps_empty_bins_and_half_open_edges(spark):
    j = spark.createDataFrame([(6.0, True), (8.0, False), (40.0, True)], "par double, found boolean")
    got = eff.efficiency_vs(j, "par", [6.0, 8.0, 10.0, 40.0]).orderBy("bin").collect()
    assert [(r["n"], r["efficiency"]) for r in got] == [(1, 1.0), (1, 0.0), (0, None)]


def test_family_bins_refuse_a_gap(spark):
    j = spark.createDataFrame([(6.0, 0.9)], "par double, hm double")
    with pytest.raises(Exception, match="a bin is empty"):
        eff.family_bin_rates(j, "par", [6.0, 8.0, 10.0], hm=F.col("hm") > 0.5).collect()


def test_top_k_is_whole_under_ties(spark):
    rows = spark.createDataFrame([("a", 5.0, i) for i in range(50)] + [("a", 9.0, 99), ("b", 1.0, 0)], "channel string, stat double, id bigint")
    top = far.top_k_per_channel(rows, "stat", 10, ties=["id"]).collect()
    a = sorted(r["id"] for r in top if r["channel"] == "a")
    assert a == [*range(9), 99] and sum(r["channel"] == "b" for r in top) == 1


def test_geometric_ranks():
    want = sorted(set(np.clip(np.round(np.geomspace(1, 5000, 8)).astype(int), 1, 5000).tolist()))
    assert far.geometric_ranks(5000) == want and far.geometric_ranks(1) == [1]


def test_comoving_weight_against_quadrature(spark):
    d = spark.createDataFrame([(100.0,), (1000.0,), (5000.0,), (5000.0,)], "distance_mpc double")
    got = volume.comoving_weight(d).orderBy("distance_mpc").collect()
    assert len(got) == 4
    h0, om = 67.66, 0.30966
    z = np.linspace(0, 2.0, 400001)
    e = np.sqrt(om * (1 + z) ** 3 + 1 - om)
    dc = 299792.458 / h0 * np.concatenate([[0], np.cumsum((1 / e[1:] + 1 / e[:-1]) / 2 * np.diff(z))])
    dl = (1 + z) * dc
    w = 299792.458 / h0 * dc**2 / e / np.maximum(dl**2 * np.gradient(dl, z), 1e-300) / (1 + z)
    for r in got:
        assert r["z"] == pytest.approx(np.interp(r["distance_mpc"], dl, z), rel=1e-5)
        assert r["weight"] == pytest.approx(np.interp(r["distance_mpc"], dl, w), rel=1e-4)
    with pytest.raises(Exception, match="past the last grid node"):
        volume.comoving_weight(d.withColumn("distance_mpc", F.lit(1e6))).collect()


def test_lost_injections_stay_in_the_denominator(spark):
    j = spark.createDataFrame([(True, 0.5), (False, 0.5)], "found boolean, weight double")
    r = volume.comoving_volume(j, 1000.0, 10).first()
    assert r["v_comoving_gpc3"] == pytest.approx(4 / 3 * np.pi * 0.05) and r["n_found"] == 1


def test_a_channel_without_background_has_an_infinite_rate(spark):
    from farspark.plans import reports

    background = spark.createDataFrame([("general", float(x)) for x in range(100)], "channel string, stat double")
    foreground = spark.createDataFrame(
        [("general", 50.0, 7.0), ("strict", 1.0, 7.5), ("strict", 2.0, 12.0)], "channel string, stat double, network_snr double")
    got = {r["snr_band"]: r for r in reports.efficiency_report(background, foreground, 10.0, (100.0,), stat="stat")["far_quantiles"].collect()}
    assert got[1]["best_far"] == got[1]["median_far"] == float("inf")
    assert got[0]["best_far"] == pytest.approx(20.0) and got[0]["median_far"] == float("inf")


@pytest.mark.parametrize("k", [1, 3, 40, 500])
def test_top_k_with_a_value_that_fills_a_channel(spark, k):
    rows = [("c", 7.0, i) for i in range(300)] + [("c", 9.0 + i, 1000 + i) for i in range(2)] + [("c", 1.0, 5000), ("d", 2.0, 1)]
    df = spark.createDataFrame(rows, "channel string, stat double, i int").repartition(5)
    got = [(r["channel"], r["stat"], r["i"], r["rank"]) for r in far.top_k_per_channel(df, "stat", k, ties=["i"]).collect()]
    order = sorted((r for r in rows if r[0] == "c"), key=lambda r: (-r[1], r[2]))[:k]
    assert sorted(got) == sorted([(*r, n) for n, r in enumerate(order, 1)] + [("d", 2.0, 1, 1)])


def test_reports_read_a_rank_table_as_they_would_the_background(spark):
    rng = np.random.default_rng(6)
    bg = spark.createDataFrame([("ab"[int(i % 3 == 0)], float(np.round(x, 1))) for i, x in enumerate(rng.normal(size=600))] + [("a", float("nan"))], "channel string, stat double")
    fg = spark.createDataFrame([("abc"[i % 3], 0.5 if i % 2 else float(x)) for i, x in enumerate(rng.normal(size=200))], "channel string, stat double")
    table = far.rank_table(bg, "stat", ["channel"], foreground=fg)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    columns = ["channel", "far_per_yr", "n_allowed", "n_background", "threshold", "resolved"]
    want = far.thresholds_at_far(bg, "stat", 2.0, (1000.0, 100.0, 5.0, 0.1), 4, ["channel"], below_floor="drop")
    got = far.thresholds_from(table, "stat", 2.0, (1000.0, 100.0, 5.0, 0.1), 4, ["channel"])
    assert key(got, *columns) == key(want, *columns)
    above = {(r["channel"], r["far_per_yr"]): r["n_above"] for r in far.achieved_far(bg.filter("not isnan(stat)"), want, "stat", 2.0, 4, ["channel"]).collect()}
    assert {(r["channel"], r["far_per_yr"]): r["n_above"] for r in got.collect()} == above
    plain = far.far_of(fg, bg, "stat", 2.0, 4, ["channel"]).filter("channel <> 'c'")
    rated = far.far_from(table, fg, "stat", 2.0, 4, ["channel"])
    assert key(rated.filter("channel <> 'c'"), "channel", "stat", "far_per_yr") == key(plain, "channel", "stat", "far_per_yr")
    assert {r["far_per_yr"] for r in rated.filter("channel = 'c'").collect()} == {float("inf")}
    one = table.filter("channel = 'a'").drop("channel")
    a = bg.filter("channel = 'a'")
    assert key(far.scanned_from(one, fg, "stat", 2.0), "n_louder", "threshold", "efficiency") == key(
        far.scanned_ranks(a, fg, "stat", 2.0), "n_louder", "threshold", "efficiency")
    assert key(far.loudest_from(table, "stat", ["channel"]).filter("n > 0"), "channel", "loudest", "n") == key(far.loudest(bg, "stat", ["channel"]), "channel", "loudest", "n")
