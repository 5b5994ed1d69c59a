import numpy as np
import pytest
from pyspark.sql import functions as F

from farspark.errors import RefusedError
from farspark.operators import ordered, ranking, segments as S, volume
from farspark.plans import reports

META = "campaign_id string, checkpoint string, model_id string, gate_applied boolean, keep_above double, n_lags int, background_livetime_yr double"


@pytest.fixture(scope="module")
def ranked(spark):
    rng = np.random.default_rng(4)
    models = {g: ranking.Model(g, (0.0,) * 7, (1.0,) * 7, (0.5, 1, 1, 0, 0, 0, 0, 0), (0.0, 1.0, 0.0, 1.0)) for g in (0, 1)}
    names = "span_start double, score_a double, score_b double, coherence double, centroid_a double, centroid_b double, arm_a double, arm_b double, network_snr double"
    fg = spark.createDataFrame([(float(i % 2) * 100, *map(float, rng.normal(size=2)), 0.1, 1.0, 1.0, 0.0, 0.0, 8.0) for i in range(50)], names)
    fold = spark.createDataFrame([(0.0, 0), (100.0, 1)], "span_start double, fold int")
    background = spark.createDataFrame([(float(x),) for x in rng.normal(size=400) * 2 + 4 if x > -2], "loglr double")
    return background, fg, fold, models


def test_a_stored_background_is_rescored_and_not_restamped(spark, ranked):
    background, fg, fold, models = ranked
    meta = lambda *row: spark.createDataFrame([row], META)
    run = meta("c", "ck", "m", False, -2.0, 8, 4.0)
    out = reports.lr_rescore(background, run, fg, run, fold, models, -2.0, (10.0, 5.0))
    want = reports.lr_far(background, reports.score_foreground(fg, fold, models), 4.0, (10.0, 5.0))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(out["efficiency"]) == key(want["efficiency"]) and key(out["run"]) == key(run)
    assert out["provenance"].first()["provenance"] == "verified"
    for other, why in (((("c", "ck2", "m", False, -2.0, 8, 4.0)), "checkpoints"), (("c", "ck", "n", False, -2.0, 8, 4.0), "models")):
        with pytest.raises(RefusedError, match=why):
            reports.lr_rescore(background, run, fg, meta(*other), fold, models)
    with pytest.raises(RefusedError, match="cut at"):
        reports.lr_rescore(background, run, fg, run, fold, models, keep_above=-3.0)
    with pytest.raises(RefusedError, match="under the floor"):
        reports.lr_rescore(background, meta("c", "ck", "m", False, 9.0, 8, 4.0), fg, run, fold, models)
    with pytest.raises(RefusedError, match="one row"):
        reports.lr_rescore(background, run.unionByName(run), fg, run, fold, models)


def test_provenance_as_rows_keeps_what_cannot_be_checked(spark):
    meta = lambda rows: spark.createDataFrame([(*r, 0.0, 1, 1.0) for r in rows], META)
    a = meta([("1", "x", "m", False), ("2", None, "m", False), ("3", "x", None, True), ("4", "x", "m", None)])
    b = meta([("1", "y", "n", True), ("2", "y", "m", False), ("3", "x", "m", False), ("4", "x", "m", True)])
    got = {r["campaign_id"]: r["provenance"] for r in ranking.provenance_status(a, b).collect()}
    assert got == {"1": "mismatched", "2": "unverified", "3": "mismatched", "4": "verified"}
    with pytest.raises(RefusedError, match="campaign_id"):
        ranking.require_provenance(a, b)


def test_volume_facts_warn_of_lost_injections(spark):
    fg = spark.createDataFrame([(0.1, 0.9), (0.4, 0.5)], "z double, weight double")
    whole, lost = reports.vt_facts(fg, 2).first(), reports.vt_facts(fg, 3).first()
    assert whole["warning"] is None and whole["n_lost"] == 0 and (whole["z_max"], whole["weight_min"], whole["weight_max"]) == (0.4, 0.5, 0.9)
    assert lost["warning"] == "lost 1 of 3 attempted injections"


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_interpolation_by_group_and_cells(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(ordered, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(cell_rows)
    grids = {"a": np.sort(rng.uniform(0, 50, 40)), "b": np.sort(rng.uniform(20, 30, 7)), "c": np.array([5.0])}
    values = {g: rng.normal(size=len(x)) for g, x in grids.items()}
    grid = spark.createDataFrame([(g, float(x), float(y)) for g in grids for x, y in zip(grids[g], values[g])], "g string, x0 double, y double")
    probes = [(g, float(x)) for g in grids for x in (*rng.uniform(-5, 60, 30), *grids[g][:3], grids[g][-1])] + [("a", None), ("none", 3.0)]
    got = volume.grid_interpolate(spark.createDataFrame(probes, "g string, x double"), "x", grid, "x0", ["y"], ["g"], beyond="null").collect()
    assert len(got) == len(probes)
    for r in got:
        x, y = grids.get(r["g"]), values.get(r["g"])
        if x is None or r["x"] is None or r["x"] > x[-1]:
            assert r["y"] is None
        else:
            assert r["y"] == pytest.approx(np.interp(r["x"], x, y))
    with pytest.raises(Exception, match="past the last"):
        volume.grid_interpolate(spark.createDataFrame([(99.0,)], "x double"), "x", grid.filter("g = 'a'").drop("g"), "x0", ["y"]).collect()


def test_incomplete_segments_and_zero_baselines_are_rows_too(spark):
    segs = spark.createDataFrame([("A", 0.0, 10.0), ("B", 0.0, 10.0), ("C", 0.0, 10.0)], "channel string, start_s double, end_s double")
    samples = segs.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("channel") == "A", 10).otherwise(5)))).filter("channel <> 'C'")
    got = {r["channel"]: (r["n_samples"], r["complete"]) for r in S.completeness(samples, segs, 1.0).collect()}
    assert got == {"A": (10, True), "B": (5, False), "C": (0, False)}
    vol = spark.createDataFrame([(1.0, 4.0, 1.0), (2.0, 0.0, 0.0)], "far_per_yr double, v_sens_gpc3 double, v_sens_err_gpc3 double")
    rows = {r["far_per_yr"]: r["ratio"] for r in volume.vt_ratio(vol, vol, zero_baseline="null").collect()}
    assert rows == {1.0: 1.0, 2.0: None}
