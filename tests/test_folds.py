import numpy as np
import pytest
from pyspark.sql import functions as F

from farspark.errors import FoldLeakError
from farspark.operators import folds, segments as S
from farspark.operators.settle import settle
from farspark.operators.ordered import Cells

SCHEMA = "channel string, start_s double, end_s double"


def spans(n=20, start=1_238_000_000.0, dur=4096.0, gap=512.0, channels=("A",)):
    return [(c, start + i * (dur + gap), start + i * (dur + gap) + dur) for i in range(n) for c in channels]


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def greedy(blocks, n_folds):
    """The rule step by step: advance when the share is reached, and when blocks are about to run out."""
    share, acc, fold, out = sum(blocks) / n_folds, 0.0, 0, []
    for g, live in enumerate(blocks):
        left, need = len(blocks) - g, n_folds - 1 - fold
        if fold < n_folds - 1 and g and (left == need or (acc >= share * (fold + 1) and left >= need)):
            fold += 1
        out.append(fold)
        acc += live
    return out


@pytest.mark.parametrize("cell_rows", [None, 5])
@pytest.mark.parametrize("seed", range(3))
def test_folds_follow_the_greedy_rule(make, seed, cell_rows):
    rng = np.random.default_rng(seed)
    live = rng.integers(1, 200, size=int(rng.integers(6, 30))).astype(float)
    at = np.cumsum(live + 10) - live
    segs = make([("A", float(a), float(a + d)) for a, d in zip(at, live)])
    for n in (2, 4):
        cells = Cells.fit(segs, "start_s", cell_rows=cell_rows)
        got = [r["fold"] for r in folds.gps_grouped_folds(segs, n, cells).orderBy("start_s").collect()]
        assert got == greedy(live.tolist(), n)


def test_as_many_blocks_as_folds_fill_every_fold(make):
    for n in (2, 3):
        got = folds.gps_grouped_folds(make(spans(n)), n).select("fold").distinct().count()
        assert got == n


def test_both_channels_of_a_span_share_a_fold(make):
    segs = make(spans(20, dur=14400.0, gap=3600.0, channels=("A", "B")))
    folded = folds.assert_disjoint_folds(folds.gps_grouped_folds(segs))
    assert folded.groupBy("start_s").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folded.groupBy("fold").count().count() == 2


def test_refusals(make):
    with pytest.raises(ValueError, match="cannot fill"):
        folds.gps_grouped_folds(make([("A", 0.0, 100.0)] * 20))
    with pytest.raises(ValueError):
        folds.gps_grouped_folds(make(spans()), 1)
    bad = make([("A", 0.0, 100.0), ("B", 50.0, 150.0)]).withColumn("fold", F.when(F.col("channel") == "A", 0).otherwise(1))
    with pytest.raises(FoldLeakError, match="overlap in time"):
        folds.assert_disjoint_folds(bad)
    with pytest.raises(ValueError, match="no such split.*hpo_train"):
        folds.three_way_split(make(spans()), 0.5, 0.5)


@pytest.fixture(scope="module")
def three(make):
    return make(spans(40, 1_000_000.0, 3600.0, 400.0, ("A", "B")))


@pytest.mark.parametrize("unit", ["block", "segment"])
def test_three_way_split_partitions_the_training_fold_in_time(three, unit):
    train = folds.gps_grouped_folds(three).filter("fold = 0").drop("fold")
    parts = folds.three_way_split(train, unit=unit)
    assert tuple(folds.split_partition_check(parts, train).first()) == (0, 0, 0)
    s = {r["split"]: r for r in folds.fold_summary(parts, "split").collect()}
    assert s["hpo_train"]["span_end"] <= s["hpo_val"]["span_start"] and s["hpo_val"]["span_end"] <= s["hpo_bg"]["span_start"]
    if unit == "block":
        assert parts.groupBy("start_s").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_reads_are_judged_and_the_final_report_is_made_once(spark, three, tmp_path):
    path = str(tmp_path / "audit")
    labelled = folds.train_eval_labels(folds.gps_grouped_folds(three), 1)
    inner = folds.three_way_split(labelled.filter("split = 'train'").drop("split"))
    parts = settle(labelled.drop("fold").unionByName(inner.select(*labelled.drop("fold").columns)))
    ask = lambda phase, split: folds.read_request(spark, phase, split, "r", "test")
    asked = [(p, s, "r", None, "test", 0.0) for p in folds.PERMISSIONS for s in (*folds.SPLITS, "other")]
    requests = spark.createDataFrame(asked, "phase string, split string, label string, trial int, caller string, t double")
    judged = folds.judge_reads(requests, parts, folds.read_audit(spark, path)).collect()
    assert len(judged) == 30 and all(r["refusal"] is not None or r["n_segments"] > 0 and r["livetime"] > 0 for r in judged)
    assert {(r["phase"], r["split"]) for r in judged if r["refusal"] is None} == {(p, s) for p, splits in folds.PERMISSIONS.items() for s in splits}
    for phase, split in (("training", "train"), ("calibration", "hpo_bg"), ("final", "eval")):
        folds.append_audit(folds.granted_reads(folds.require_granted(folds.judge_reads(ask(phase, split), parts, folds.read_audit(spark, path)))), path)
    trail = folds.read_audit(spark, path)
    assert trail.count() == 3
    folds.assert_eval_untouched(trail)
    with pytest.raises(FoldLeakError, match="before"):
        folds.require_granted(folds.judge_reads(ask("final", "eval"), parts, trail))
    with pytest.raises(FoldLeakError, match="eval"):
        folds.require_granted(folds.judge_reads(ask("hpo", "eval"), parts))
    with pytest.raises(FoldLeakError, match="early reads"):
        folds.assert_eval_untouched(trail.withColumn("phase", F.lit("hpo")))


@pytest.mark.parametrize("cell_rows", [None, 2])
def test_coincident_livetime(make, cell_rows):
    segs = make([("A", 0.0, 100.0), ("A", 200.0, 300.0), ("B", 50.0, 250.0), ("A", 210.0, 220.0)])
    cells = Cells.fit(segs, "start_s", cell_rows=cell_rows)
    assert S.coincident_livetime(segs, "A", "B", cells).first()[0] == pytest.approx(100.0)
    assert S.coincident_livetime(segs, "A", "C", cells).first()[0] == 0.0


def test_missing_data_halves_the_coincident_livetime(make):
    nominal = make([("A", 0.0, 100.0), ("B", 0.0, 100.0), ("A", 200.0, 300.0), ("B", 200.0, 300.0)])
    have = nominal.filter("not (channel = 'B' and start_s = 200)")
    live = lambda s: S.coincident_livetime(s, "A", "B").first()[0]
    assert (live(nominal), live(S.available_segments(nominal, have))) == (200.0, 100.0)
    assert S.missing_segments(nominal, have).first()["livetime_s"] == 100.0


def test_touching_segments_are_separate_blocks(make):
    segs = make([("A", 0.0, 10.0), ("B", 10.0, 20.0), ("A", 15.0, 18.0), ("B", 17.0, 30.0)])
    assert [r["grp"] for r in S.overlap_groups(segs).orderBy("start_s").collect()] == [0, 1, 1, 1]


@pytest.mark.parametrize("parts", [1, 7])
def test_weighted_pick_is_repeatable_inside_and_proportional(spark, make, parts):
    segs = make([("A", 0.0, 104.0), ("A", 1000.0, 1304.0), ("A", 5000.0, 5003.0)])
    draws = spark.range(4000).withColumnRenamed("id", "draw_id").repartition(parts)
    got = S.livetime_weighted_pick(draws, segs, 4.0, seed=7).orderBy("draw_id").collect()
    assert len(got) == 4000 and all(r["segment_start_s"] <= r["start_s"] and r["end_s"] <= r["segment_end_s"] for r in got)
    share = sum(r["segment_start_s"] == 1000.0 for r in got) / 4000
    assert abs(share - 0.75) < 0.03
    assert got[17]["start_s"] == S.livetime_weighted_pick(spark.range(30).withColumnRenamed("id", "draw_id"), segs, 4.0, seed=7).orderBy("draw_id").collect()[17]["start_s"]
    with pytest.raises(ValueError):
        S.livetime_weighted_pick(draws, segs, 1e6)
