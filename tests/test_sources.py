import json

import pytest
from pyspark.sql import functions as F

from farspark.errors import RefusedError
from farspark.operators import records, segments as S
from farspark.sources import io


def write(path, doc):
    path.write_text(json.dumps(doc))
    return str(path)


def test_segment_shapes(spark, tmp_path):
    listed = write(tmp_path / "l.json", {"segments": [[0, 100, 100, "GW"], [200, 300, 100, None]]})
    keyed = write(tmp_path / "k.json", {"A": [[0, 10]], "B": [[5, 15], [20, 30.5]]})
    bare = write(tmp_path / "b.json", [[1, 2], [3, 4]])
    got = io.read_segments(spark, listed, "A")
    assert [(r["start_s"], r["event"]) for r in got.orderBy("start_s").collect()] == [(0.0, "GW"), (200.0, None)]
    assert io.named_events(got).collect() == [("GW", 0.0)]
    assert io.read_segments(spark, listed, "A", drop_event=True).count() == 1
    assert io.read_segments(spark, keyed, "B").agg(F.max("end_s")).first()[0] == 30.5
    assert io.read_segments(spark, bare, "C").select("channel").distinct().first()[0] == "C"
    assert io.read_segments(spark, write(tmp_path / "o.json", {"A": [[0, 10]]})).first()["channel"] == "A"
    for path in (listed, keyed, bare):
        with pytest.raises(RefusedError, match="channel"):
            io.read_segments(spark, path)
    with pytest.raises(RefusedError, match="no segments left"):
        io.read_segments(spark, write(tmp_path / "e.json", {"segments": [[0, 1, 1, "GW"]]}), "A", drop_event=True)


def grid(spark, spans):
    rows = [(float(s), i, 1.0, 2.0) for s in spans for i in range(3)]
    return spark.createDataFrame(rows, "span_start double, i bigint, score_a double, score_b double")


def test_grid_resumes_and_refuses_missing_columns(spark, tmp_path):
    path = str(tmp_path / "grid")
    io.write_grid(grid(spark, (0, 90000)), path)
    io.write_grid(grid(spark, (0, 90000, 100)), path)
    assert io.read_grid(spark, path).groupBy("span_start").count().filter("count <> 3").count() == 0
    assert io.read_grid(spark, path).count() == 9
    with pytest.raises(RefusedError, match="arm_a"):
        io.read_grid(spark, path, ("score_a", "arm_a"))


def test_triggers_are_never_restamped(spark, tmp_path):
    meta = spark.createDataFrame([("c", 1.0, 2, 6.0, "ck", "m", False)], io.schemas.RUN_META)
    t = spark.createDataFrame([(1.0,)], "stat double")
    io.write_triggers(t, meta, str(tmp_path / "run"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        io.write_triggers(t, meta, str(tmp_path / "run"))
    with pytest.raises(RefusedError):
        io.write_triggers(t, meta.drop("model_id"), str(tmp_path / "other"))
    assert io.read_triggers(spark, str(tmp_path / "run"))[1].first()["model_id"] == "m"


def test_curves_counts_and_banks(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0)], "f double, PSD double").write.parquet(str(tmp_path / "p"))
    assert io.read_psd(spark, str(tmp_path / "p")).first() == (1.0, 2.0)
    spark.createDataFrame([(1.0, 2.0)], "x double, PSD double").write.parquet(str(tmp_path / "q"))
    with pytest.raises(RefusedError):
        io.read_psd(spark, str(tmp_path / "q"))
    (tmp_path / "c.yaml").write_text("# measured\ncomponents:\n  cae: 120  # weights\n  arm: 7\n")
    for path in (write(tmp_path / "c.json", {"components": {"cae": 120, "arm": 7}}), write(tmp_path / "d.json", {"cae": 120, "arm": 7}), str(tmp_path / "c.yaml")):
        assert dict(map(tuple, io.read_counts(spark, path).collect())) == {"cae": 120, "arm": 7}
    spark.createDataFrame([(1, [0.5], None), (2, [0.5], 1.0)], "tile_id bigint, data array<float>, y float").write.parquet(str(tmp_path / "bank"))
    assert io.read_bank(spark, str(tmp_path / "bank")).filter(F.isnan("y")).count() == 1


def test_completeness(spark):
    segs = spark.createDataFrame([("A", 0.0, 10.0)], "channel string, start_s double, end_s double")
    samples = lambda n: segs.crossJoin(spark.range(n))
    assert S.completeness_check(samples(90), segs, 10.0).count() == 1
    with pytest.raises(RefusedError, match="89 of 100"):
        S.completeness_check(samples(89), segs, 10.0)


RECORD = dict(name="r", hypothesis="h", change="c", parameters={"cae": 1}, folds={"n": 2}, primary={"eff": 0.2}, seeds=[42, 43, 44],
              verdict="keep", reasoning="because", novel_key=1)


def test_records_say_what_is_missing(spark, tmp_path):
    cases = {"ok": {}, "hypothesis": {"hypothesis": " "}, "parameter": {"parameters": {}}, "fold": {"folds": {}}, "primary": {"primary": {}},
             "seeds": {"seeds": [1]}, "verdict": {"verdict": "maybe"}, "reasoning": {"reasoning": ""}, "change": {"change": ""}}
    for key, gap in cases.items():
        d = tmp_path / key.replace(" ", "_")
        d.mkdir()
        write(d / "summary.json", RECORD | {"name": key} | gap)
    got = io.collect_records(spark, str(tmp_path))
    assert "novel_key" not in got.columns
    for r in records.record_problems(got).collect():
        assert r["valid"] == (r["name"] == "ok")
        assert r["valid"] or (len(r["problems"]) == 1 and r["name"] in r["problems"][0])
    with pytest.raises(RefusedError):
        records.require_valid(got)


def test_trials(spark, tmp_path):
    rows = [dict(index=0, params={"lr": 0.1}, objective=3.0, state="done"), dict(index=1, params={"lr": 0.2}, objective=1.0, state="done"),
            dict(index=2, params={}, objective=None, state="failed", error="x"), dict(index=3, params={"lr": 0.3}, objective=1.0, state="done")]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    trials = io.read_trials(spark, str(path))
    assert records.best_trial(trials).first()["index"] == 1
    s = records.sweep_summary(trials).first()
    assert (s["n_trials"], s["n_done"], s["n_failed"], s["best"]["params"]) == (4, 3, 1, {"lr": 0.2})
    with pytest.raises(Exception, match="no trial completed"):
        records.best_trial(trials.filter("state = 'failed'")).collect()
    assert records.sweep_summary(trials.filter("state = 'failed'")).first()["best"] is None


def test_budget(spark):
    ref = spark.createDataFrame([("a", 100), ("b", 100)], "component string, count bigint")
    cand = spark.createDataFrame([("a", 110), ("b", 111)], "component string, count bigint")
    got = {r["component"]: (r["passed"], r["ratio"]) for r in records.budget_verdict(cand, ref).collect()}
    assert got == {"a": (True, 1.1), "b": (False, 1.11)}
    with pytest.raises(Exception, match="outside the parameter budget"):
        records.budget_verdict(cand, ref, strict=True).collect()
    with pytest.raises(Exception, match="positive"):
        records.budget_verdict(cand, ref.withColumn("count", F.lit(0).cast("bigint"))).collect()


def test_flatten(spark):
    df = spark.sql("select named_struct('b', 1, 'c', named_struct('d', 2)) as a, 3 as e")
    assert records.flatten_struct(df).first().asDict() == {"a.b": 1, "a.c.d": 2, "e": 3}
