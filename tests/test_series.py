import numpy as np
import pytest
from pyspark.sql import functions as F

from farspark.functions import arrays as A, kernels as K
from farspark.functions import expressions as X
from farspark.operators import series

FS = 4096


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    out = []
    for i, shared in enumerate((0.0, 0.5, 3.0)):
        s = rng.normal(size=4 * FS)
        out.append((i, (rng.normal(size=4 * FS) + shared * s).tolist(), (rng.normal(size=4 * FS) + shared * np.roll(s, 20)).tolist()))
    return spark.createDataFrame(out, "id int, a array<double>, b array<double>").cache()


def test_coherence_forms_agree_and_rise_with_the_shared_part(pairs):
    coef = K.band_coefficients()
    z = pairs.select("id", K.coherence()("a", "b").alias("direct"), coef("a").alias("p"), coef("b").alias("q"))
    z = z.withColumn("bulk", K.coherence_from_coefficients(20, 4096)("p.re", "p.im", "q.re", "q.im"))
    z = z.withColumn("sql", A.coherence_from_coefficients_sql("p.re", "p.im", "q.re", "q.im", 20, 4096, 45))
    got = z.select("direct", "bulk", "sql", F.size("p.re").alias("bins"), "p.first_bin", "p.n").orderBy("id").collect()
    assert all((r["bins"], r["first_bin"], r["n"]) == (481, 20, 4096) for r in got)
    assert series.band_bins(FS, 1.0, (20.0, 500.0)) == (20, 481, 4096)
    for r in got:
        assert r["bulk"] == pytest.approx(r["sql"], rel=1e-9) and r["bulk"] == pytest.approx(r["direct"], rel=1e-6)
    assert got[0]["direct"] < got[1]["direct"] < got[2]["direct"]


def test_coherence_equals_the_definition(pairs):
    row = pairs.filter("id = 1").select("a", "b", K.coherence()("a", "b").alias("c"), K.centroid()("a").alias("f")).first()
    mid = lambda x, n: np.array(x)[2 * FS - n // 2 : 2 * FS + n // 2]
    freq = np.fft.rfftfreq(FS, 1 / FS)

    def limited(x):
        s = np.fft.rfft(mid(x, FS) * np.hanning(FS))
        s[(freq < 20) | (freq > 500)] = 0
        y = np.fft.irfft(s, n=FS)
        return y - y.mean()

    a, b = limited(row["a"]), limited(row["b"])
    want = max(abs(2 * (a * np.roll(b, k)).sum()) / ((a * a).sum() + (b * b).sum()) for k in range(-45, 46))
    assert row["c"] == pytest.approx(want)
    w = mid(row["a"], FS // 2)
    p = np.abs(np.fft.rfft((w - w.mean()) * np.hanning(FS // 2))) ** 2
    f = np.fft.rfftfreq(FS // 2, 1 / FS)
    k = (f >= 20) & (f <= 400)
    assert row["f"] == pytest.approx((p[k] * f[k]).sum() / p[k].sum())


def test_snr_is_linear_and_adds_in_quadrature(spark, pairs):
    freq, psd = [0.0, 2048.0], [2.0, 2.0]
    udf = K.optimal_snr(freq, psd)
    one, two = pairs.select(udf("a").alias("x"), udf(F.transform("a", lambda v: v * 2)).alias("y")).first()
    assert two == pytest.approx(2 * one)
    assert pairs.select(K.optimal_snr(freq, psd, f_low=3000.0)("a")).first()[0] == 0.0
    long = pairs.select(F.col("id").alias("source_id"), F.lit("a").alias("channel"), F.col("a").alias("series")).unionByName(
        pairs.select(F.col("id").alias("source_id"), F.lit("b").alias("channel"), F.col("b").alias("series")))
    net = series.network_snr(long, {"a": (freq, psd), "b": (freq, psd)}, FS).filter("source_id = 0").first()["network_snr"]
    x, y = pairs.filter("id = 0").select(udf("a"), udf("b")).first()
    assert net == pytest.approx(np.hypot(x, y))


def test_curves_per_channel_and_epoch_meet_their_series(spark, pairs):
    freq = np.linspace(0, FS / 2, 40)
    psd = {(c, e): 1.0 + k + np.sin(freq / 300) ** 2 for k, (c, e) in enumerate([("a", 1), ("a", 2), ("b", 1)])}
    rows = [(c, e, float(f), float(x)) for (c, e), s in psd.items() for f, x in zip(freq, s)]
    curves = series.psd_curves(spark.createDataFrame(rows, "channel string, epoch int, freq double, psd double").repartition(3), "psd", ["channel", "epoch"])
    one = lambda c, e, x: pairs.select(F.col("id").alias("source_id"), F.lit(c).alias("channel"), F.lit(e).alias("epoch"), F.col(x).alias("series"))
    long = one("a", 1, "a").unionByName(one("a", 2, "a")).unionByName(one("b", 1, "b")).unionByName(one("b", 9, "b"))
    got = {r["source_id"]: r["network_snr"] for r in series.network_snr(long, curves, FS, by=["channel", "epoch"]).collect()}
    for r in pairs.select("id", *[K.optimal_snr(freq, s)(x).alias(f"s{k}") for k, (s, x) in enumerate(zip(psd.values(), "aab"))]).collect():
        assert got[r["id"]] == pytest.approx(np.sqrt(r["s0"] ** 2 + r["s1"] ** 2 + r["s2"] ** 2))


def test_delay_whiten_and_matched_filter(pairs):
    d = K.fractional_delay()
    r = pairs.limit(1).select("a", d("a", F.lit(3.0)).alias("whole"), d(d("a", F.lit(1.25)), F.lit(-1.25)).alias("back"),
                              K.whiten_spectral([0.0, 2048.0], [4.0, 4.0])("a").alias("white"),
                              K.matched_filter_peak()("a", "a", F.lit(2.0)).alias("peak")).first()
    a = np.array(r["a"])
    assert np.allclose(r["whole"], np.roll(a, 3)) and np.allclose(r["white"], a / 2)
    assert np.allclose(np.fft.rfft(r["back"])[:-1], np.fft.rfft(a)[:-1])
    mid = a[FS : 3 * FS]
    assert r["peak"] == pytest.approx(np.sqrt((mid**2).sum()) / 2)
    with pytest.raises(Exception, match="quarter"):
        pairs.limit(1).select(d("a", F.lit(5000.0))).collect()


def test_psd_floor(spark):
    p = spark.createDataFrame([("a", 1.0, 4.0), ("a", 2.0, 0.0), ("a", 3.0, 16.0), ("a", 4.0, float("nan"))], "channel string, freq double, psd double")
    got = {r["freq"]: r for r in series.floor_psd(p).collect()}
    assert got[2.0]["floored"] == pytest.approx(10e-10) and got[3.0]["asd"] == 4.0
    with pytest.raises(Exception, match="no positive"):
        series.floor_psd(p.withColumn("psd", F.lit(0.0))).collect()
    empty = spark.createDataFrame([("b", 1.0, 0.0), ("b", 2.0, float("nan"))], p.schema)
    with pytest.raises(Exception, match="no positive"):  # a channel without bins is refused beside a good one too
        series.floor_psd(p.unionByName(empty)).collect()


@pytest.mark.parametrize("chunk", [7, 50, 1000])
def test_window_grid_does_not_depend_on_chunks(spark, chunk):
    x = np.arange(203, dtype=float)
    rows = [("a", 100.0, c, x[c : c + chunk].tolist(), 203) for c in range(0, 203, chunk)]
    df = spark.createDataFrame(rows, "channel string, span_start double, first_sample int, data array<double>, n_samples int")
    got = series.window_grid(df, 10.0, 4.0, 1.5).orderBy("i").collect()
    starts = np.arange(0, 203 - 40, 15)
    assert [r["i"] for r in got] == list(range(len(starts)))
    assert all(np.array_equal(r["window"], x[s : s + 40]) for r, s in zip(got, starts))
    assert [r["t_centre"] for r in got] == pytest.approx((100 + starts / 10 + 2).tolist())


def test_a_broken_window_keeps_its_place(spark):
    rows = [("a", 0.0, 0, [1.0] * 10, 30), ("a", 0.0, 20, [1.0] * 10, 30)]
    df = spark.createDataFrame(rows, "channel string, span_start double, first_sample int, data array<double>, n_samples int")
    got = series.window_grid(df, 1.0, 4.0, 4.0).orderBy("i").collect()
    assert [sum(r["window"]) for r in got] == [4.0, 4.0, 0.0, 0.0, 0.0, 4.0, 4.0]


def test_magnitude_crops(spark):
    m = np.random.default_rng(0).random((2563, 500)).round(3)
    df = spark.createDataFrame([(m.tolist(),)], "mag_a array<array<float>>")
    df = df.withColumn("mag_b", F.col("mag_a")).withColumn("t0_a", F.lit(113))
    r = series.paired_band_crop(df).select("hm", "lm").first()
    assert np.array(r["hm"]).shape == (2, 241, 113) and np.array(r["lm"]).shape == (2, 901, 113)
    col = int(round((113 - 14) / 128 * 500))
    f = 10 + 0.5 * np.arange(2563)
    want = np.zeros((241, 113))
    want[:, : 500 - col] = m[(f >= 20) & (f <= 140)][:, col : col + 113]
    want = (want - want.min()) / (want.max() - want.min() + 1e-9)
    assert np.allclose(r["hm"][0], want, atol=1e-6)
    edge = df.select(A.band_crop("mag_a", F.lit(-3), (20.0, 20.5), width=5).alias("c")).first()["c"]
    assert np.array(edge).shape == (2, 5) and (np.array(edge)[:, :3] == 0).all()


def test_crops_of_odd_magnitudes(spark):
    nan = float("nan")
    rows = [(0, [[1.0, nan], [3.0, 5.0]], 0), (1, [[1.0, None], [3.0, 5.0]], 1), (2, [[1.0, 2.0], None], 0), (3, None, 0), (4, [], 0),
            (5, [[], []], None), (6, [[1.0, 2.0], []], None), (7, [[2.0, 4.0, 6.0, 8.0], [4.0]], -1), (8, [[2.0], [4.0]], 9)]
    df = spark.createDataFrame(rows, "id int, m array<array<double>>, c int").coalesce(1)
    got = {r["id"]: r["x"] for r in df.select("id", A.band_crop("m", F.col("c"), (10.0, 10.5), width=3).alias("x")).collect()}
    assert got[0][1][2] != got[0][1][2] and got[0][0][0] != got[0][0][0]  # NaN is the largest value, so the range is NaN
    assert got[1] == [[None, 0.0, 0.0], [pytest.approx(1.0), 0.0, 0.0]]
    assert got[2] == [[None] * 3, None] and got[3] is None and got[4] == []
    assert got[5] == [[0.0] * 3] * 2 and got[6] == [None, [None] * 3]
    assert got[7] == [[0.0, pytest.approx(0.5), pytest.approx(1.0)], [0.0, pytest.approx(1.0), 0.0]] and got[8] == [[0.0] * 3] * 2


def test_paired_crops_are_made_by_one_kernel_in_bounded_pieces(spark):
    from farspark.functions import kernels

    rng = np.random.default_rng(3)
    rows = [(i, rng.random((320, 8)).tolist(), rng.random((320, 8)).tolist(), 14 + i % 40) for i in range(60)]  # 52 MB of crops
    df = spark.createDataFrame(rows, "id int, mag_a array<array<double>>, mag_b array<array<double>>, t0_a int").coalesce(1)
    out = series.paired_band_crop(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in out.orderBy("id").collect()[::7]:
        col = int(np.rint((r["t0_a"] - 14) / 128 * 8))
        for name, lo, hi in (("hm", 20, 261), ("lm", 80, 320)):
            for k, m in enumerate((rows[r["id"]][1], rows[r["id"]][2])):
                want = np.zeros((hi - lo, 113))
                part = np.array(m)[lo:hi, col:]
                want[:, :part.shape[1]] = part
                assert np.allclose(r[name][k], (want - want.min()) / (want.max() - want.min() + 1e-9))
    assert kernels.CROP_BYTES < 60 * 962 * 113 * 8


def test_small_array_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 6.0],)], "x array<double>")
    r = df.select(A.array_mean("x").alias("m"), A.array_std("x").alias("s"), A.fraction_above("x", 1.5).alias("f"),
                  A.min_max_norm("x").alias("n"), A.centre_crop("x", 1.0, 2.0).alias("c"), A.centre_crop("x", 1.0, 9.0).alias("w"),
                  A.energy_fraction_in_crop("x", 1.0, 2.0).alias("e"), A.reconstruction_error("x", A.rescale("x", F.lit(2.0))).alias("mse")).first()
    x = np.array([1, 2, 3, 6.0])
    assert (r["m"], r["f"], r["c"], r["w"]) == (3.0, 0.75, [2.0, 3.0], x.tolist())
    assert r["s"] == pytest.approx(x.std()) and r["e"] == pytest.approx(13 / 50) and r["mse"] == pytest.approx((x**2).mean())
    assert np.allclose(r["n"], (x - 1) / 5)
    with pytest.raises(Exception, match="past the segment"):
        df.select(A.cut_window("x", F.lit(3.0), F.lit(2.0), 1.0)).collect()
    half = spark.range(1).select(X.column_for(F.lit(14 + 32), F.lit(10)).alias("c")).first()["c"]
    assert half == round(2.5)


def test_rescale_keeps_relative_amplitudes(spark):
    df = spark.createDataFrame([([1.0, 2.0], 4.0, 8.0)], "series array<double>, current_snr double, target_snr double")
    assert series.rescale_to_target(df).first()["series"] == [2.0, 4.0]
    with pytest.raises(Exception, match="positive"):
        series.rescale_to_target(df.withColumn("current_snr", F.lit(0.0))).collect()
