import numpy as np
import pytest
from pyspark.sql import functions as F

from farspark.operators import far
from farspark.operators.calibration import spearman
from farspark.operators.ordered import Cells, as_of, ordinal, percentiles, running, select_ranks


def values(seed=0, n=4000):
    """Heavy ties, a far outlier, a NaN and a NULL, in two channels of very unequal size."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 2)
    x[: n // 3] = 0.5
    x[-1] = 1e6
    channel = np.where(rng.random(n) < 0.9, "general", "strict")
    return [(i, str(c), float(v)) for i, (c, v) in enumerate(zip(channel, x))]


@pytest.fixture(scope="module")
def rows(spark):
    data = values() + [(-1, "general", float("nan")), (-2, "strict", None)]
    return spark.createDataFrame(data, "id bigint, channel string, stat double")


def clean(channel=None):
    return np.array([v for _, c, v in values() if channel in (None, c)])


@pytest.mark.parametrize("cell_rows", [1_000_000, 100, 7])
def test_select_ranks_is_exact(spark, rows, cell_rows):
    cells = Cells.fit(rows, "stat", ["channel"], cell_rows)
    asked = [(c, r) for c in ("general", "strict") for r in (1, 2, 50, 300)]
    wanted = spark.createDataFrame(asked, "channel string, rank bigint")
    got = {(r["channel"], r["rank"]): r["stat"] for r in select_ranks(rows, "stat", wanted, cells, ["channel"]).collect()}
    for c, r in asked:
        assert got[c, r] == np.sort(clean(c))[::-1][r - 1]


@pytest.mark.parametrize("cell_rows", [1_000_000, 50])
def test_percentiles_match_numpy(rows, cell_rows):
    cells = Cells.fit(rows, "stat", [], cell_rows)
    got = percentiles(rows, "stat", {"a": 0.013, "b": 0.5, "c": 0.999, "d": 1.0}, cells=cells).first()
    assert np.allclose([got[k] for k in "abcd"], np.percentile(clean(), [1.3, 50, 99.9, 100]))


@pytest.mark.parametrize("cell_rows", [1_000_000, 60])
@pytest.mark.parametrize("parts", [1, 7, 64])
def test_far_of_matches_search(spark, rows, cell_rows, parts):
    probes = spark.createDataFrame([(0, "general", x) for x in (-9.0, 0.5, 0.505, 3.0, 2e6)], "id bigint, channel string, stat double")
    cells = Cells.fit(rows, "stat", ["channel"], cell_rows)
    out = far.far_of(probes, rows.repartition(parts), "stat", 10.0, 4, ["channel"], cells).collect()
    bg = clean("general")
    for r in out:
        assert r["far_per_yr"] == pytest.approx(4 * max((bg >= r["stat"]).sum(), 1) / 10)


@pytest.mark.parametrize("cell_rows", [1_000_000, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running_scans(rows, cell_rows, descending):
    clean_rows = rows.filter("stat is not null and not isnan(stat)")
    cells = Cells.fit(clean_rows, "stat", [], cell_rows)
    scans = {"s": ("sum", "one", True), "before": ("max", "id", False), "low": ("min", "id", True)}
    out = running(clean_rows.withColumn("one", F.lit(1)), ["stat", "id"], scans, cells, descending=descending)
    got = out.orderBy(*[F.col(c).desc() if descending else F.col(c) for c in ("stat", "id")]).collect()
    ids = [r["id"] for r in got]
    assert [r["s"] for r in got] == list(range(1, len(got) + 1))
    assert got[0]["before"] is None and [r["before"] for r in got[1:]] == list(np.maximum.accumulate(ids)[:-1])
    assert [r["low"] for r in got] == list(np.minimum.accumulate(ids))


def test_spearman_is_exact_in_cells(rows):
    d = rows.filter("id >= 0").withColumn("y", F.pmod(F.col("id") * 37, F.lit(101)).cast("double"))
    x, i = clean(), np.arange(len(clean()))
    y = (i * 37 % 101).astype(float)
    rank = lambda a: np.argsort(np.lexsort((i, a)))
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    assert 0.5 in Cells.fit(d, "stat", cell_rows=90).hot
    for cell_rows in (None, 90):
        assert spearman(d, "stat", "y", "id", cell_rows).first()[0] == pytest.approx(want, abs=1e-12)


def test_ordinal_and_as_of(spark):
    left = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 5, 10, 99)], "x double")
    right = spark.createDataFrame([(1.0, "a"), (5.0, "b"), (20.0, "c")], "k double, name string")
    got = sorted((r["x"], r["name"] or "") for r in as_of(left, right, "x", "k", ["name"]).collect())
    assert got == [(0.0, ""), (1.0, "a"), (5.0, "b"), (5.0, "b"), (10.0, "b"), (99.0, "c")]
    numbered = ordinal(left, ["x"], Cells.fit(left, "x", cell_rows=2))
    assert sorted(r["ordinal"] for r in numbered.collect()) == list(range(6))


def test_cells_keep_order_on_hard_values(spark):
    x = sorted([-1e308, -5.0, -0.0, 1e-300, 1.0, 1.0, 2.0, 1e300, 1e308, *np.linspace(0, 1, 50).tolist()])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    cells = Cells.fit(df, "v", cell_rows=3)
    got = [r[0] for r in cells.attach(df, "v", "c").orderBy("v").select("c").collect()]
    assert got == sorted(got)
