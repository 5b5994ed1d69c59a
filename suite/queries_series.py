"""Array kernels over the embeddings, sources and sinks, run records and budgets."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from farspark.functions import arrays as A, kernels as K
from farspark.functions import expressions as X
from farspark.operators import calibration as cal
from farspark.operators import folds, records, segments as S, series
from farspark.operators.ordered import union_all
from farspark.operators.settle import settle
from farspark.plans import reports
from farspark.sources import io
from suite import views as v
from suite.registry import query
from suite.views import V1, V2, V5

FS = 64.0


def per_pair(spark, d, **columns):
    return v.series_pairs(spark, d).select("vec_id", *[c.alias(k) for k, c in columns.items()])


# --- array expressions ----------------------------------------------------------------------


@query("reconstruction_error", f"""WITH {V5} SELECT vec_id,
  list_avg(list_transform(list_zip(xa, xb), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS error FROM sp""", {"error": 6})
def reconstruction_error(spark, d):
    return per_pair(spark, d, error=A.reconstruction_error("xa", "xb"))


@query("min_max_norm", f"""WITH {V5}, u AS (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(xa) AS x, list_min(xa) AS lo, list_max(xa) AS hi FROM sp)
SELECT vec_id, pos, (x - lo) / (hi - lo + 1e-12) AS x FROM u""", {"x": 6})
def min_max_norm(spark, d):
    s = per_pair(spark, d, x=A.min_max_norm("xa"))
    return s.select("vec_id", F.posexplode("x").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint") + 1)


@query("noise_referenced_norm", f"""WITH {V5}, u AS (SELECT vec_id, label, unnest(range(1, 65)) AS pos, unnest(xa) AS x FROM sp),
  m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM u WHERE label % 2 = 0)
SELECT vec_id, pos, (x - mu) / (sd + 1e-12) AS x FROM u CROSS JOIN m""", {"x": 6})
def noise_referenced_norm(spark, d):
    pairs = v.series_pairs(spark, d)
    noise = pairs.filter("label % 2 = 0").select(F.explode("xa").alias("x"))
    m = noise.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")).first()
    s = pairs.select("vec_id", A.noise_referenced_norm("xa", m["mu"], m["sd"]).alias("x"))
    return s.select("vec_id", F.posexplode("x").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint") + 1)


@query("centre_crop", f"""WITH {V5} SELECT vec_id, len(c) AS n, c[1] AS first, list_sum(c) AS total FROM (SELECT vec_id, xa[(17):(48)] AS c FROM sp)""",
       {"first": 6, "total": 6})
def centre_crop(spark, d):
    s = per_pair(spark, d, c=A.centre_crop("xa", FS, 0.5))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    return s.select("vec_id", F.size("c").cast("bigint").alias("n"), F.element_at("c", 1).alias("first"), total.alias("total"))


@query("energy_fraction_in_crop", f"""WITH {V5} SELECT vec_id, list_sum(list_transform(xa[17:48], lambda x: x * x)) /
  list_sum(list_transform(xa, lambda x: x * x)) AS fraction FROM sp""", {"fraction": 6})
def energy_fraction_in_crop(spark, d):
    return per_pair(spark, d, fraction=A.energy_fraction_in_crop("xa", FS, 0.5))


@query("cut_window", f"""WITH {V5} SELECT vec_id, list_sum(xa[(vec_id % 32) + 1:(vec_id % 32) + 16]) AS total FROM sp""", {"total": 6})
def cut_window(spark, d):
    s = per_pair(spark, d, w=A.cut_window("xa", (F.col("vec_id") % 32) / FS, F.lit(0.25), FS))
    return s.select("vec_id", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("tile_properties", f"""WITH {V5}, u AS (SELECT vec_id, unnest(xa) AS x FROM sp)
SELECT vec_id, avg(x) AS tile_mean, stddev_pop(x) AS tile_std, avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0 END) AS tile_fraction FROM u GROUP BY 1""",
       {"tile_mean": 6, "tile_std": 6, "tile_fraction": 6})
def tile_properties(spark, d):
    return cal.tile_properties(v.series_pairs(spark, d), "xa").select("vec_id", "tile_mean", "tile_std", "tile_fraction")



@query("coherence_from_coefficients", f"""WITH {V5}, u AS (SELECT vec_id, unnest(range(32)) AS f, unnest(xa[1:32]) AS ar, unnest(xa[33:64]) AS ai,
    unnest(xb[1:32]) AS br, unnest(xb[33:64]) AS bi FROM sp),
  e AS (SELECT vec_id, sum(ar * ar + ai * ai + br * br + bi * bi) * 2 / 256 AS energy FROM u GROUP BY 1),
  s AS (SELECT vec_id, t, sum((ar * br + ai * bi) * cos(2 * pi() * (f + 4) * t / 256) - (ai * br - ar * bi) * sin(2 * pi() * (f + 4) * t / 256)) AS c
    FROM u CROSS JOIN (SELECT unnest(range(-8, 9)) AS t) GROUP BY 1, 2)
SELECT vec_id, max(abs(4 * c / 256)) / any_value(energy) AS coherence FROM s JOIN e USING (vec_id) GROUP BY 1""", {"coherence": 6})
def coherence_from_coefficients(spark, d):
    h = lambda c, first: F.slice(c, first, 32)
    return per_pair(spark, d, coherence=A.coherence_from_coefficients_sql(
        h("xa", 1), h("xa", 33), h("xb", 1), h("xb", 33), v.FIRST_BIN, v.WINDOW_N, v.LAG_SAMPLES))


@query("coherence_from_coefficients_bulk", f"""WITH {V5}, u AS (SELECT vec_id, unnest(range(32)) AS f, unnest(xa[1:32]) AS ar, unnest(xa[33:64]) AS ai,
    unnest(xb[1:32]) AS br, unnest(xb[33:64]) AS bi FROM sp),
  e AS (SELECT vec_id, sum(ar * ar + ai * ai + br * br + bi * bi) * 2 / 256 AS energy FROM u GROUP BY 1),
  s AS (SELECT vec_id, t, sum((ar * br + ai * bi) * cos(2 * pi() * (f + 4) * t / 256) - (ai * br - ar * bi) * sin(2 * pi() * (f + 4) * t / 256)) AS c
    FROM u CROSS JOIN (SELECT unnest(range(-8, 9)) AS t) GROUP BY 1, 2)
SELECT vec_id, max(abs(4 * c / 256)) / any_value(energy) AS coherence FROM s JOIN e USING (vec_id) GROUP BY 1""", {"coherence": 6})
def coherence_from_coefficients_bulk(spark, d):
    udf = K.coherence_from_coefficients(v.FIRST_BIN, v.WINDOW_N, v.LAG_SAMPLES)
    h = lambda c, first: F.slice(c, first, 32)
    return per_pair(spark, d, coherence=udf(h("xa", 1), h("xa", 33), h("xb", 1), h("xb", 33)))


# --- Arrow kernels --------------------------------------------------------------------------


def dft(source: str, n: int, first: int, last: int, taper: bool, name: str, cut: str = "") -> str:
    """CTE `name`: the transform of a series column written out, frequency by frequency."""
    shape = f"* (0.5 - 0.5 * cos(2 * pi() * t / {n - 1}))" if taper else ""
    return f"""{name} AS (SELECT vec_id, f, sum(x {shape} * cos(2 * pi() * f * t / {n})) AS re, -sum(x {shape} * sin(2 * pi() * f * t / {n})) AS im
  FROM (SELECT vec_id, unnest(range({n})) AS t, unnest({source}{cut}) AS x FROM sp) CROSS JOIN (SELECT unnest(range({first}, {last + 1})) AS f) GROUP BY 1, 2)"""


@query("bandlimit", f"""WITH {V5}, {dft('xa', 64, 4, 16, True, 'c')} SELECT vec_id, sqrt(2 * sum(re * re + im * im) / 64) AS norm FROM c GROUP BY 1""", {"norm": 6})
def bandlimit(spark, d):
    s = per_pair(spark, d, y=K.bandlimit(FS, (4.0, 16.0))("xa"))
    return s.select("vec_id", F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


# The transform written out: sums of products with cosines and sines, frequency by frequency.
DFT = """u AS (SELECT vec_id, unnest(range(32)) AS t, unnest({a}[17:48]) AS x, list_avg({a}[17:48]) AS m FROM sp),
  w AS (SELECT vec_id, t, (x - m * {centre}) * (0.5 - 0.5 * cos(2 * pi() * t / 31)) AS x FROM u),
  c AS (SELECT vec_id, f, sum(x * cos(2 * pi() * f * t / 32)) AS re, -sum(x * sin(2 * pi() * f * t / 32)) AS im
    FROM w CROSS JOIN (SELECT unnest(range(17)) AS f) GROUP BY 1, 2)"""


@query("centroid", f"""WITH {V5}, {DFT.format(a='xa', centre=1)}
SELECT vec_id, sum((re * re + im * im) * f * 2) / (sum(re * re + im * im) + 1e-30) AS centroid FROM c WHERE f * 2 BETWEEN 4 AND 24 GROUP BY 1""",
       {"centroid": 6})
def centroid(spark, d):
    return per_pair(spark, d, centroid=K.centroid(FS, (4.0, 24.0), 0.5)("xa"))


@query("band_coefficients", f"""WITH {V5}, {DFT.format(a='xa', centre=0)}
SELECT vec_id, f AS bin, re, im FROM c WHERE f * 2 BETWEEN 4 AND 16""", {"re": 6, "im": 6})
def band_coefficients(spark, d):
    s = per_pair(spark, d, c=K.band_coefficients(FS, (4.0, 16.0), 0.5)("xa"))
    z = s.select("vec_id", "c.first_bin", F.posexplode(F.arrays_zip("c.re", "c.im")).alias("p", "z"))
    return z.select("vec_id", (F.col("p") + F.col("first_bin")).cast("bigint").alias("bin"), "z.re", "z.im")


@query("coherence", f"""WITH {V5}, {dft('xa', 32, 2, 8, True, 'ca', '[17:48]')}, {dft('xb', 32, 2, 8, True, 'cb', '[17:48]')},
  z AS (SELECT a.vec_id, a.f, a.re * b.re + a.im * b.im AS zr, a.im * b.re - a.re * b.im AS zi,
    a.re * a.re + a.im * a.im + b.re * b.re + b.im * b.im AS e FROM ca a JOIN cb b ON a.vec_id = b.vec_id AND a.f = b.f),
  s AS (SELECT vec_id, l, sum(zr * cos(2 * pi() * f * l / 32) - zi * sin(2 * pi() * f * l / 32)) AS c, sum(e) AS e
    FROM z CROSS JOIN (SELECT unnest(range(-4, 5)) AS l) GROUP BY 1, 2)
SELECT vec_id, 2 * max(abs(c)) / any_value(e) AS coherence FROM s GROUP BY 1""", {"coherence": 6})
def coherence(spark, d):
    return per_pair(spark, d, coherence=K.coherence(FS, (4.0, 16.0), 0.5, 4)("xa", "xb"))


def psd_table(spark, d):
    """A reference curve per channel from the part prices: bin = size, power = mean retail price."""
    part = v.table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("freq")).agg(F.avg("p_retailprice").alias("psd"))
    return part.select(F.lit("a").alias("channel"), "freq", F.when(F.col("freq") % 7 == 0, 0.0).otherwise(F.col("psd")).alias("psd"))


PSD = """ps AS (SELECT CAST(p_size AS DOUBLE) AS freq, avg(p_retailprice) AS raw FROM part GROUP BY 1),
  pp AS (SELECT freq, CASE WHEN CAST(freq AS BIGINT) % 7 = 0 THEN 0 ELSE raw END AS psd FROM ps)"""


@query("floor_psd", f"""WITH {PSD}, m AS (SELECT quantile_cont(psd, 0.5) * 1e-10 AS lo FROM pp WHERE psd > 0)
SELECT 'a' AS channel, freq, psd, greatest(psd, lo) AS floored, sqrt(greatest(psd, lo)) AS asd FROM pp CROSS JOIN m""",
       {"psd": 6, "floored": 9, "asd": 6})
def floor_psd(spark, d):
    return series.floor_psd(psd_table(spark, d))


CURVE = f"""{PSD}, lowest AS (SELECT quantile_cont(psd, 0.5) * 1e-3 AS lo FROM pp WHERE psd > 0),
  nz AS (SELECT CAST(freq AS BIGINT) AS f, greatest(psd, lo) AS s FROM pp CROSS JOIN lowest)"""


def reference_curve(spark, d, column="floored"):
    row = curves(spark, d, column).first()  # the one curve a closure carries
    return list(row["freq"]), list(row["psd"])


def curves(spark, d, column="floored"):
    return series.psd_curves(series.floor_psd(psd_table(spark, d), 1e-3), column)


@query("whiten_spectral", f"""WITH {V5}, {CURVE}, {dft('xa', 64, 0, 32, False, 'c')}
SELECT vec_id, sqrt(sum(CASE WHEN c.f IN (0, 32) THEN 1 ELSE 2 END * (re * re + im * im) / s) / 64) AS norm
FROM c JOIN nz ON nz.f = greatest(c.f, 1) GROUP BY 1""", {"norm": 6})
def whiten_spectral(spark, d):
    white = K.whiten_spectral(*reference_curve(spark, d), fs=FS)
    s = per_pair(spark, d, y=white("xa"))
    return s.select("vec_id", F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


def snr_sql(series: str, name: str) -> str:
    return f"""{dft(series, 64, 2, 32, False, 'c_' + name)}, {name} AS (SELECT vec_id, 4 * sum((re * re + im * im) / 4096.0 / s) AS snr2
  FROM c_{name} c JOIN nz ON nz.f = c.f GROUP BY 1)"""


@query("optimal_snr", f"WITH {V5}, {CURVE}, {snr_sql('xa', 'p')} SELECT vec_id, sqrt(snr2) AS snr FROM p", {"snr": 6})
def optimal_snr(spark, d):
    return per_pair(spark, d, snr=K.optimal_snr(*reference_curve(spark, d), fs=FS, f_low=2.0)("xa"))


@query("network_snr", f"""WITH {V5}, {CURVE}, {snr_sql('xa', 'p')}, {snr_sql('xb', 'q')}
SELECT p.vec_id AS source_id, sqrt(p.snr2 + q.snr2) AS network_snr FROM p JOIN q ON q.vec_id = p.vec_id""", {"network_snr": 6})
def network_snr(spark, d):
    pairs = v.series_pairs(spark, d)
    long = union_all([
        pairs.select(F.col("vec_id").alias("source_id"), F.lit(c).alias("channel"), F.col(x).alias("series")) for c, x in (("a", "xa"), ("b", "xb"))
    ])
    one = curves(spark, d).drop("channel")
    return series.network_snr(long, union_all([one.withColumn("channel", F.lit(c)) for c in "ab"]), FS, f_low=2.0)


@query("rescale_to_target", f"""WITH {V5}, u AS (SELECT vec_id, list_sum(list_transform(xa, lambda x: x * x)) AS ea, list_sum(xa) AS sa, list_sum(xb) AS sb FROM sp)
SELECT vec_id, sa * 8 / sqrt(ea) AS total_a, sb * 8 / sqrt(ea) AS total_b FROM u""", {"total_a": 6, "total_b": 6})
def rescale_to_target(spark, d):
    s = v.series_pairs(spark, d).withColumn("current_snr", F.sqrt(F.aggregate("xa", F.lit(0.0), lambda a, x: a + x * x)))
    s = s.withColumn("target_snr", F.lit(8.0))
    out = series.rescale_to_target(series.rescale_to_target(s, "xa"), "xb")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", total("xa").alias("total_a"), total("xb").alias("total_b"))


@query("matched_filter_peak", f"""WITH {V5}, u AS (SELECT vec_id, unnest(range(32)) AS t, unnest(xa[17:48]) AS x, xb[17:48] AS y FROM sp),
  s AS (SELECT vec_id, l, sum(x * y[((t - l + 32) % 32) + 1]) AS c FROM u CROSS JOIN (SELECT unnest(range(32)) AS l) GROUP BY 1, 2),
  n AS (SELECT vec_id, sqrt(list_sum(list_transform(xb[17:48], lambda q: q * q))) AS norm FROM sp)
SELECT vec_id, max(abs(c)) / (any_value(norm) * 0.5) AS peak FROM s JOIN n USING (vec_id) GROUP BY 1""", {"peak": 6})
def matched_filter_peak(spark, d):
    return per_pair(spark, d, peak=K.matched_filter_peak(FS, 0.5)("xa", "xb", F.lit(0.5)))


@query("fractional_delay", f"""WITH {V5}, u AS (SELECT vec_id, unnest(range(64)) AS t, xa FROM sp)
SELECT vec_id, t, xa[((t - vec_id % 8 + 64) % 64) + 1] AS x FROM u""", {"x": 6})
def fractional_delay(spark, d):
    s = per_pair(spark, d, y=K.fractional_delay()("xa", (F.col("vec_id") % 8).cast("double")))
    return s.select("vec_id", F.posexplode("y").alias("t", "x")).withColumn("t", F.col("t").cast("bigint"))


@query("window_grid", """WITH ids AS (SELECT count(*) * 64 AS n FROM embeddings),
  s AS (SELECT vec_id * 64 + unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
  w AS (SELECT unnest(range(CAST(ceil((n - 100) / 48.0) AS BIGINT))) AS i FROM ids)
SELECT i, CAST(i AS DOUBLE) * 48 / 64 + 50 / 64.0 AS t_centre, sum(x) AS total FROM w JOIN s ON pos >= i * 48 AND pos < i * 48 + 100 GROUP BY 1, 2""",
       {"t_centre": 6, "total": 6})
def window_grid(spark, d):
    e = v.table(spark, d, "embeddings")
    size = e.agg((F.count(F.lit(1)) * 64).alias("n_samples"))  # one row
    chunks = e.select(
        F.lit("a").alias("channel"), F.lit(0.0).alias("span_start"), (F.col("vec_id") * 64).alias("first_sample"), F.col("embedding").alias("data")
    ).crossJoin(F.broadcast(size))
    out = series.window_grid(chunks, FS, 100 / FS, 48 / FS)
    return out.select("i", "t_centre", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total"))


# --- crops of magnitudes --------------------------------------------------------------------


def magnitudes(spark, d):
    """Each embedding as an 8 x 8 magnitude, beside its neighbour's."""
    square = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(c, r * 8 + 1, 8))
    return v.series_pairs(spark, d).select("vec_id", square(F.col("xa")).alias("mag_a"), square(F.col("xb")).alias("mag_b"))


@query("column_for", """SELECT l_linenumber, l_quantity, CAST(round_even((l_quantity - 14) / 128.0 * (490 + l_linenumber * 4), 0) AS INTEGER) AS col, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3""")
def column_for(spark, d):
    li = v.table(spark, d, "lineitem")
    c = X.column_for("l_quantity", 490 + F.col("l_linenumber") * 4)
    return li.groupBy("l_linenumber", "l_quantity", c.alias("col")).agg(F.count(F.lit(1)).alias("n"))


@query("crop_bounds", """WITH q AS (SELECT DISTINCT l_quantity AS n, l_linenumber AS secs FROM lineitem)
SELECT n, secs, CASE WHEN secs >= 4 THEN 0 ELSE CAST(floor(0.5::DOUBLE * (1 - secs / 4.0::DOUBLE) * n) AS INTEGER) END AS first,
  CASE WHEN secs >= 4 THEN CAST(n AS INTEGER) ELSE least(greatest(CAST(floor(0.5::DOUBLE * (1 + secs / 4.0::DOUBLE) * n) AS INTEGER),
    CAST(floor(0.5::DOUBLE * (1 - secs / 4.0::DOUBLE) * n) AS INTEGER) + 1), CAST(n AS INTEGER)) END AS stop FROM q""")
def crop_bounds(spark, d):
    q = v.table(spark, d, "lineitem").select(F.col("l_quantity").alias("n"), F.col("l_linenumber").alias("secs")).distinct()
    first, stop = X.crop_bounds("n", F.lit(4.0), F.col("secs").cast("double"))
    return q.select("n", "secs", first.alias("first"), stop.alias("stop"))


@query("band_crop", f"""WITH {V5}, u AS (SELECT vec_id, r, c, CASE WHEN c + vec_id % 7 < 8 THEN xa[r * 8 + c + vec_id % 7 + 1] ELSE 0 END AS x FROM sp
    CROSS JOIN (SELECT unnest(range(2, 6)) AS r) CROSS JOIN (SELECT unnest(range(5)) AS c)),
  m AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM u GROUP BY 1)
SELECT vec_id, r - 2 AS r, c, (x - lo) / (hi - lo + 1e-9) AS x FROM u JOIN m USING (vec_id)""", {"x": 6})
def band_crop(spark, d):
    m = magnitudes(spark, d).select("vec_id", A.band_crop("mag_a", F.col("vec_id") % 7, (11.0, 12.5), 10.0, 0.5, 5).alias("crop"))
    rows = m.select("vec_id", F.posexplode("crop").alias("r", "row"))
    cells = rows.select("vec_id", "r", F.posexplode("row").alias("c", "x"))
    return cells.select("vec_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "x")


@query("paired_band_crop")
def paired_band_crop(spark, d):
    tall = lambda c: F.flatten(F.array_repeat(F.col(c), 40))
    m = magnitudes(spark, d).select("vec_id", tall("mag_a").alias("mag_a"), tall("mag_b").alias("mag_b"), (14 + F.col("vec_id") % 40).alias("t0_a"))
    out = series.paired_band_crop(m)
    shape = lambda c: F.size(F.element_at(c, 1))
    total = F.aggregate(F.flatten(F.element_at("hm", 2)), F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", shape("hm").alias("hm_rows"), shape("lm").alias("lm_rows"), total.alias("hm_total"))


@query("derived_masses", """SELECT l_linenumber, count(*) AS n, sum(l_quantity + 40) AS total, max(greatest(l_quantity, 40) / least(l_quantity, 40)) AS top_ratio
FROM lineitem GROUP BY 1""", {"top_ratio": 6})
def derived_masses(spark, d):
    li = v.table(spark, d, "lineitem").withColumn("m2", F.lit(40.0))
    return li.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.total_mass("l_quantity", "m2")).alias("total"), F.max(X.mass_ratio("l_quantity", "m2")).alias("top_ratio")
    )


@query("admission_filter", """WITH m AS (SELECT l_quantity * 3 AS m1, l_linenumber * 12.0 AS m2 FROM lineitem)
SELECT greatest(m1, m2) AS m1, least(m1, m2) AS m2, count(*) AS n FROM m
WHERE m1 BETWEEN 10 AND 120 AND m2 BETWEEN 10 AND 120 AND m1 + m2 BETWEEN 20 AND 240 AND greatest(m1, m2) / least(m1, m2) <= 6 GROUP BY 1, 2""")
def admission_filter(spark, d):
    m = v.table(spark, d, "lineitem").select((F.col("l_quantity") * 3).alias("m1"), (F.col("l_linenumber") * 12.0).alias("m2"))
    kept = m.filter(X.admissible("m1", "m2"))
    return kept.groupBy(F.greatest("m1", "m2").alias("m1"), F.least("m1", "m2").alias("m2")).agg(F.count(F.lit(1)).alias("n"))


# --- sources and sinks ----------------------------------------------------------------------


def segment_json(spark, d, shape):
    """V1 as one JSON document of the given shape, written by Spark."""
    segs = v.segments(spark, d)
    row = F.array(F.col("start_s").cast("string"), F.col("end_s").cast("string"), (F.col("end_s") - F.col("start_s")).cast("string"),
                  F.when(F.col("blk") % 5 == 0, F.concat(F.lit("ev"), F.col("blk"))))
    if shape == "keyed":
        lists = segs.groupBy("channel").agg(F.sort_array(F.collect_list(F.slice(row, 1, 2))).alias("r"))
        doc = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("channel", "r")))).alias("value"))
    else:
        one = segs.filter("channel = 'click'").agg(F.sort_array(F.collect_list(row)).alias("segments"))
        doc = one.select(F.to_json(F.struct("segments") if shape == "listed" else F.col("segments")).alias("value"))
    path = os.path.join(v.scratch(spark), "segments.json")
    doc.coalesce(1).write.text(path)
    return path


@query("read_segments", f"""WITH {V1} SELECT channel, start_s, end_s FROM segs WHERE channel = 'view'""", {"start_s": 6, "end_s": 6})
def read_segments(spark, d):
    return io.read_segments(spark, segment_json(spark, d, "keyed"), "view").drop("event")


@query("named_events", f"""WITH {V1} SELECT 'ev' || blk AS event, start_s FROM segs WHERE channel = 'click' AND blk % 5 = 0""", {"start_s": 6})
def named_events(spark, d):
    return io.named_events(io.read_segments(spark, segment_json(spark, d, "listed"), "click"))


def grid_files(spark, d):
    grid = v.feature_grid(spark, d).select(
        "span_start", (F.col("span_start") + 86400.0).alias("span_end"), "i", (F.col("span_start") + F.col("i") * v.STRIDE_S).alias("ts"),
        "score_a", "score_b", "centroid_a", "centroid_b", F.col("arm_a").cast("double").alias("arm_a"), F.col("arm_b").cast("double").alias("arm_b"),
        *[F.transform(c, lambda x: x.cast("float")).alias(c) for c in ("re_a", "im_a", "re_b", "im_b")], F.lit("ck").alias("checkpoint"),
    )
    return settle(grid), os.path.join(v.scratch(spark), "grid")


@query("read_grid", f"WITH {V2} SELECT span_start, count(*) AS n, sum(score_a) AS total_a, sum(score_b) AS total_b FROM grid GROUP BY 1",
       {"total_a": 4, "total_b": 4})
def read_grid(spark, d):
    grid, path = grid_files(spark, d)
    io.write_grid(grid, path)
    back = io.read_grid(spark, path, ("span_start", "i", "score_a", "score_b", "re_a"))
    return back.groupBy("span_start").agg(F.count(F.lit(1)).alias("n"), F.sum("score_a").alias("total_a"), F.sum("score_b").alias("total_b"))


@query("write_grid", f"WITH {V2} SELECT count(*) AS n_points, count(DISTINCT span_start) AS n_spans FROM grid")
def write_grid(spark, d):
    grid, path = grid_files(spark, d)
    first = grid.agg(F.min("span_start")).first()[0]
    io.write_grid(grid.filter(F.col("span_start") < first + 5 * 86400.0), path)
    io.write_grid(grid, path)  # resumes: the first five spans are not written again
    return io.read_grid(spark, path).agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("span_start").alias("n_spans"))


@query("write_triggers", f"WITH {v.V2_SLID} SELECT count(*) AS n, max(net_sigma) AS loudest, 23 AS n_lags, 'ck' AS checkpoint FROM triggers", {"loudest": 6})
def write_triggers(spark, d):
    grid = v.score_grid(spark, d)
    curve = reports.far_curve(grid, v.STRIDE_S, 2000, v.STEP_S, v.CLUSTER_S, v.NET_FLOOR)
    meta = spark.range(1).select(
        F.lit("c").alias("campaign_id"), F.lit(curve.plan.background_livetime_s).alias("background_livetime_s"),
        F.lit(curve.plan.n_lags).alias("n_lags"), F.lit(curve.floor).alias("keep_above"), F.lit("ck").alias("checkpoint"),
        F.lit("m").alias("model_id"), F.lit(False).alias("gate_applied"),
    )
    path = os.path.join(v.scratch(spark), "run")
    io.write_triggers(curve.triggers, meta, path)
    triggers, back = io.read_triggers(spark, path)
    return triggers.agg(F.count(F.lit(1)).alias("n"), F.max("net_sigma").alias("loudest")).crossJoin(
        F.broadcast(back.select("n_lags", "checkpoint"))  # one row
    )


@query("read_bank", """SELECT vec_id AS tile_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(label AS DOUBLE) END AS y FROM embeddings""")
def read_bank(spark, d):
    e = v.table(spark, d, "embeddings")
    bank = e.select(
        F.col("vec_id").alias("tile_id"), F.col("embedding").alias("data"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.when(F.col("vec_id") % 3 != 0, F.col("label").cast("float")).alias("y"), F.lit("e").alias("source"),
    )
    path = os.path.join(v.scratch(spark), "bank")
    bank.write.parquet(path)
    return io.read_bank(spark, path).select("tile_id", X.nan_to_null(F.col("y").cast("double")).alias("y"))


@query("read_psd", f"WITH {PSD} SELECT freq, psd FROM pp", {"psd": 6})
def read_psd(spark, d):
    path = os.path.join(v.scratch(spark), "psd")
    psd_table(spark, d).select(F.col("freq").alias("frequency"), F.col("psd").alias("power")).write.parquet(path)
    return io.read_psd(spark, path)


@query("completeness_check", f"""WITH {V1}, n AS (SELECT event_type AS channel, epoch_us(ts) // 21600000000 AS blk, count(*) AS n FROM events GROUP BY 1, 2)
SELECT channel, start_s, end_s, coalesce(n, 0) AS n_samples, CAST(round_even((end_s - start_s) * 0.0008, 0) AS BIGINT) AS expected,
  abs(coalesce(n, 0) - CAST(round_even((end_s - start_s) * 0.0008, 0) AS BIGINT)) <= 0.0008 AS complete FROM segs LEFT JOIN n USING (channel, blk)""",
       {"start_s": 6, "end_s": 6})
def completeness_check(spark, d):
    segs = v.segments(spark, d)
    stored = v.event_blocks(spark, d).join(segs, ["channel", "blk"])
    return S.completeness(stored, segs.drop("blk"), 0.0008).select("channel", "start_s", "end_s", "n_samples", "expected", "complete")


def audit_rows(spark, d):
    e = v.table(spark, d, "events")
    phases = F.array(*[F.lit(p) for p in ("training", "hpo", "calibration", "final")])
    splits = F.array(*[F.lit(s) for s in folds.SPLITS])
    return e.select(
        F.col("value").alias("t"), F.element_at(phases, (F.col("event_id") % 4 + 1).cast("int")).alias("phase"),
        F.element_at(splits, (F.col("user_id") % 5 + 1).cast("int")).alias("split"), F.col("event_type").alias("label"),
        F.when(F.col("event_id") % 4 == 1, F.col("event_id").cast("int")).alias("trial"), F.col("user_id").alias("n_segments"),
        F.col("value").alias("livetime"), F.concat(F.lit("job.py:"), F.col("event_id") % 90).alias("caller"),
    )


AUDIT = """au AS (SELECT ['training', 'hpo', 'calibration', 'final'][event_id % 4 + 1] AS phase,
  ['train', 'hpo_train', 'hpo_val', 'hpo_bg', 'eval'][user_id % 5 + 1] AS split, event_type AS label,
  CASE WHEN event_id % 4 = 1 THEN CAST(event_id AS INTEGER) END AS trial, event_id % 90 AS line FROM events)"""


def audit_file(spark, d):
    path = os.path.join(v.scratch(spark), "audit")
    rows = audit_rows(spark, d)
    folds.append_audit(rows.filter("t < 20"), path)
    folds.append_audit(rows.filter("t >= 20"), path)
    return folds.read_audit(spark, path)


@query("append_audit", f"WITH {AUDIT} SELECT phase, split, count(*) AS n, count(trial) AS n_trials FROM au GROUP BY 1, 2")
def append_audit(spark, d):
    return audit_file(spark, d).groupBy("phase", "split").agg(F.count(F.lit(1)).alias("n"), F.count("trial").alias("n_trials"))


@query("audit_assertion", f"WITH {AUDIT} SELECT 'job.py:' || line AS caller, phase, label, count(*) AS n FROM au WHERE split = 'eval' AND phase <> 'final' GROUP BY 1, 2, 3")
def audit_assertion(spark, d):
    return folds.audit_offenders(audit_file(spark, d)).groupBy("caller", "phase", "label").agg(F.count(F.lit(1)).alias("n"))


# --- records, trials, budgets ---------------------------------------------------------------

TRIAL = """tr AS (SELECT CAST(o_orderkey AS INTEGER) AS index, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS state,
  CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS objective FROM orders)"""


def trial_log(spark, d):
    o = v.table(spark, d, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("int").alias("index"), F.create_map(F.lit("lr"), F.col("o_totalprice") / 1e6).alias("params"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("objective"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("state"), F.lit(1.0).alias("seconds"), F.lit("").alias("error"),
    )
    path = os.path.join(v.scratch(spark), "trials")
    rows.write.json(path)
    return io.read_trials(spark, path)


@query("read_trials", f"WITH {TRIAL} SELECT state, count(*) AS n, count(objective) AS n_scored FROM tr GROUP BY 1")
def read_trials(spark, d):
    return trial_log(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("objective").alias("n_scored"))


@query("best_trial", f"WITH {TRIAL} SELECT index, objective FROM tr WHERE state = 'done' ORDER BY objective, index LIMIT 1", {"objective": 6})
def best_trial(spark, d):
    return records.best_trial(trial_log(spark, d)).select("index", "objective")


@query("sweep_summary", f"""WITH {TRIAL}, b AS (SELECT index, objective FROM tr WHERE state = 'done' ORDER BY objective, index LIMIT 1)
SELECT count(*) AS n_trials, count(*) FILTER (state = 'done') AS n_done, count(*) FILTER (state <> 'done') AS n_failed,
  (SELECT index FROM b) AS best_index, (SELECT objective FROM b) AS best_objective FROM tr""", {"best_objective": 6})
def sweep_summary(spark, d):
    s = records.sweep_summary(trial_log(spark, d))
    return s.select("n_trials", "n_done", "n_failed", F.col("best.index").alias("best_index"), F.col("best.objective").alias("best_objective"))


def record_rows(spark, d):
    """One record per order customer, with gaps that follow from its key."""
    c = v.table(spark, d, "customer")
    k = F.col("c_custkey")
    held = lambda m, name: F.when(k % m != 0, F.create_map(F.lit(name), k.cast("string")))
    return c.select(
        F.concat(F.lit("run"), k).alias("name"), F.when(k % 7 == 0, " ").otherwise("moves it").alias("hypothesis"),
        F.when(k % 11 == 0, "").otherwise("diff").alias("change"), held(13, "cae").alias("parameters"), held(17, "fold").alias("folds"),
        held(19, "eff").alias("primary"), F.slice(F.array(F.lit(42), F.lit(43), F.lit(44)), 1, (k % 4).cast("int")).alias("seeds"),
        F.element_at(F.array(F.lit("keep"), F.lit("discard"), F.lit("needs-more-work"), F.lit("maybe")), (k % 4 + 1).cast("int")).alias("verdict"),
        F.when(k % 23 == 0, "").otherwise("because").alias("reasoning"), F.lit(1).alias("unknown_key"),
    )


RECORD_SQL = """rec AS (SELECT 'run' || c_custkey AS name, c_custkey AS k, ['keep', 'discard', 'needs-more-work', 'maybe'][c_custkey % 4 + 1] AS verdict,
  CAST(k % 7 = 0 AS INTEGER) + CAST(k % 11 = 0 AS INTEGER) + CAST(k % 13 = 0 AS INTEGER) + CAST(k % 17 = 0 AS INTEGER)
  + CAST(k % 19 = 0 AS INTEGER) + CAST(k % 4 = 0 AS INTEGER) + CAST(k % 4 = 3 AS INTEGER) + CAST(k % 23 = 0 AS INTEGER) AS n_problems
  FROM customer)"""


@query("record_problems", f"WITH {RECORD_SQL} SELECT name, n_problems, n_problems = 0 AS valid FROM rec")
def record_problems(spark, d):
    return records.record_problems(record_rows(spark, d)).select("name", F.size("problems").alias("n_problems"), "valid")


def record_files(spark, d):
    path = v.scratch(spark)
    name = F.col("name")
    doc = record_rows(spark, d).withColumn("run", F.pmod(F.xxhash64(name), F.lit(8)))
    doc.select("run", F.to_json(F.struct(*[c for c in doc.columns if c != "run"])).alias("value")).write.partitionBy("run").text(os.path.join(path, "runs"))
    return os.path.join(path, "runs")


@query("collect_records", f"WITH {RECORD_SQL} SELECT verdict, count(*) AS n FROM rec GROUP BY 1")
def collect_records(spark, d):
    path = record_files(spark, d)
    got = io.collect_records(spark, path, "*/*.txt", per_line=True)
    return got.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("results_table", f"WITH {RECORD_SQL} SELECT name, verdict, CAST(k % 4 AS INTEGER) AS n_seeds, n_problems = 0 AS valid FROM rec")
def results_table(spark, d):
    path = record_files(spark, d)
    got = io.collect_records(spark, path, "*/*.txt", per_line=True)
    return reports.results_table(got).drop("problems")


@query("flatten_struct", """SELECT l_linenumber AS "run.line", l_returnflag AS "run.fold.flag", count(*) AS n FROM lineitem GROUP BY 1, 2""")
def flatten_struct(spark, d):
    li = v.table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    nested = li.select(F.struct(F.col("l_linenumber").alias("line"), F.struct(F.col("l_returnflag").alias("flag")).alias("fold")).alias("run"), "n")
    return records.flatten_struct(nested)


def counts(spark, d):
    path = os.path.join(v.scratch(spark), "counts")
    li = v.table(spark, d, "lineitem").groupBy(F.concat(F.lit("c"), F.col("l_linenumber")).alias("component")).agg(F.count(F.lit(1)).alias("count"))
    doc = li.agg(F.map_from_entries(F.collect_list(F.struct("component", "count"))).alias("components"))  # one entry per line number
    doc.select(F.to_json(F.struct("components")).alias("value")).coalesce(1).write.text(path)
    return io.read_counts(spark, path)


@query("load_reference_counts", "SELECT 'c' || l_linenumber AS component, count(*) AS count FROM lineitem GROUP BY 1")
def load_reference_counts(spark, d):
    return counts(spark, d)


@query("budget_verdict", """WITH r AS (SELECT 'c' || l_linenumber AS component, count(*) AS baseline, count(*) FILTER (l_returnflag <> 'A') AS candidate FROM lineitem GROUP BY 1)
SELECT component, candidate, baseline, abs(candidate - baseline) <= 0.33::DOUBLE * baseline AS passed, candidate / CAST(baseline AS DOUBLE) AS ratio FROM r""", {"ratio": 6})
def budget_verdict(spark, d):
    li = v.table(spark, d, "lineitem").filter("l_returnflag <> 'A'")
    candidate = li.groupBy(F.concat(F.lit("c"), F.col("l_linenumber")).alias("component")).agg(F.count(F.lit(1)).alias("count"))
    return records.budget_verdict(candidate, counts(spark, d), 0.33)
