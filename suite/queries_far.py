"""False-alarm rates, thresholds, efficiency and volume over the campaign view."""

from __future__ import annotations

from pyspark.sql import functions as F

from farspark.functions import expressions as X
from farspark.operators import efficiency as eff
from farspark.operators import far as rates
from farspark.operators import volume
from farspark.operators.ordered import union_all
from farspark.plans import reports
from suite import views as v
from suite.registry import query
from suite.views import TARGETS, TRIALS, V3, V6, YEARS

N_ALLOWED = "(VALUES (100.0::DOUBLE, 250), (30.0::DOUBLE, 75), (10.0::DOUBLE, 25)) t(far_per_yr, n_allowed)"
WILSON = """CASE WHEN {n} > 0 THEN greatest(0.0, ({k}/{n} + 1/(2.0*{n})) / (1 + 1.0/{n})
    - sqrt({k}/{n} * (1 - {k}/{n}) / {n} + 1/(4.0*{n}*{n})) / (1 + 1.0/{n})) ELSE 0.0 END AS lo,
  CASE WHEN {n} > 0 THEN least(1.0, ({k}/{n} + 1/(2.0*{n})) / (1 + 1.0/{n})
    + sqrt({k}/{n} * (1 - {k}/{n}) / {n} + 1/(4.0*{n}*{n})) / (1 + 1.0/{n})) ELSE 0.0 END AS hi"""


def wilson(k: str, n: str) -> str:
    return WILSON.format(k=f"CAST({k} AS DOUBLE)", n=f"CAST({n} AS DOUBLE)")


def thresholds_sql(source: str = "bg", stat: str = "stat", by: str = "channel") -> str:
    """CTEs `ranked` and `thr`: the n-th largest value per group and target."""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"""ranked AS (SELECT {lead}{stat} AS v, row_number() OVER ({part}ORDER BY {stat} DESC) AS rk,
    count(*) OVER ({part}) AS n_background FROM {source}),
thr AS (SELECT {lead}far_per_yr, CAST(n_allowed AS BIGINT) AS n_allowed, n_background, v AS threshold,
    n_allowed < n_background AS resolved
  FROM ranked CROSS JOIN {N_ALLOWED} WHERE rk = least(n_allowed, n_background))"""


def both(spark, d):
    return v.background(spark, d), v.foreground(spark, d)


@query("threshold_at_far", f"WITH {V3}, {thresholds_sql()} SELECT * FROM thr", {"threshold": 6})
def threshold_at_far(spark, d):
    return rates.thresholds_at_far(v.background(spark, d), "stat", YEARS, TARGETS, TRIALS, ["channel"])


@query("efficiency_at_far", f"""WITH {V3}, {thresholds_sql(by='')},
  hit AS (SELECT far_per_yr, threshold, count(*) AS n_total, count(*) FILTER (stat >= threshold) AS n_found
    FROM fg CROSS JOIN thr GROUP BY 1, 2)
SELECT *, n_found / CAST(n_total AS DOUBLE) AS efficiency, {wilson('n_found', 'n_total')} FROM hit""",
       {"threshold": 6, "efficiency": 6, "lo": 6, "hi": 6})
def efficiency_at_far(spark, d):
    bg, fg = both(spark, d)
    return eff.efficiency_at_far(fg, bg, "stat", YEARS, TARGETS, TRIALS)


@query("far_of", f"""WITH {V3}, f AS (SELECT channel, stat, count(*) AS n FROM fg GROUP BY 1, 2),
  b AS (SELECT channel, stat, count(*) AS n FROM bg GROUP BY 1, 2),
  u AS (SELECT channel, stat, sum(nb) AS nb, sum(nf) AS nf FROM (SELECT channel, stat, n AS nb, 0 AS nf FROM b
    UNION ALL SELECT channel, stat, 0, n FROM f) GROUP BY 1, 2),
  c AS (SELECT channel, stat, nf, sum(nb) OVER (PARTITION BY channel ORDER BY stat DESC) AS louder FROM u)
SELECT channel, 4 * greatest(louder, 1) / 10.0::DOUBLE AS far_per_yr, CAST(sum(nf) AS BIGINT) AS n
FROM c WHERE nf > 0 GROUP BY 1, 2""", {"far_per_yr": 6})
def far_of(spark, d):
    bg, fg = both(spark, d)
    rated = rates.far_of(fg, bg, "stat", YEARS, TRIALS, ["channel"])
    return rated.groupBy("channel", "far_per_yr").agg(F.count(F.lit(1)).alias("n"))


@query("ifar", f"""WITH {V3}, b AS (SELECT channel, stat, sum(count(*)) OVER (PARTITION BY channel ORDER BY stat DESC) AS louder
    FROM bg GROUP BY 1, 2)
SELECT channel, stat, 10.0::DOUBLE / (4 * louder) AS ifar_yr FROM b""", {"stat": 6, "ifar_yr": 8})
def ifar(spark, d):
    bg = v.background(spark, d)
    values = bg.select("channel", "stat").distinct()
    rated = rates.far_of(values, bg, "stat", YEARS, TRIALS, ["channel"])
    return rated.select("channel", "stat", rates.ifar("far_per_yr").alias("ifar_yr"))


@query("resolvable_floor", f"""WITH {V3}, n AS (SELECT count(*) AS n_background FROM bg),
  t AS (SELECT DISTINCT CAST(par AS DOUBLE) / 10 AS far_per_yr FROM fg)
SELECT far_per_yr, 0.4::DOUBLE AS floor_per_yr FROM t WHERE far_per_yr >= 0.4::DOUBLE""", {"far_per_yr": 6, "floor_per_yr": 6})
def resolvable_floor(spark, d):
    targets = v.foreground(spark, d).select((F.col("par") / 10).alias("far_per_yr")).distinct()
    return rates.resolvable_targets(targets, YEARS, TRIALS)


@query("trials_factor", f"""WITH {V3}, {thresholds_sql(by='')}
SELECT a.n_arms, CAST(2 * a.n_arms AS INTEGER) AS trials, count(*) FILTER (stat > 90) * 2 * a.n_arms / 10.0::DOUBLE AS far_per_yr
FROM bg CROSS JOIN (VALUES (1), (2)) a(n_arms) GROUP BY 1, 2""", {"far_per_yr": 6})
def trials_factor(spark, d):
    loud = v.background(spark, d).agg(F.count(F.when(F.col("stat") > 90, 1)).alias("n"))
    rows = [
        loud.select(F.lit(a).alias("n_arms"), F.lit(X.trials_factor(2, a)).alias("trials"),
                    X.far_rate("n", YEARS, X.trials_factor(2, a)).alias("far_per_yr"))
        for a in (1, 2)
    ]
    return union_all(rows)


@query("own_channel_threshold", f"""WITH {V3}, {thresholds_sql()}
SELECT fg.channel, far_per_yr, threshold, count(*) AS n, count(*) FILTER (fg.stat > threshold) AS n_found
FROM fg JOIN thr ON thr.channel = fg.channel GROUP BY 1, 2, 3""", {"threshold": 6})
def own_channel_threshold(spark, d):
    bg, fg = both(spark, d)
    thr = rates.thresholds_at_far(bg, "stat", YEARS, TARGETS, TRIALS, ["channel"])
    judged = rates.own_channel_threshold(fg, thr, "stat", ["channel"], inclusive=False)
    return judged.groupBy("channel", "far_per_yr", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("found"), 1)).alias("n_found")
    )


@query("efficiency_weighted", f"""WITH {V3}, {thresholds_sql(by='')},
  s AS (SELECT far_per_yr, count(*) AS n_total, count(*) FILTER (stat >= threshold) AS n_found, sum(w) AS sw, sum(w * w) AS sww,
      sum(CASE WHEN stat >= threshold THEN w ELSE 0 END) AS swf FROM fg CROSS JOIN thr GROUP BY 1),
  e AS (SELECT far_per_yr, n_total, n_found, CAST(round_even(sw * sw / sww, 0) AS BIGINT) AS n_eff, swf / sw AS efficiency FROM s)
SELECT *, {wilson('round_even(efficiency * n_eff, 0)', 'n_eff')} FROM e""",
       {"efficiency": 6, "lo": 6, "hi": 6})
def efficiency_weighted(spark, d):
    bg, fg = both(spark, d)
    return eff.efficiency_at_far(fg, bg, "stat", YEARS, TARGETS, TRIALS, weight="w").drop("threshold")


def binned_sql(edges, source: str, keep_empty: bool = True) -> str:
    rows = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    having = "" if keep_empty else " WHERE n > 0"
    return f"""bins AS (SELECT * FROM (VALUES {rows}) t(bin, lo_edge, hi_edge)),
  cnt AS (SELECT bin, lo_edge, hi_edge, count(s.par) AS n, count(s.par) FILTER (s.found) AS n_found
    FROM bins LEFT JOIN {source} s ON s.par >= lo_edge AND s.par < hi_edge GROUP BY 1, 2, 3)
SELECT bin, lo_edge, hi_edge, n, n_found, CASE WHEN n > 0 THEN n_found / CAST(n AS DOUBLE) END AS efficiency,
  {wilson('n_found', 'n')} FROM cnt{having}"""


ROUND = {"efficiency": 6, "lo": 6, "hi": 6}
EDGES = (0.0, 5.0, 12.5, 25.0, 40.0, 60.0, 80.0)
JUDGED = f"""{V3}, {thresholds_sql(by='')}, judged AS (SELECT fg.*, stat >= threshold AS found FROM fg CROSS JOIN thr
  WHERE far_per_yr = 100)"""


def judged(spark, d, inclusive=True):
    bg, fg = both(spark, d)
    thr = rates.thresholds_at_far(bg, "stat", YEARS, [100.0], TRIALS)
    return rates.own_channel_threshold(fg, thr, "stat", [], [100.0], inclusive)


@query("efficiency_vs", f"WITH {JUDGED}, {binned_sql(EDGES, 'judged')}", ROUND)
def efficiency_vs(spark, d):
    return eff.efficiency_vs(judged(spark, d), "par", EDGES)


@query("efficiency_vs_snr", f"WITH {JUDGED}, {binned_sql(X.SNR_EDGES, 'judged', False)}", ROUND)
def efficiency_vs_snr(spark, d):
    return eff.efficiency_vs_snr(judged(spark, d), "par")


@query("efficiency_vs_mass", f"""WITH {JUDGED}, m AS (SELECT par * 5 AS par, found FROM judged),
  {binned_sql(X.MASS_EDGES, 'm')}""", ROUND)
def efficiency_vs_mass(spark, d):
    return eff.efficiency_vs_mass(judged(spark, d).withColumn("total_mass", F.col("par") * 5))


@query("achieved_far", f"""WITH {V3}, {thresholds_sql()}
SELECT channel, far_per_yr, threshold, count(*) FILTER (stat >= threshold) AS n_above,
  4 * count(*) FILTER (stat >= threshold) / 10.0::DOUBLE AS achieved_far_per_yr
FROM bg JOIN thr USING (channel) GROUP BY 1, 2, 3""", {"threshold": 6, "achieved_far_per_yr": 6})
def achieved_far(spark, d):
    bg = v.background(spark, d)
    thr = rates.thresholds_at_far(bg, "stat", YEARS, TARGETS, TRIALS, ["channel"])
    return rates.achieved_far(bg, thr, "stat", YEARS, TRIALS, ["channel"])


VOLUME_SQL = """SELECT far_per_yr, n_injections, n_found, 10 * p AS v_sens_gpc3,
  10 * sqrt(vv) AS v_sens_err_gpc3, pow(3e9 * 10 * p / (4 * pi()), 1.0 / 3) AS horizon_mpc, 5 * p AS vt_gpc3_yr"""


def volume_ctes(stat: str = "stat", name: str = "vol") -> str:
    return f"""p_{name} AS (SELECT far_per_yr, threshold, count(*) AS n_injections, count(*) FILTER ({stat} >= threshold) AS n_found,
    sum(w) AS sw, sum(CASE WHEN {stat} >= threshold THEN w ELSE 0 END) / sum(w) AS p FROM fg CROSS JOIN thr GROUP BY 1, 2),
  {name} AS (SELECT q.far_per_yr, q.n_injections, q.n_found, q.p,
      sum(w * w * pow((CASE WHEN {stat} >= q.threshold THEN 1 ELSE 0 END) - q.p, 2)) / (q.sw * q.sw) AS vv
    FROM fg CROSS JOIN p_{name} q GROUP BY q.far_per_yr, q.n_injections, q.n_found, q.p, q.sw)"""


@query("sensitive_volume", f"WITH {V3}, {thresholds_sql(by='')}, {volume_ctes()} {VOLUME_SQL} FROM vol",
       {"v_sens_gpc3": 6, "v_sens_err_gpc3": 6, "horizon_mpc": 4, "vt_gpc3_yr": 6})
def sensitive_volume(spark, d):
    bg, fg = both(spark, d)
    return volume.sensitive_volume(fg, bg, "stat", YEARS, TARGETS, 10.0, 0.5, TRIALS, weight="w").drop("threshold")


@query("sensitive_distance", f"""WITH {V3} SELECT seed, sum(w) AS v_gpc3, pow(3e9 * sum(w) / (4 * pi()), 1.0 / 3) AS distance_mpc
FROM fg GROUP BY 1""", {"v_gpc3": 4, "distance_mpc": 4})
def sensitive_distance(spark, d):
    total = v.foreground(spark, d).groupBy("seed").agg(F.sum("w").alias("v_gpc3"))
    return total.withColumn("distance_mpc", X.sensitive_distance_mpc("v_gpc3"))


@query("vt_ratio", f"""WITH {V3}, {thresholds_sql(by='')}, {volume_ctes('stat', 'c')}, {volume_ctes('stat2', 'b')}
SELECT c.far_per_yr, c.p / nullif(b.p, 0) AS ratio,
  c.p / nullif(b.p, 0) * sqrt(pow(coalesce(sqrt(c.vv) / nullif(c.p, 0), 0), 2) + pow(sqrt(b.vv) / nullif(b.p, 0), 2)) AS ratio_err
FROM c JOIN b ON b.far_per_yr = c.far_per_yr""", {"ratio": 6, "ratio_err": 6})
def vt_ratio(spark, d):
    bg, fg = both(spark, d)
    thr = rates.thresholds_at_far(bg, "stat", YEARS, TARGETS, TRIALS)
    vol = lambda stat: volume.volume_of(
        rates.own_channel_threshold(fg, thr, stat, []), 10.0, weight="w", by=["far_per_yr"]
    )
    return volume.vt_ratio(vol("stat"), vol("stat2"), zero_baseline="null")


@query("wilson_interval", f"""WITH {V3}, c AS (SELECT seed, channel, count(*) AS n, count(*) FILTER (stat > 60) AS k FROM fg GROUP BY 1, 2)
SELECT *, {wilson('k', 'n')} FROM c""", {"lo": 6, "hi": 6})
def wilson_interval(spark, d):
    c = v.foreground(spark, d).groupBy("seed", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("stat") > 60, 1)).alias("k")
    )
    return c.select("*", *X.wilson_interval("k", "n"))


@query("top_k_per_channel", f"""WITH {V3}, r AS (SELECT channel, stat, row_number() OVER (PARTITION BY channel ORDER BY stat DESC) AS rank FROM bg)
SELECT channel, stat, rank, min(stat) OVER (PARTITION BY channel) AS floor FROM r WHERE rank <= 200""",
       {"stat": 6, "floor": 6})
def top_k_per_channel(spark, d):
    top = rates.top_k_per_channel(v.background(spark, d), "stat", 200)
    return top.select("channel", "stat", F.col("rank").cast("bigint").alias("rank"), "floor")


@query("loudest", f"WITH {V3} SELECT channel, max(stat) AS loudest, count(stat) AS n FROM camp GROUP BY 1", {"loudest": 6})
def loudest(spark, d):
    return rates.loudest(v.campaign(spark, d), "stat", ["channel"])


@query("resolvable_ceiling", f"""WITH {V3}, n AS (SELECT channel, count(*) AS n_background FROM bg GROUP BY 1)
SELECT channel, n_background, 4 * n_background / 10.0::DOUBLE AS ceiling_per_yr, far_per_yr,
  far_per_yr >= 0.4 AND n_allowed < n_background AS resolvable FROM n CROSS JOIN {N_ALLOWED}""", {"ceiling_per_yr": 6})
def resolvable_ceiling(spark, d):
    return rates.resolvable_ceiling(v.background(spark, d), "stat", YEARS, TARGETS, TRIALS)


EDGE_SQL = """edge AS (SELECT seed, min(stat) AS edge_stat, count(*) AS n_background FROM bg GROUP BY 1),
  edges AS (SELECT seed, edge_stat, n_background, count(*) AS n_foreground,
    count(*) FILTER (stat > edge_stat AND channel = 'strict') / CAST(count(*) AS DOUBLE) AS efficiency,
    4 * n_background / 10.0::DOUBLE AS far_per_yr FROM fg JOIN edge USING (seed) GROUP BY 1, 2, 3)"""


@query("edge_point", f"WITH {V3}, {EDGE_SQL} SELECT * FROM edges", {"edge_stat": 6, "efficiency": 6, "far_per_yr": 6})
def edge_point(spark, d):
    bg, fg = both(spark, d)
    return rates.edge_point(bg, fg, "stat", YEARS, TRIALS, member=F.col("channel") == "strict")


@query("efficiency_vs_achieved_far", f"""WITH {V3}, b AS (SELECT stat, count(*) AS n FROM bg GROUP BY 1),
  f AS (SELECT stat, count(*) AS f FROM fg WHERE channel = 'strict' GROUP BY 1),
  u AS (SELECT coalesce(b.stat, f.stat) AS stat, coalesce(n, 0) AS n, coalesce(f, 0) AS f FROM b FULL JOIN f ON b.stat = f.stat),
  c AS (SELECT stat, n, sum(n) OVER w AS louder, sum(f) OVER w - f AS above FROM u WINDOW w AS (ORDER BY stat DESC))
SELECT stat AS threshold, n AS n_equal, CAST(louder AS BIGINT) AS n_louder, 4 * louder / 10.0::DOUBLE AS far_per_yr,
  above / CAST((SELECT count(*) FROM fg) AS DOUBLE) AS efficiency FROM c WHERE n > 0""",
       {"threshold": 6, "far_per_yr": 6, "efficiency": 6})
def efficiency_vs_achieved_far(spark, d):
    bg, fg = both(spark, d)
    return rates.efficiency_vs_achieved_far(bg, fg, "stat", YEARS, TRIALS, F.col("channel") == "strict")


@query("scanned_ranks", f"""WITH {V3}, n AS (SELECT count(*) AS n FROM bg),
  k AS (SELECT DISTINCT CAST(greatest(1, least(n, round_even(pow(greatest(n, 2), s / 7.0), 0))) AS BIGINT) AS n_louder
    FROM n CROSS JOIN range(8) t(s)),
  r AS (SELECT stat, row_number() OVER (ORDER BY stat DESC) AS rk FROM bg)
SELECT n_louder, r.stat AS threshold, 4 * n_louder / 10.0::DOUBLE AS far_per_yr,
  count(*) FILTER (fg.stat > r.stat AND channel = 'strict') / CAST(count(*) AS DOUBLE) AS efficiency
FROM k JOIN r ON rk = n_louder CROSS JOIN fg GROUP BY 1, 2""", {"threshold": 6, "far_per_yr": 6, "efficiency": 6})
def scanned_ranks(spark, d):
    bg, fg = both(spark, d)
    return rates.scanned_ranks(bg, fg, "stat", YEARS, TRIALS, F.col("channel") == "strict")


@query("injection_far_quantiles", f"""WITH {V3}, b AS (SELECT stat, count(*) AS n FROM bg GROUP BY 1),
  f AS (SELECT stat, par FROM fg WHERE par >= 6 AND par < 40),
  c AS (SELECT stat, sum(n) OVER (ORDER BY stat DESC) AS louder FROM (SELECT stat, sum(n) AS n FROM
    (SELECT stat, n FROM b UNION ALL SELECT DISTINCT stat, 0 FROM f) GROUP BY 1))
SELECT CASE WHEN par < 10 THEN 0 WHEN par < 15 THEN 1 WHEN par < 25 THEN 2 ELSE 3 END AS band,
  quantile_cont(4 * greatest(louder, 1) / 10.0::DOUBLE, 0.5) AS median_far, min(4 * greatest(louder, 1) / 10.0::DOUBLE) AS best_far,
  count(*) AS n FROM f JOIN c USING (stat) GROUP BY 1""", {"median_far": 6, "best_far": 6})
def injection_far_quantiles(spark, d):
    bg, fg = both(spark, d)
    rated = rates.far_of(fg, bg, "stat", YEARS, TRIALS).withColumn("band", X.bin_index("par", X.FAR_SNR_EDGES))
    return rates.injection_far_quantiles(rated, "band")


SEED_THR = thresholds_sql(by="seed").replace(N_ALLOWED, "(VALUES (100.0::DOUBLE, 250), (30.0::DOUBLE, 75)) t(far_per_yr, n_allowed)")
PER_SEED = f"""per_seed AS (SELECT seed, far_per_yr, count(*) FILTER (stat > threshold) / CAST(count(*) AS DOUBLE) AS efficiency
  FROM fg JOIN thr USING (seed) GROUP BY 1, 2)"""


@query("seed_summary", f"""WITH {V3}, {SEED_THR}, {PER_SEED}
SELECT far_per_yr, avg(efficiency) AS mean, min(efficiency) AS min, max(efficiency) AS max,
  max(efficiency) - min(efficiency) AS range, stddev_samp(efficiency) AS sd, count(*) AS n_seeds FROM per_seed GROUP BY 1""",
       {"mean": 6, "min": 6, "max": 6, "range": 6, "sd": 6})
def seed_summary(spark, d):
    bg, fg = both(spark, d)
    thr = rates.thresholds_at_far(bg, "stat", YEARS, [100.0, 30.0], TRIALS, ["seed"])
    per = eff.efficiency(rates.own_channel_threshold(fg, thr, "stat", ["seed"], inclusive=False), by=["seed", "far_per_yr"])
    return eff.seed_summary(per)


TWO_MODELS = """m_bg AS (SELECT 'one' AS model, channel, stat, par FROM bg UNION ALL SELECT 'two', channel, stat2, par FROM bg),
  m_fg AS (SELECT 'one' AS model, channel, stat, par FROM fg UNION ALL SELECT 'two', channel, stat2, par FROM fg),
  m_thr AS (SELECT model, channel, stat AS threshold FROM (SELECT model, channel, stat,
    row_number() OVER (PARTITION BY model, channel ORDER BY stat DESC) AS rk FROM m_bg) WHERE rk = 250),
  m_bins AS (SELECT row_number() OVER (ORDER BY lo) - 1 AS bin, lo, hi FROM (VALUES (6.0::DOUBLE, 8.0::DOUBLE), (8, 10), (10, 12), (12, 15),
    (15, 20), (20, 25), (25, 32), (32, 40)) t(lo, hi)),
  m_out AS (SELECT model, CAST(bin AS INTEGER) AS bin, lo AS lo_edge, hi AS hi_edge, count(*) AS n,
    count(*) FILTER (stat > threshold) AS n_found FROM m_fg JOIN m_thr USING (model, channel) JOIN m_bins ON par >= lo AND par < hi
    GROUP BY 1, 2, 3, 4)"""


def two_models(spark, d, fn):
    df = fn(spark, d)
    one = df.select(F.lit("one").alias("model"), "channel", "stat", "par")
    return one.unionByName(df.select(F.lit("two").alias("model"), "channel", F.col("stat2").alias("stat"), "par"))


@query("two_model_compare", f"""WITH {V3}, {TWO_MODELS}
SELECT model, bin, lo_edge, hi_edge, n, n_found, n_found / CAST(n AS DOUBLE) AS efficiency, {wilson('n_found', 'n')} FROM m_out""", ROUND)
def two_model_compare(spark, d):
    bg, fg = two_models(spark, d, v.background), two_models(spark, d, v.foreground)
    return eff.two_model_compare(fg, bg, "stat", YEARS, 100.0, "par", TRIALS)


@query("two_model_report", f"""WITH {V3}, {TWO_MODELS}
SELECT bin, lo_edge, hi_edge, max(CASE WHEN model = 'one' THEN n END) AS one_n,
  max(CASE WHEN model = 'one' THEN n_found / CAST(n AS DOUBLE) END) AS one_efficiency,
  max(CASE WHEN model = 'two' THEN n END) AS two_n, max(CASE WHEN model = 'two' THEN n_found / CAST(n AS DOUBLE) END) AS two_efficiency
FROM m_out GROUP BY 1, 2, 3""", {"one_efficiency": 6, "two_efficiency": 6})
def two_model_report(spark, d):
    return eff.side_by_side(two_model_compare(spark, d), ["one", "two"])


@query("is_glitch", f"""WITH {V3} SELECT channel, greatest(hm, lm) < 0.5 AS glitch, count(*) AS n FROM fg GROUP BY 1, 2""")
def is_glitch(spark, d):
    return v.foreground(spark, d).groupBy("channel", X.is_glitch("hm", "lm").alias("glitch")).agg(F.count(F.lit(1)).alias("n"))


@query("gate_kept", f"""WITH {V3}, r AS (SELECT *, NOT (greatest(hm, lm) < 0.5) AS kept FROM bg)
SELECT channel, count(*) AS n_gated, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept) / CAST(count(*) AS DOUBLE) AS kept_fraction,
  min(stat) AS floor FROM r GROUP BY 1""", {"kept_fraction": 6, "floor": 6})
def gate_kept(spark, d):
    gated = v.background(spark, d).withColumn("kept", ~X.is_glitch("hm", "lm"))
    return eff.gate_kept(gated, "stat")


@query("efficiency_report", f"""WITH {V3}, {thresholds_sql()}
SELECT far_per_yr, count(*) AS n_total, count(*) FILTER (stat > threshold) AS n_found,
  count(*) FILTER (stat > threshold) / CAST(count(*) AS DOUBLE) AS efficiency,
  {wilson('count(*) FILTER (stat > threshold)', 'count(*)')}
FROM fg JOIN thr USING (channel) GROUP BY 1""", ROUND)
def efficiency_report(spark, d):
    bg, fg = both(spark, d)
    return reports.efficiency_report(bg, fg, YEARS, TARGETS, TRIALS, stat="stat")["efficiency"]


@query("efficiency_report_far_quantiles", f"""WITH {V3}, u AS (SELECT stat, 1 AS b FROM bg WHERE channel = 'general'
    UNION ALL SELECT DISTINCT stat, 0 FROM fg WHERE channel = 'general'),
  c AS (SELECT stat, sum(sum(b)) OVER (ORDER BY stat DESC) AS louder FROM u GROUP BY stat),
  rated AS (SELECT CASE WHEN channel = 'strict' THEN 'inf'::DOUBLE ELSE {TRIALS} * greatest(louder, 1) / {YEARS}::DOUBLE END AS far,
      CASE WHEN par >= 6 AND par < 10 THEN 0 WHEN par >= 10 AND par < 15 THEN 1 WHEN par >= 15 AND par < 25 THEN 2
        WHEN par >= 25 AND par < 40 THEN 3 END AS snr_band FROM fg LEFT JOIN c USING (stat)),
  r AS (SELECT *, row_number() OVER (PARTITION BY snr_band ORDER BY far) AS rk, count(*) OVER (PARTITION BY snr_band) AS n
    FROM rated WHERE snr_band IS NOT NULL)
SELECT snr_band, avg(far) FILTER (rk IN ((n + 1) // 2, (n + 2) // 2)) AS median_far, min(far) AS best_far, count(*) AS n FROM r GROUP BY 1""",
    {"median_far": 6, "best_far": 6})
def efficiency_report_far_quantiles(spark, d):
    """The strict channel has no background here."""
    bg, fg = both(spark, d)
    fg = fg.withColumn("network_snr", F.col("par"))
    report = reports.efficiency_report(bg.filter("channel = 'general'"), fg, YEARS, TARGETS, TRIALS, stat="stat")
    return report["far_quantiles"]


STRICT_EDGE = EDGE_SQL.replace("FROM bg GROUP BY 1", "FROM bg WHERE channel = 'strict' GROUP BY 1")
#: Per seed the targets that every channel of it resolves, and what is found of its foreground there.
SEEDS = f"""{V3}, {thresholds_sql(by='seed, channel')}, bad AS (SELECT DISTINCT seed, far_per_yr FROM thr WHERE NOT resolved),
  good AS (SELECT * FROM thr ANTI JOIN bad USING (seed, far_per_yr)), ask AS (SELECT DISTINCT seed, far_per_yr FROM good),
  hit AS (SELECT f.seed, a.far_per_yr, count(*) AS n_total, count(*) FILTER (f.stat > g.threshold) AS n_found FROM fg f JOIN ask a USING (seed)
    LEFT JOIN good g ON g.seed = f.seed AND g.channel = f.channel AND g.far_per_yr = a.far_per_yr GROUP BY 1, 2),
  per_seed AS (SELECT *, n_found / CAST(n_total AS DOUBLE) AS efficiency, {wilson('n_found', 'n_total')} FROM hit)"""


def seeds(spark, d):
    bg, fg = both(spark, d)
    return reports.baseline_seeds(bg, fg, "stat", YEARS, TARGETS, TRIALS)


@query("baseline_seeds_per_seed", f"WITH {SEEDS} SELECT * FROM per_seed", ROUND)
def baseline_per_seed(spark, d):
    return seeds(spark, d)["per_seed"]


@query("baseline_seeds_summary", f"""WITH {SEEDS} SELECT far_per_yr, avg(efficiency) AS mean, min(efficiency) AS min, max(efficiency) AS max,
  max(efficiency) - min(efficiency) AS range, stddev_samp(efficiency) AS sd, count(*) AS n_seeds FROM per_seed GROUP BY 1""",
       {"mean": 6, "min": 6, "max": 6, "range": 6, "sd": 6})
def baseline_summary(spark, d):
    return seeds(spark, d)["summary"]


@query("baseline_seeds_edges", f"WITH {V3}, {STRICT_EDGE} SELECT * FROM edges", {"edge_stat": 6, "efficiency": 6, "far_per_yr": 6})
def baseline_edges(spark, d):
    return seeds(spark, d)["edges"]


@query("baseline_seeds_ceiling", f"""WITH {V3}, n AS (SELECT seed, channel, count(*) AS n_background FROM bg GROUP BY 1, 2)
SELECT seed, channel, n_background, 4 * n_background / 10.0::DOUBLE AS ceiling_per_yr, far_per_yr,
  far_per_yr >= 0.4 AND n_allowed < n_background AS resolvable FROM n CROSS JOIN {N_ALLOWED}""", {"ceiling_per_yr": 6})
def baseline_ceiling(spark, d):
    return seeds(spark, d)["ceiling"]


# --- every output of the efficiency report --------------------------------------------------


def report_of(spark, d, targets=TARGETS, **columns):
    bg, fg = both(spark, d)
    return reports.efficiency_report(bg, fg.withColumns(columns), YEARS, targets, TRIALS, stat="stat")


OWN = f"""{V3}, {thresholds_sql()}, own AS (SELECT fg.*, stat > threshold AS found FROM fg JOIN thr USING (channel) WHERE far_per_yr = 100)"""


@query("efficiency_report_thresholds", f"WITH {V3}, {thresholds_sql()} SELECT * FROM thr WHERE far_per_yr NOT IN (SELECT far_per_yr FROM thr WHERE NOT resolved)",
       {"threshold": 6})
def efficiency_report_thresholds(spark, d):
    return report_of(spark, d)["thresholds"]


@query("efficiency_report_scanned", f"""WITH {V3}, sb AS (SELECT * FROM bg WHERE channel = 'strict'), n AS (SELECT count(*) AS n FROM sb),
  k AS (SELECT DISTINCT CAST(greatest(1, least(n, round_even(pow(greatest(n, 2), s / 7.0), 0))) AS BIGINT) AS n_louder FROM n CROSS JOIN range(8) t(s)),
  r AS (SELECT stat, row_number() OVER (ORDER BY stat DESC) AS rk FROM sb)
SELECT n_louder, r.stat AS threshold, 4 * n_louder / 10.0::DOUBLE AS far_per_yr,
  count(*) FILTER (fg.stat > r.stat AND channel = 'strict') / CAST(count(*) AS DOUBLE) AS efficiency
FROM k JOIN r ON rk = n_louder CROSS JOIN fg GROUP BY 1, 2""", {"threshold": 6, "far_per_yr": 6, "efficiency": 6})
def efficiency_report_scanned(spark, d):
    return report_of(spark, d)["scanned"]


@query("efficiency_report_loudest", f"WITH {V3} SELECT channel, max(stat) AS loudest, count(stat) AS n FROM bg GROUP BY 1", {"loudest": 6})
def efficiency_report_loudest(spark, d):
    return report_of(spark, d)["loudest"]


@query("efficiency_report_mass", f"""WITH {OWN}, m AS (SELECT par * 5 AS par, found FROM own),
  {binned_sql(X.REPORT_MASS_EDGES, 'm')}""", ROUND)
def efficiency_report_mass(spark, d):
    return report_of(spark, d, (100.0,), total_mass=F.col("par") * 5)["vs_mass"].drop("far_per_yr")


@query("efficiency_report_gated", f"""WITH {V3}, gk AS (SELECT * FROM bg WHERE NOT greatest(hm, lm) < 0.5), {thresholds_sql('gk')},
  fl AS (SELECT channel, min(stat) AS floor FROM bg GROUP BY 1),
  bad AS (SELECT DISTINCT far_per_yr FROM thr JOIN fl USING (channel) WHERE NOT (resolved AND NOT threshold < floor))
SELECT far_per_yr, count(*) AS n_total, count(*) FILTER (stat > threshold AND NOT greatest(hm, lm) < 0.5) AS n_found,
  count(*) FILTER (stat > threshold AND NOT greatest(hm, lm) < 0.5) / CAST(count(*) AS DOUBLE) AS efficiency,
  {wilson('count(*) FILTER (stat > threshold AND NOT greatest(hm, lm) < 0.5)', 'count(*)')}
FROM fg JOIN thr USING (channel) WHERE far_per_yr NOT IN (SELECT far_per_yr FROM bad) GROUP BY 1""", ROUND)
def efficiency_report_gated(spark, d):
    bg, fg = both(spark, d)
    gated = bg.withColumn("kept", ~X.is_glitch("hm", "lm"))
    return reports.efficiency_report(bg, fg, YEARS, TARGETS, TRIALS, stat="stat", gated=gated)["efficiency"]


@query("baseline_seeds", f"""WITH {V3}, {STRICT_EDGE}
SELECT avg(efficiency) AS efficiency_mean, max(efficiency) - min(efficiency) AS efficiency_range, avg(far_per_yr) AS far_per_yr_mean,
  max(far_per_yr) - min(far_per_yr) AS far_per_yr_range, count(*) AS n_seeds FROM edges""",
       {"efficiency_mean": 6, "efficiency_range": 6, "far_per_yr_mean": 6, "far_per_yr_range": 6})
def baseline_seeds(spark, d):
    bg, fg = both(spark, d)
    return reports.baseline_seeds(bg, fg, "stat", YEARS, TARGETS, TRIALS)["edge_range"]


BOTH_BINS = X.FREQUENCY_EDGES


@query("family_bin_rates", f"""WITH {V3}, x AS (SELECT par * 7 + 35 AS f, hm, lm FROM fg),
  b AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for i, (a, b) in enumerate(zip(BOTH_BINS[:-1], BOTH_BINS[1:])))})
    t(bin, lo_edge, hi_edge))
SELECT bin, lo_edge, hi_edge, count(*) AS n, avg(CASE WHEN hm >= 0.5 THEN 1.0 ELSE 0 END) AS hm_rate,
  avg(CASE WHEN lm >= 0.5 THEN 1.0 ELSE 0 END) AS lm_rate, avg(CASE WHEN greatest(hm, lm) < 0.5 THEN 0.0 ELSE 1 END) AS gate_rate
FROM x JOIN b ON f >= lo_edge AND f < hi_edge GROUP BY 1, 2, 3""", {"hm_rate": 6, "lm_rate": 6, "gate_rate": 6})
def family_bin_rates(spark, d):
    x = v.foreground(spark, d).withColumn("f", F.col("par") * 7 + 35)
    return eff.family_bin_rates(x, "f", X.FREQUENCY_EDGES, **eff.gate_rates())


# --- channel definitions over the ranked features -------------------------------------------

STRICT = "(centroid_a < 190.78961461069167 AND centroid_b < 190.78961461069167 AND coherence + 0.1 >= 0.12767678245902062)"


def veto_rows(spark, d):
    return v.ranked_features(spark, d).withColumn("coherence", F.col("coherence") + 0.1)


@query("is_massive", f"WITH {V6} SELECT fold, {STRICT} AS massive, count(*) AS n FROM feat GROUP BY 1, 2")
def is_massive(spark, d):
    m = X.is_massive("coherence", "centroid_a", "centroid_b")
    return veto_rows(spark, d).groupBy("fold", m.alias("massive")).agg(F.count(F.lit(1)).alias("n"))


ABLATION = f"""{V6}, member AS (
    SELECT 'none' AS definition, label, stat FROM feat
    UNION ALL SELECT 'coherence', label, stat FROM feat WHERE coherence + 0.1 >= 0.12767678245902062
    UNION ALL SELECT 'morphology', label, stat FROM feat WHERE centroid_a < 190.78961461069167 AND centroid_b < 190.78961461069167
    UNION ALL SELECT 'both', label, stat FROM feat WHERE {STRICT}),
  tot AS (SELECT count(*) FILTER (NOT label) AS nb, count(*) FILTER (label) AS nf FROM feat),
  d_bg AS (SELECT * FROM member WHERE NOT label), {thresholds_sql('d_bg', by='definition')}"""


@query("veto_ablation", f"""WITH {ABLATION}
SELECT t.definition, t.n_background / CAST(nb AS DOUBLE) AS background_fraction,
  (SELECT count(*) FROM member m WHERE m.definition = t.definition AND m.label) / CAST(nf AS DOUBLE) AS foreground_fraction,
  far_per_yr, threshold, resolved,
  (SELECT count(*) FROM member m WHERE m.definition = t.definition AND m.label AND m.stat > t.threshold) / CAST(nf AS DOUBLE) AS efficiency
FROM thr t CROSS JOIN tot""", {"background_fraction": 6, "foreground_fraction": 6, "threshold": 6, "efficiency": 6})
def veto_ablation(spark, d):
    rows = veto_rows(spark, d)
    return eff.veto_ablation(rows.filter(~F.col("label")), rows.filter("label"), "stat", YEARS, TARGETS, TRIALS)


@query("channel_definitions", f"""WITH {V6}, f AS (SELECT coherence + 0.1 >= 0.12767678245902062 AS coh,
    centroid_a < 190.78961461069167 AND centroid_b < 190.78961461069167 AS low FROM feat)
SELECT 'none' AS definition, count(*) AS n FROM f UNION ALL SELECT 'coherence', count(*) FILTER (coh) FROM f
UNION ALL SELECT 'morphology', count(*) FILTER (low) FROM f UNION ALL SELECT 'both', count(*) FILTER (low AND coh) FROM f""")
def channel_definitions(spark, d):
    names = X.channel_definitions()
    counts = veto_rows(spark, d).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in names.items()])
    return counts.unpivot([], list(names), "definition", "n")


@query("veto_rates", f"""WITH {V6} SELECT avg(CASE WHEN {STRICT} THEN 1.0 ELSE 0 END) AS strict_fraction,
  quantile_cont(coherence + 0.1, 0.5) AS median_coherence, quantile_cont(centroid_a, 0.5) AS median_centroid_a FROM feat WHERE label""",
       {"strict_fraction": 6, "median_coherence": 6, "median_centroid_a": 6})
def veto_rates(spark, d):
    return eff.veto_rates(veto_rows(spark, d).filter("label"))
