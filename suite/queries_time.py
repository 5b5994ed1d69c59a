"""Segments, folds, slides and clustering over the event views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from farspark.functions import expressions as X
from farspark.operators import folds, segments as S, slides
from farspark.operators.bounded import pairs_above
from farspark.operators.settle import settle
from farspark.plans import reports
from suite import views as v
from suite.queries_far import ROUND, binned_sql, volume_ctes, wilson
from suite.registry import query
from suite.views import HALF, N_LAGS, NET_FLOOR, STEP_S, STRIDE_S, V1, V2, V2_SLID, V2_STD

GROUPED = f"""{V1}, ordered AS (SELECT *, max(end_s) OVER (ORDER BY start_s, end_s, channel
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM segs),
  grouped AS (SELECT channel, start_s, end_s, sum(CASE WHEN before IS NULL OR start_s >= before THEN 1 ELSE 0 END)
    OVER (ORDER BY start_s, end_s, channel) - 1 AS grp FROM ordered)"""

FOLDED = f"""{GROUPED}, blocks AS (SELECT grp, sum(end_s - start_s) AS live FROM grouped GROUP BY 1),
  timed AS (SELECT grp, live, coalesce(sum(live) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    count(*) OVER () AS n, sum(live) OVER () AS total FROM blocks),
  steps AS (SELECT *, CAST((before >= total / 3) AS INTEGER) + CAST((before >= total / 3 * 2) AS INTEGER) AS c FROM timed),
  stepped AS (SELECT grp, greatest(least(c, grp + min(c - grp) OVER (ORDER BY grp)), grp + 3 - n) AS fold FROM steps),
  folded AS (SELECT g.channel, g.start_s, g.end_s, g.grp, CAST(fold AS INTEGER) AS fold FROM grouped g JOIN stepped USING (grp))"""

SUMMARY = """count(*) AS n_segments, sum(end_s - start_s) AS livetime_s, min(start_s) AS span_start, max(end_s) AS span_end"""
SUMMARY_DIGITS = {"livetime_s": 3, "span_start": 3, "span_end": 3}

THREE = f"""{FOLDED}, train AS (SELECT * FROM folded WHERE fold <> 1),
  t_ordered AS (SELECT channel, start_s, end_s, max(end_s) OVER (ORDER BY start_s, end_s, channel
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM train),
  t_grouped AS (SELECT channel, start_s, end_s, sum(CASE WHEN before IS NULL OR start_s >= before THEN 1 ELSE 0 END)
    OVER (ORDER BY start_s, end_s, channel) - 1 AS grp FROM t_ordered),
  t_blocks AS (SELECT grp, sum(end_s - start_s) AS live FROM t_grouped GROUP BY 1),
  t_timed AS (SELECT grp, coalesce(sum(live) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(live) OVER () AS total, count(*) OVER () AS n FROM t_blocks),
  t_cut AS (SELECT least(greatest(count(*) FILTER (before < total * (1.0 - 0.2 - 0.3)), 1), max(n) - 2) AS first,
    count(*) FILTER (before < total * (1.0 - 0.2 - 0.3 + 0.2)) AS raw, max(n) AS n FROM t_timed),
  three AS (SELECT channel, start_s, end_s, CASE WHEN grp < first THEN 'hpo_train'
    WHEN grp < least(greatest(raw, first + 1), n - 1) THEN 'hpo_val' ELSE 'hpo_bg' END AS split FROM t_grouped CROSS JOIN t_cut)"""


def folded(spark, d, n=3):
    return folds.gps_grouped_folds(v.plain_segments(spark, d), n)


def training(spark, d):
    return settle(folded(spark, d)).filter("fold <> 1").drop("fold")


@query("total_livetime", f"WITH {V1} SELECT channel, sum(end_s - start_s) AS livetime_s FROM segs GROUP BY 1", {"livetime_s": 3})
def total_livetime(spark, d):
    return S.total_livetime(v.segments(spark, d), ["channel"])


@query("union_channels", f"""WITH {V1} SELECT channel, count(*) AS n FROM segs WHERE channel IN ('click', 'view') GROUP BY 1""")
def union_channels(spark, d):
    segs = v.segments(spark, d)
    both = S.union_channels(segs.filter("channel = 'click'"), segs.filter("channel = 'view'"))
    return both.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("coincident_livetime", f"""WITH {V1} SELECT sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)) AS coincident_livetime_s
FROM segs a JOIN segs b ON a.channel = 'click' AND b.channel = 'view' AND a.start_s < b.end_s AND b.start_s < a.end_s""",
       {"coincident_livetime_s": 3})
def coincident_livetime(spark, d):
    return S.coincident_livetime(v.segments(spark, d), "click", "view")


PAIRS = """p AS (SELECT blk * 21600.0::DOUBLE AS start_s, blk * 21600.0::DOUBLE + 21600 AS end_s FROM segs
  GROUP BY blk HAVING count(*) FILTER (channel = 'click') > 0 AND count(*) FILTER (channel = 'view') > 0)"""


@query("pair_spans", f"WITH {V1}, {PAIRS} SELECT * FROM p", {"start_s": 3, "end_s": 3})
def pair_spans(spark, d):
    whole = v.segments(spark, d).select(
        "channel", (F.col("blk") * 21600.0).alias("start_s"), (F.col("blk") * 21600.0 + 21600).alias("end_s")
    )
    return S.pair_spans(whole, "click", "view")


def catalogue(spark, d):
    """What is available: the segments of even six-hour blocks."""
    return v.segments(spark, d).filter("blk % 2 = 0").select("channel", "start_s", "end_s")


@query("available_segments", f"WITH {V1} SELECT channel, count(*) AS n, sum(end_s - start_s) AS live FROM segs WHERE blk % 2 = 0 GROUP BY 1", {"live": 3})
def available_segments(spark, d):
    have = S.available_segments(v.plain_segments(spark, d), catalogue(spark, d))
    return have.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(S.duration()).alias("live"))


@query("missing_segments", f"""WITH {V1} SELECT channel, start_s, end_s, end_s - start_s AS livetime_s FROM segs WHERE blk % 2 = 1""",
       {"start_s": 6, "end_s": 6, "livetime_s": 5})
def missing_segments(spark, d):
    return S.missing_segments(v.plain_segments(spark, d), catalogue(spark, d))


@query("overlap_groups", f"WITH {GROUPED} SELECT channel, start_s, end_s, CAST(grp AS BIGINT) AS grp FROM grouped", {"start_s": 6, "end_s": 6})
def overlap_groups(spark, d):
    return S.overlap_groups(v.plain_segments(spark, d)).select("channel", "start_s", "end_s", "grp")


@query("gps_grouped_folds", f"WITH {FOLDED} SELECT channel, start_s, end_s, fold FROM folded", {"start_s": 6, "end_s": 6})
def gps_grouped_folds(spark, d):
    return folded(spark, d)


@query("three_way_split", f"WITH {THREE} SELECT channel, start_s, end_s, split FROM three", {"start_s": 6, "end_s": 6})
def three_way_split(spark, d):
    return folds.three_way_split(training(spark, d))


@query("assert_disjoint_folds", f"""WITH {FOLDED} SELECT fold, min(start_s) AS span_start, max(end_s) AS span_end, count(*) AS n_segments,
  sum(end_s - start_s) AS livetime_s FROM folded GROUP BY 1""", SUMMARY_DIGITS)
def assert_disjoint_folds(spark, d):
    return folds.fold_spans(folds.assert_disjoint_folds(settle(folded(spark, d))))


@query("train_eval_labels", f"""WITH {FOLDED} SELECT channel, CASE WHEN fold = 1 THEN 'eval' ELSE 'train' END AS split, count(*) AS n
FROM folded GROUP BY 1, 2""")
def train_eval_labels(spark, d):
    labelled = folds.train_eval_labels(folded(spark, d), 1)
    return labelled.groupBy("channel", "split").agg(F.count(F.lit(1)).alias("n"))


@query("alternating_folds", f"""WITH {V2} SELECT span_start, CAST((row_number() OVER (ORDER BY span_start) - 1) % 2 AS INTEGER) AS fold
FROM (SELECT DISTINCT span_start FROM grid)""")
def alternating_folds(spark, d):
    return folds.alternating_folds(v.score_grid(spark, d))


@query("fold_summary", f"WITH {FOLDED} SELECT fold, {SUMMARY} FROM folded GROUP BY 1", SUMMARY_DIGITS)
def fold_summary(spark, d):
    return folds.fold_summary(folded(spark, d))


@query("split_partition_check", f"""WITH {THREE} SELECT
  (SELECT count(*) FROM (SELECT channel, start_s, end_s FROM three GROUP BY 1, 2, 3 HAVING count(DISTINCT split) > 1)) AS in_two_splits,
  (SELECT count(*) FROM (SELECT channel, start_s, end_s FROM train EXCEPT ALL SELECT channel, start_s, end_s FROM three)) AS missing,
  (SELECT count(*) FROM (SELECT channel, start_s, end_s FROM three EXCEPT ALL SELECT channel, start_s, end_s FROM train)) AS extra""")
def split_partition_check(spark, d):
    train = training(spark, d)
    return folds.split_partition_check(settle(folds.three_way_split(train)), train)


@query("span_set_equality", f"""WITH {V2}, s AS (SELECT DISTINCT span_start FROM grid),
  t AS (SELECT DISTINCT span_start FROM grid WHERE score_a > score_b)
SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t)) AS only_in_a,
  (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s)) AS only_in_b""")
def span_set_equality(spark, d):
    grid = v.score_grid(spark, d)
    return folds.span_set_equality(grid, grid.filter("score_a > score_b"))


@query("phase_permission", """WITH r AS (SELECT ['sealed', 'training', 'hpo', 'calibration', 'final', 'other'][event_id % 6 + 1] AS phase,
    ['train', 'hpo_train', 'hpo_val', 'hpo_bg', 'eval', 'none'][user_id % 6 + 1] AS split, event_type AS label FROM events)
SELECT phase, split, label, count(*) AS n, CASE phase WHEN 'training' THEN split IN ('train', 'hpo_train', 'hpo_val')
  WHEN 'hpo' THEN split IN ('hpo_train', 'hpo_val') WHEN 'calibration' THEN split IN ('train', 'hpo_train', 'hpo_val', 'hpo_bg')
  WHEN 'final' THEN split IN ('eval', 'train') ELSE FALSE END AS allowed FROM r GROUP BY 1, 2, 3""")
def phase_permission(spark, d):
    pick = lambda names, key: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(key) % 6 + 1).cast("int"))
    asked = v.table(spark, d, "events").select(
        pick([*folds.PERMISSIONS, "other"], "event_id").alias("phase"), pick([*folds.SPLITS, "none"], "user_id").alias("split"),
        F.col("event_type").alias("label"))
    return folds.phase_permission(asked).groupBy("phase", "split", "label", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("first_n_segments", f"WITH {V1} SELECT channel, start_s, end_s FROM segs ORDER BY start_s, end_s, channel LIMIT 25", {"start_s": 6, "end_s": 6})
def first_n_segments(spark, d):
    return S.first_n_segments(v.plain_segments(spark, d), 25)


@query("livetime_quota", f"""WITH {V1} SELECT channel, start_s, end_s,
  greatest(1, CAST(round_even(20000.0::DOUBLE * (end_s - start_s) / (SELECT sum(end_s - start_s) FROM segs), 0) AS BIGINT)) AS quota
FROM segs""", {"start_s": 6, "end_s": 6})
def livetime_quota(spark, d):
    return S.livetime_quota(v.plain_segments(spark, d), 20000)


@query("livetime_weighted_pick")
def livetime_weighted_pick(spark, d):
    draws = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("draw_id"))
    return S.livetime_weighted_pick(draws, v.plain_segments(spark, d), 4.0)


@query("fold_report", f"""WITH {THREE}, parts AS (
  SELECT 'fold_' || fold AS part, start_s, end_s FROM folded UNION ALL
  SELECT CASE WHEN fold = 1 THEN 'eval' ELSE 'train' END, start_s, end_s FROM folded UNION ALL
  SELECT split, start_s, end_s FROM three)
SELECT part, {SUMMARY} FROM parts GROUP BY 1""", SUMMARY_DIGITS)
def fold_report(spark, d):
    return reports.fold_report(v.plain_segments(spark, d), 1, 3)


# --- slides ---------------------------------------------------------------------------------


def standard_grid(spark, d):
    grid = v.score_grid(spark, d)
    return slides.standardise(grid, slides.norm_values(slides.sigma_norm(grid)))


def plan(coincident=0.0):
    return slides.SlidePlan(N_LAGS, STEP_S, coincident)


@query("sigma_norm", f"WITH {V2} SELECT avg(score_a) AS mu_a, stddev_pop(score_a) AS sd_a, avg(score_b) AS mu_b, stddev_pop(score_b) AS sd_b FROM grid",
       {"mu_a": 6, "sd_a": 6, "mu_b": 6, "sd_b": 6})
def sigma_norm(spark, d):
    return slides.sigma_norm(v.score_grid(spark, d))


@query("standardise", f"WITH {V2_STD} SELECT span_start, i, sigma_a, sigma_b FROM std", {"sigma_a": 6, "sigma_b": 6})
def standardise(spark, d):
    return standard_grid(spark, d).select("span_start", "i", "sigma_a", "sigma_b")


@query("net_sigma", f"WITH {V2_STD} SELECT span_start, i, (sigma_a + sigma_b) / sqrt(2) AS net_sigma FROM std", {"net_sigma": 6})
def net_sigma(spark, d):
    return standard_grid(spark, d).select("span_start", "i", X.net_sigma("sigma_a", "sigma_b").alias("net_sigma"))


@query("keep_above", f"WITH {V2_SLID} SELECT span_start, lag_index, i, j, net_sigma FROM triggers", {"net_sigma": 6})
def keep_above(spark, d):
    pairs = slides.time_slide(standard_grid(spark, d), plan(), STRIDE_S, HALF)
    pairs = pairs.withColumn("net_sigma", X.net_sigma("sigma_a", "sigma_b"))
    kept = slides.cluster_local_max(pairs, "net_sigma", HALF).filter(X.keep_above("net_sigma", NET_FLOOR))
    return kept.select("span_start", "lag_index", "i", "j", "net_sigma")


@query("time_slide", f"WITH {V2_SLID} SELECT span_start, lag_index, k, i, j, sigma_a, sigma_b FROM pairs", {"sigma_a": 6, "sigma_b": 6})
def time_slide(spark, d):
    return slides.time_slide(standard_grid(spark, d), plan(), STRIDE_S, HALF)


@query("cluster_local_max", f"WITH {V2_SLID} SELECT span_start, lag_index, i, net_sigma FROM clustered", {"net_sigma": 6})
def cluster_local_max(spark, d):
    pairs = slides.time_slide(standard_grid(spark, d), plan(), STRIDE_S, HALF)
    pairs = pairs.withColumn("net_sigma", X.net_sigma("sigma_a", "sigma_b"))
    kept = slides.cluster_local_max(pairs, "net_sigma", HALF, block=16)
    return kept.select("span_start", "lag_index", "i", "net_sigma")


@query("slide_triggers", f"WITH {V2_SLID} SELECT span_start, lag_index, k, i, j, sigma_a, sigma_b, net_sigma FROM triggers",
       {"sigma_a": 6, "sigma_b": 6, "net_sigma": 6})
def slide_triggers(spark, d):
    return slides.slide_triggers(standard_grid(spark, d), plan(), STRIDE_S, NET_FLOOR, HALF)


LADDER = f"""{V2}, sizes AS (SELECT span_start, count(*) AS n FROM grid GROUP BY 1),
  cap AS (SELECT least(2000, min(n) // 2 - 1) AS n_lags FROM sizes),
  ladder AS (SELECT CAST(idx AS INTEGER) AS lag_index, (CASE WHEN idx % 2 = 1 THEN 1 ELSE -1 END) * ((idx + 1) // 2) * 3600.0::DOUBLE AS lag_s
    FROM cap CROSS JOIN range(1, 2001) t(idx) WHERE idx <= n_lags)"""


def ladder(spark, d):
    live = slides.grid_livetime(v.score_grid(spark, d), STRIDE_S).first()
    n = slides.capped_lags(2000, live["min_n"], STEP_S, STRIDE_S)
    return slides.slide_plan(spark, n, STEP_S), live


@query("slide_plan", f"WITH {LADDER} SELECT lag_index, lag_s FROM ladder")
def slide_plan(spark, d):
    return ladder(spark, d)[0]


@query("distinct_pairings", f"WITH {LADDER} SELECT DISTINCT ((CAST(lag_s / 1800 AS BIGINT) % 48) + 48) % 48 AS shift FROM ladder")
def distinct_pairings(spark, d):
    lags, live = ladder(spark, d)
    return slides.distinct_pairings(lags, live["min_n"], STRIDE_S)


@query("slide_plan_summary", f"""WITH {LADDER}, t AS (SELECT count(*) * 1800.0::DOUBLE AS live FROM grid)
SELECT count(*) AS n_lags, min(abs(lag_s)) AS min_abs_lag_s, count(*) * any_value(live) AS background_livetime_s,
  count(*) * any_value(live) / (365.25 * 86400) AS background_livetime_yr FROM ladder CROSS JOIN t""", {"background_livetime_yr": 6})
def slide_plan_summary(spark, d):
    lags, live = ladder(spark, d)
    return slides.slide_plan_summary(lags, live["coincident_livetime_s"])


@query("selection", f"""WITH {V2_SLID} SELECT lag_index, count(*) AS n, max(net_sigma) AS loudest FROM pairs WHERE sigma_a > 0.5 GROUP BY 1""", {"loudest": 6})
def selection(spark, d):
    sel = slides.Selection(
        lambda df: df.filter("sigma_a > 0.5").withColumn("net_sigma", X.net_sigma("sigma_a", "sigma_b")), 4, "a is up"
    )
    out = slides.run_slides(standard_grid(spark, d), plan(), STRIDE_S, sel)
    return out.groupBy("lag_index").agg(F.count(F.lit(1)).alias("n"), F.max("net_sigma").alias("loudest"))


@query("run_slides", f"WITH {V2_SLID} SELECT lag_index, span_start, i, net_sigma FROM triggers", {"net_sigma": 6})
def run_slides(spark, d):
    def both(df):
        df = df.withColumn("net_sigma", X.net_sigma("sigma_a", "sigma_b"))
        return slides.cluster_local_max(df, "net_sigma", HALF).filter(X.keep_above("net_sigma", NET_FLOOR))

    out = slides.run_slides(standard_grid(spark, d), plan(), STRIDE_S, slides.Selection(both))
    return out.select("lag_index", "span_start", "i", "net_sigma")


@query("pairs_above", f"WITH {V2_SLID} SELECT span_start, lag_index, k, i, j FROM pairs WHERE net_sigma > 2.0")
def bounded_pairs(spark, d):
    parts = [(F.col(f"sigma_{c}") / math.sqrt(2.0)).alias(f"part_{c}") for c in "ab"]
    rows = standard_grid(spark, d).select("span_start", "n", "i", *parts, F.lit(NET_FLOOR).alias("need"))
    return pairs_above(rows, plan(), STRIDE_S, HALF, width=16).filter(F.col("lag_index") > 0)


@query("wanted_windows", f"""WITH {V2_SLID} SELECT span_start, 'a' AS channel, i AS idx FROM triggers UNION
SELECT span_start, 'b', j FROM triggers""")
def wanted_windows(spark, d):
    return slides.wanted_windows(slides.slide_triggers(standard_grid(spark, d), plan(), STRIDE_S, NET_FLOOR, HALF))


@query("trigger_lookup", f"""WITH {V2_SLID} SELECT t.span_start, t.lag_index, t.i, t.j, a.score_a, b.score_b FROM triggers t
JOIN grid a ON a.span_start = t.span_start AND a.i = t.i JOIN grid b ON b.span_start = t.span_start AND b.i = t.j""",
       {"score_a": 6, "score_b": 6})
def trigger_lookup(spark, d):
    grid = standard_grid(spark, d)
    found = slides.slide_triggers(grid, plan(), STRIDE_S, NET_FLOOR, HALF)
    return slides.trigger_lookup(found, grid, ["score_a"], ["score_b"]).select("span_start", "lag_index", "i", "j", "score_a", "score_b")


@query("far_curve", f"""WITH {V2_SLID}, live AS (SELECT count(*) * 1800.0::DOUBLE AS s FROM grid),
  yr AS (SELECT s * 23 / (365.25 * 86400) AS t FROM live),
  asked AS (SELECT CAST(f AS DOUBLE) AS far_per_yr, greatest(CAST(floor(f * t / 4) AS BIGINT), 1) AS n_allowed
    FROM yr CROSS JOIN (VALUES (100.0), (10.0), (1.0), (0.1)) x(f) WHERE f >= 4 / t),
  ranked AS (SELECT net_sigma, row_number() OVER (ORDER BY net_sigma DESC) AS rk, count(*) OVER () AS n FROM triggers)
SELECT 'general' AS channel, far_per_yr, n_allowed, n AS n_background, net_sigma AS threshold, n_allowed < n AS resolved
FROM asked JOIN ranked ON rk = least(n_allowed, n)""", {"threshold": 6})
def far_curve(spark, d):
    grid = v.score_grid(spark, d)
    return reports.far_curve(grid, STRIDE_S, 2000, STEP_S, v.CLUSTER_S, NET_FLOOR).thresholds()


@query("far_curve_totals", f"""WITH {V2_SLID}, live AS (SELECT count(*) * 1800.0::DOUBLE AS s FROM grid)
SELECT (SELECT count(*) FROM triggers) AS n_stored, (SELECT max(net_sigma) FROM triggers) AS loudest, 0.0::DOUBLE AS strict_fraction,
  23 AS n_lags, s AS coincident_livetime_s, s * 23 / (365.25 * 86400) AS background_livetime_yr,
  4 / (s * 23 / (365.25 * 86400)) AS floor_per_yr, (SELECT count(*) FROM clustered) AS n_clustered_triggers FROM live""",
       {"loudest": 6, "background_livetime_yr": 6, "floor_per_yr": 6})
def far_curve_totals(spark, d):
    grid = v.score_grid(spark, d)
    curve = reports.far_curve(grid, STRIDE_S, 2000, STEP_S, v.CLUSTER_S, NET_FLOOR)
    clustered = slides.count_clustered(slides.standardise(grid, curve.norm), curve.plan, STRIDE_S, curve.half)
    return curve.totals().crossJoin(clustered)


MATCHED = f"""{FOLDED}, {V2_SLID}, held AS (SELECT DISTINCT floor(start_s / 86400) * 86400 AS span_start
    FROM folded WHERE fold = 1),
  h AS (SELECT count(*) AS spans FROM held), bgr AS (SELECT net_sigma, row_number() OVER (ORDER BY net_sigma DESC) AS rk, count(*) OVER () AS n
    FROM clustered JOIN held USING (span_start)),
  yr AS (SELECT spans * 86400.0 * 23 / (365.25 * 86400) AS t FROM h),
  asked AS (SELECT CAST(f AS DOUBLE) AS far_per_yr, greatest(CAST(floor(f * t / 4) AS BIGINT), 1) AS k FROM yr CROSS JOIN (VALUES (100.0), (20.0)) x(f)),
  thr AS (SELECT far_per_yr, net_sigma AS threshold FROM asked JOIN bgr ON rk = least(k, n)),
  fg AS (SELECT *, (sigma_a + sigma_b) / sqrt(2) AS net_sigma, 1.0::DOUBLE AS w, 2.0 + i * 5 AS par FROM std)"""


def matched(spark, d):
    day = F.floor(F.col("start_s") / 86400) * 86400.0
    labelled = settle(folded(spark, d)).select("channel", day.alias("start_s"), (day + 86400.0).alias("end_s"), "fold").distinct()
    parts = folds.train_eval_labels(labelled, 1)
    grid = standard_grid(spark, d)
    spans = labelled.filter("fold = 1").select("start_s").distinct().count()
    root2 = math.sqrt(2.0)
    sel = slides.Selection(
        lambda df: df.withColumn("net_sigma", X.net_sigma("sigma_a", "sigma_b")), 4, "net", (F.col("sigma_a") / root2, F.col("sigma_b") / root2))
    injected = grid.withColumn("total_mass", 2.0 + F.col("i") * 5)
    return reports.matched_far_run(
        parts, sel, grid, plan(spans * 86400.0), STRIDE_S, injected, "net_sigma", 10.0, (100.0, 20.0), half=HALF)


@query("matched_far_run", f"""WITH {MATCHED} SELECT far_per_yr, threshold, count(*) AS n_total, count(*) FILTER (net_sigma >= threshold) AS n_found,
  count(*) FILTER (net_sigma >= threshold) / CAST(count(*) AS DOUBLE) AS efficiency, {wilson('count(*) FILTER (net_sigma >= threshold)', 'count(*)')}
FROM thr CROSS JOIN fg GROUP BY 1, 2""", {"threshold": 6, **ROUND})
def matched_far_run(spark, d):
    return matched(spark, d)["efficiency"]


@query("matched_far_volume", f"""WITH {MATCHED}, {volume_ctes('net_sigma')}
SELECT far_per_yr, n_injections, n_found, 10 * p AS v_sens_gpc3, 10 * sqrt(vv) AS v_sens_err_gpc3, pow(3e9 * 10 * p / (4 * pi()), 1.0 / 3) AS horizon_mpc FROM vol""",
       {"v_sens_gpc3": 6, "v_sens_err_gpc3": 6, "horizon_mpc": 4})
def matched_far_volume(spark, d):
    return matched(spark, d)["volume"].drop("threshold", "vt_gpc3_yr")


@query("matched_far_mass", f"""WITH {MATCHED}, m AS (SELECT par, net_sigma >= threshold AS found FROM fg CROSS JOIN thr WHERE far_per_yr = 100),
  {binned_sql(X.MASS_EDGES, 'm')}""", ROUND)
def matched_far_mass(spark, d):
    return matched(spark, d)["vs_mass"]


@query("matched_far_audit", f"""WITH {FOLDED} SELECT 'final' AS phase, 'eval' AS split, 'net' AS label, count(*) AS n_segments, 86400.0 * count(*) AS livetime,
  'matched_far_run' AS caller FROM (SELECT DISTINCT channel, floor(start_s / 86400) FROM folded WHERE fold = 1)""")
def matched_far_audit(spark, d):
    return matched(spark, d)["audit"].select("phase", "split", "label", "n_segments", "livetime", "caller")
