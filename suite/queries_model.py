"""Calibration, likelihood ratio, comoving volume and reports over the probability and feature views."""

from __future__ import annotations

from pyspark.sql import functions as F

from farspark.functions import expressions as X
from farspark.operators import calibration as cal
from farspark.operators import efficiency as eff
from farspark.operators import far as rates
from farspark.operators import folds, ranking, slides, volume
from farspark.operators.ordered import percentiles, union_all
from farspark.operators.settle import settle
from farspark.plans import reports
from suite import views as v
from suite.queries_far import ROUND, thresholds_sql, wilson
from suite.registry import query
from suite.views import GATED_A, GATED_B, LOGLR, TARGETS, TRIALS, V2, V3, V4, V6, YEARS


def is_signal():
    return F.col("y") == 1


BINS = "least(greatest(CAST(floor(p * 15 + 1e-9) AS INTEGER), 0), 14)"
CALIBRATED = f"{V4}, b AS (SELECT {BINS} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM prob GROUP BY 1)"


@query("apply_temperature", f"""WITH {V4} SELECT p, avg(1 / (1 + exp(-z / 1.7))) AS calibrated, count(*) AS n FROM prob GROUP BY 1""",
       {"p": 6, "calibrated": 6})
def apply_temperature(spark, d):
    rows = v.probabilities(spark, d).withColumn("calibrated", X.apply_temperature("z", 1.7))
    return rows.groupBy("p").agg(F.avg("calibrated").alias("calibrated"), F.count(F.lit(1)).alias("n"))


@query("ece", f"WITH {CALIBRATED} SELECT sum(n * abs(mean_p - mean_y)) / sum(n) AS ece FROM b", {"ece": 6})
def ece(spark, d):
    return cal.ece(v.probabilities(spark, d))


@query("reliability_curve", f"""WITH {CALIBRATED} SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, mean_y
FROM range(15) g(bin) LEFT JOIN b ON b.bin = g.bin""", {"mean_p": 6, "mean_y": 6})
def reliability_curve(spark, d):
    return cal.reliability_curve(v.probabilities(spark, d))


@query("fit_temperature")
def fit_temperature(spark, d):
    rows = v.probabilities(spark, d)
    t = cal.fit_temperature(rows)
    return rows.agg(F.lit(t).alias("temperature"), F.count(F.lit(1)).alias("n"))


@query("balanced_weights", f"""WITH {V4}, c AS (SELECT y, count(*) AS n FROM prob GROUP BY 1)
SELECT y, (SELECT sum(n) FROM c) / (2.0 * n) AS weight, n FROM c""", {"weight": 6})
def balanced_weights(spark, d):
    return cal.balanced_weights(v.probabilities(spark, d)).groupBy("y", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("score_summary", f"""WITH {V4} SELECT y, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n,
  quantile_cont(score, 0.99) AS p99 FROM prob GROUP BY 1""", {"mean": 4, "std": 4, "p99": 4})
def score_summary(spark, d):
    return cal.score_summary(v.probabilities(spark, d), "score", ["y"])


MOMENTS = """m AS (SELECT avg(score) FILTER (y = 0) AS nm, stddev_pop(score) FILTER (y = 0) AS ns, avg(score) FILTER (y = 1) AS sm,
    count(*) FILTER (y = 1) AS n_signal FROM prob)"""


def skewed(spark, d):
    """Scores with a tail, so that some signals lie above three sigma."""
    li = v.table(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_quantity") * (0.3 + F.col("l_discount")) * F.col("l_tax")).alias("score"), F.col("l_quantity").alias("par"),
    )


SKEWED = """prob AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    l_quantity * (0.3 + l_discount) * l_tax AS score, l_quantity AS par FROM lineitem)"""


@query("count_above_3sigma", f"""WITH {SKEWED}, {MOMENTS}, t AS (SELECT nm + 3 * ns AS threshold, n_signal, sm - nm AS separation,
    0.5 * (1 + tanh((sm - nm) / (ns + 1e-12))) AS tie_break FROM m),
  a AS (SELECT count(*) FILTER (y = 1 AND score > threshold) AS n_above FROM prob CROSS JOIN t)
SELECT threshold, n_above, n_signal, separation, tie_break, -(n_above + tie_break) AS selection_value FROM t CROSS JOIN a""",
       {"threshold": 6, "separation": 6, "tie_break": 6, "selection_value": 6})
def count_above_3sigma(spark, d):
    return cal.count_above_3sigma(skewed(spark, d), "score", is_signal())


CUTS = f"""{MOMENTS}, q AS (SELECT quantile_cont(score, 0.99) AS p99, quantile_cont(score, 0.999) AS p999 FROM prob WHERE y = 0),
  cut AS (SELECT '3sigma' AS threshold_name, nm + 3 * ns AS threshold FROM m UNION ALL SELECT 'noise_p99', p99 FROM q
    UNION ALL SELECT 'noise_p999', p999 FROM q)"""


@query("efficiency_at_quantile", f"""WITH {SKEWED}, {CUTS} SELECT threshold_name, threshold,
  avg(CASE WHEN score > threshold THEN 1.0 ELSE 0 END) FILTER (y = 1) AS efficiency,
  avg(CASE WHEN score <= threshold THEN 1.0 ELSE 0 END) FILTER (y = 0) AS noise_quantile FROM prob CROSS JOIN cut GROUP BY 1, 2""",
       {"threshold": 6, "efficiency": 6, "noise_quantile": 6})
def efficiency_at_quantile(spark, d):
    return cal.efficiency_at_quantile(skewed(spark, d), "score", is_signal())


Z_SHAPE = """s AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM prob)"""


@query("shape_stats", f"""WITH {SKEWED}, {Z_SHAPE} SELECT (quantile_cont(score, 0.5) - any_value(mu)) / any_value(sd) AS median,
  (quantile_cont(score, 0.99) - any_value(mu)) / any_value(sd) AS p99, (quantile_cont(score, 0.999) - any_value(mu)) / any_value(sd) AS p999,
  (max(score) - any_value(mu)) / any_value(sd) AS maximum, avg(pow((score - mu) / sd, 3)) AS skewness,
  avg(pow((score - mu) / sd, 4)) - 3 AS excess_kurtosis FROM prob CROSS JOIN s""",
       {"median": 6, "p99": 6, "p999": 6, "maximum": 6, "skewness": 6, "excess_kurtosis": 6})
def shape_stats(spark, d):
    return cal.shape_stats(skewed(spark, d), "score")


@query("spearman", """WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rx,
    row_number() OVER (ORDER BY o_custkey, o_orderkey) AS ry FROM orders) SELECT corr(rx, ry) AS spearman FROM r""", {"spearman": 6})
def spearman(spark, d):
    return cal.spearman(v.table(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey")


@query("separation", f"WITH {V4}, {MOMENTS} SELECT (sm - nm) / (ns + 1e-12) AS separation FROM m", {"separation": 6})
def separation(spark, d):
    return cal.separation(v.probabilities(spark, d), "score", is_signal())


@query("margin_loss", f"""WITH {V4}, {MOMENTS} SELECT nm AS noise, sm AS signal, greatest(0, 3 * nm - sm) AS margin,
  nm + 2 * greatest(0, 3 * nm - sm) AS total FROM m""", {"noise": 4, "signal": 4, "margin": 4, "total": 4})
def margin_loss(spark, d):
    return cal.margin_loss(v.probabilities(spark, d), "score", is_signal())


@query("ensemble_spread", """SELECT l_orderkey AS row_id, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS spread,
  count(*) AS n_members FROM lineitem GROUP BY 1""", {"mean": 6, "spread": 4})
def ensemble_spread(spark, d):
    li = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("score"))
    return cal.ensemble_spread(li, ["row_id"])


@query("matched_pairs", """WITH n AS (SELECT o_orderkey AS row_id, o_totalprice AS score FROM orders WHERE o_orderstatus <> 'F'),
  s AS (SELECT o_orderkey - 1 AS row_id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F')
SELECT row_id, n.score AS noise_score, s.score AS signal_score FROM n JOIN s USING (row_id)""", {"noise_score": 4, "signal_score": 4})
def matched_pairs(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    noise = o.filter("o_orderstatus <> 'F'").select("row_id", "score")
    signal = o.filter("o_orderstatus = 'F'").select((F.col("row_id") - 1).alias("row_id"), "score")
    return eff.matched_pairs(noise, signal)


# --- likelihood ratio -----------------------------------------------------------------------


@query("arm_gate", f"WITH {V6} SELECT {GATED_A} AS gate_a, {GATED_B} AS gate_b, count(*) AS n FROM feat GROUP BY 1, 2", {"gate_a": 6, "gate_b": 6})
def arm_gate(spark, d):
    f = v.ranked_features(spark, d)
    gates = f.select(X.arm_gate("arm_a", "sigma_a").alias("gate_a"), X.arm_gate("arm_b", "sigma_b").alias("gate_b"))
    return gates.groupBy("gate_a", "gate_b").agg(F.count(F.lit(1)).alias("n"))


@query("lr_features", f"""WITH {V6} SELECT fold, avg(sigma_a) AS sigma_a, avg(sigma_b) AS sigma_b, avg(coherence) AS coherence,
  avg(centroid_a) AS centroid_a, avg(centroid_b) AS centroid_b, avg({GATED_A}) AS gated_arm_a, avg({GATED_B}) AS gated_arm_b
FROM feat GROUP BY 1""", {n: 6 for n in X.FEATURES})
def lr_features(spark, d):
    f = v.ranked_features(spark, d).select("fold", *X.lr_features())
    return f.groupBy("fold").agg(*[F.avg(n).alias(n) for n in X.FEATURES])


def models(spark):
    norm = (300.0, 250.0, 310.0, 240.0)
    return {g: ranking.Model(g, v.MODEL_MU[g], v.MODEL_SD[g], v.MODEL_BETA[g], norm) for g in (0, 1)}


def scored(spark, d):
    return ranking.score_held_out(v.ranked_features(spark, d), ranking.load_models(ranking.models_frame(spark, models(spark).values())))


@query("log_likelihood_ratio", f"""WITH {V6}, s AS (SELECT label, {v._loglr(0)} AS loglr FROM feat)
SELECT label, count(*) AS n, avg(loglr) AS mean, min(loglr) AS low, max(loglr) AS high FROM s GROUP BY 1""",
       {"mean": 6, "low": 6, "high": 6})
def log_likelihood_ratio(spark, d):
    m = models(spark)[0]
    f = v.ranked_features(spark, d).withColumn("loglr", X.log_likelihood_ratio(X.lr_features(), m.mu, m.sd, m.beta))
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("loglr").alias("mean"), F.min("loglr").alias("low"), F.max("loglr").alias("high"))


@query("score_held_out", f"""WITH {V6}, s AS (SELECT fold, label, {LOGLR} AS loglr FROM feat)
SELECT fold, label, count(*) AS n, avg(loglr) AS mean, min(loglr) AS low, max(loglr) AS high FROM s GROUP BY 1, 2""",
       {"mean": 6, "low": 6, "high": 6})
def score_held_out(spark, d):
    return scored(spark, d).groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("loglr").alias("mean"), F.min("loglr").alias("low"), F.max("loglr").alias("high")
    )


@query("fold_sigma_norm", f"""WITH {V2}, f AS (SELECT span_start, CAST((row_number() OVER (ORDER BY span_start) - 1) % 2 AS INTEGER) AS fold
    FROM (SELECT DISTINCT span_start FROM grid))
SELECT fold, avg(score_a) AS mu_a, stddev_pop(score_a) AS sd_a, avg(score_b) AS mu_b, stddev_pop(score_b) AS sd_b
FROM grid JOIN f USING (span_start) GROUP BY 1""", {"mu_a": 6, "sd_a": 6, "mu_b": 6, "sd_b": 6})
def fold_sigma_norm(spark, d):
    grid = v.score_grid(spark, d)
    return slides.sigma_norm(ranking.fold_join(grid, folds.alternating_folds(grid)), ["fold"])


@query("fold_join", f"""WITH {V2}, f AS (SELECT span_start, CAST((row_number() OVER (ORDER BY span_start) - 1) % 2 AS INTEGER) AS fold
    FROM (SELECT DISTINCT span_start FROM grid))
SELECT span_start, fold, count(*) AS n FROM grid JOIN f USING (span_start) GROUP BY 1, 2""")
def fold_join(spark, d):
    grid = v.score_grid(spark, d)
    return ranking.fold_join(grid, folds.alternating_folds(grid)).groupBy("span_start", "fold").agg(F.count(F.lit(1)).alias("n"))


ROUNDED_MODEL = "list_transform({c}, lambda x: round(x, 4) + 0.0) AS {c}"
MODEL_COLUMNS = ", ".join(ROUNDED_MODEL.format(c=c) for c in ("mu", "sd", "beta"))


def model_rows(fitted, rows):
    """A fit as rows, beside the size of the table it came from."""
    spark = rows.sparkSession
    frame = ranking.models_frame(spark, fitted)
    rounded = [F.transform(c, lambda x: F.round(x, 4)).alias(c) for c in ("mu", "sd", "beta")]
    return frame.select("fold", *rounded).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_rows"))))


LABELLED = f"""lab AS (SELECT CAST(label AS INTEGER) AS label, sigma_a, sigma_b, coherence, centroid_a, centroid_b,
  {GATED_A} AS gated_arm_a, {GATED_B} AS gated_arm_b FROM feat)"""


@query("fit_lr", f"WITH {V6}, {LABELLED}, {v.newton_sql('lab', 'fitted')} SELECT CAST(0 AS INTEGER) AS fold, {MODEL_COLUMNS}, n_rows FROM fitted")
def fit_lr(spark, d):
    f = v.ranked_features(spark, d)
    rows = f.select(F.col("label").cast("int").alias("label"), *X.lr_features())
    return model_rows([ranking.fit_lr(rows)], rows)


BAND = reports.Band(v.FIRST_BIN, v.WINDOW_N, v.LAG_SAMPLES)


def fitted(spark, d):
    return reports.lr_fit(settle(v.feature_grid(spark, d)), v.feature_foreground(spark, d), v.STRIDE_S, BAND, 8, v.STEP_S, v.CLUSTER_S)


@query("fit_lr_two_fold", f"WITH {v.TWO_FOLD} SELECT fold, {MODEL_COLUMNS}, (SELECT count(*) FROM lineitem) AS n_rows FROM models")
def fit_lr_two_fold(spark, d):
    return model_rows(fitted(spark, d).models, v.feature_foreground(spark, d))


_HELD = "m.beta[1] + " + " + ".join(f"m.beta[{i + 2}] * ({f} - m.mu[{i + 1}]) / m.sd[{i + 1}]" for i, f in enumerate(
    ("sigma_a", "sigma_b", "coherence", "centroid_a", "centroid_b", f"({GATED_A})", f"({GATED_B})")))


@query("lr_fit", f"""WITH {v.TWO_FOLD}, held AS (SELECT i.* , folded.fold, (score_a - mu_a) / sd_a AS sigma_a, (score_b - mu_b) / sd_b AS sigma_b
    FROM injected i JOIN folded USING (span_start) JOIN fnorm ON fnorm.fold = 1 - folded.fold),
  s AS (SELECT held.fold, {_HELD} AS loglr FROM held JOIN models m ON m.fold = 1 - held.fold)
SELECT fold, quantile_cont(loglr, 0.5) AS median_loglr FROM s GROUP BY 1""", {"median_loglr": 5})
def lr_fit(spark, d):
    return fitted(spark, d).sanity


def ranked_background(spark, d, keep_above=-2.0):
    grid = settle(v.feature_grid(spark, d))
    assignment = folds.alternating_folds(grid)
    bg, plan = reports.lr_background(grid, assignment, models(spark), v.STRIDE_S, BAND, 23, v.STEP_S, v.CLUSTER_S, keep_above)
    return settle(bg), plan, assignment


@query("lr_background", f"""WITH {v.V7} SELECT lag_index, count(*) AS n, max(loglr) AS loudest, avg(loglr) AS mean, avg(coherence) AS coherence
FROM ranked_bg GROUP BY 1""", {"loudest": 6, "mean": 6, "coherence": 6})
def lr_background(spark, d):
    bg, _, _ = ranked_background(spark, d)
    return bg.groupBy("lag_index").agg(
        F.count(F.lit(1)).alias("n"), F.max("loglr").alias("loudest"), F.avg("loglr").alias("mean"), F.avg("coherence").alias("coherence"))


#: Thresholds of the ranked background: 23 lags of every span's day.
RANKED_THRESHOLDS = """yr AS (SELECT count(*) * 1800.0::DOUBLE * 23 / (365.25 * 86400) AS t FROM grid),
  asked AS (SELECT CAST(f AS DOUBLE) AS far_per_yr, greatest(CAST(floor(f * t / 4) AS BIGINT), 1) AS n_allowed
    FROM yr CROSS JOIN (VALUES (100.0), (30.0), (10.0)) x(f) WHERE f >= 4 / t),
  by_rank AS (SELECT loglr, row_number() OVER (ORDER BY loglr DESC) AS rk, count(*) OVER () AS n_background FROM ranked_bg),
  thr AS (SELECT far_per_yr, n_allowed, n_background, loglr AS threshold, n_allowed < n_background AS resolved
    FROM asked JOIN by_rank ON rk = least(n_allowed, n_background))"""


@query("lr_far", f"""WITH {v.V7}, {v.V7_FOREGROUND}, {RANKED_THRESHOLDS}
SELECT far_per_yr, threshold, count(*) AS n_total, count(*) FILTER (loglr > threshold) AS n_found,
  count(*) FILTER (loglr > threshold) / CAST(count(*) AS DOUBLE) AS efficiency, {wilson('count(*) FILTER (loglr > threshold)', 'count(*)')}
FROM scored_fg CROSS JOIN thr GROUP BY 1, 2""", {"threshold": 6, **ROUND})
def lr_far(spark, d):
    bg, plan, assignment = ranked_background(spark, d)
    fg = reports.score_foreground(v.feature_foreground(spark, d), assignment, models(spark))
    return reports.lr_far(bg, fg, plan.background_livetime_yr, (100.0, 30.0, 10.0))["efficiency"]


SCORED = f"{V6}, sc AS (SELECT fold, label, stat, {LOGLR} AS loglr FROM feat), rb AS (SELECT loglr AS stat FROM sc WHERE NOT label)"


@query("lr_efficiency", f"""WITH {SCORED}, {thresholds_sql('rb', by='')}
SELECT far_per_yr, threshold, count(*) AS n_total, count(*) FILTER (sc.loglr > threshold) AS n_found,
  count(*) FILTER (sc.loglr > threshold) / CAST(count(*) AS DOUBLE) AS efficiency, {wilson('count(*) FILTER (sc.loglr > threshold)', 'count(*)')}
FROM sc CROSS JOIN thr WHERE label GROUP BY 1, 2""", {"threshold": 6, **ROUND})
def lr_efficiency(spark, d):
    rows = scored(spark, d).withColumn("network_snr", F.col("sigma_a"))
    return reports.lr_far(rows.filter("NOT label"), rows.filter("label"), YEARS, TARGETS, TRIALS)["efficiency"]


META = """bm AS (SELECT CAST(o_orderkey AS VARCHAR) AS campaign_id, CASE WHEN o_orderstatus <> 'P' THEN 'ck-' || o_custkey % 2 END AS checkpoint,
    'm-' || o_orderkey % 3 AS model_id, o_custkey % 5 = 0 AS gate_applied FROM orders),
  fm AS (SELECT CAST(o_orderkey AS VARCHAR) AS campaign_id, CASE WHEN o_orderkey % 7 = 0 THEN 'ck-9' ELSE 'ck-' || o_custkey % 2 END AS f_checkpoint,
    CASE WHEN o_orderkey % 11 = 0 THEN 'm-9' ELSE 'm-' || o_orderkey % 3 END AS f_model,
    CASE WHEN o_orderkey % 17 <> 0 THEN (o_custkey % 5 = 0) <> (o_orderkey % 13 = 0) END AS f_gate FROM orders)"""


@query("provenance_match", f"""WITH {META}, j AS (SELECT bm.*, f_checkpoint, CASE WHEN coalesce(checkpoint <> f_checkpoint, FALSE) THEN
    'background and foreground come from different checkpoints' WHEN model_id <> f_model THEN 'background and foreground were ranked by different models'
    WHEN coalesce(gate_applied <> f_gate, FALSE) THEN 'the gate was applied to one side only' END AS problem FROM bm JOIN fm USING (campaign_id))
SELECT campaign_id, checkpoint, model_id, gate_applied, problem, CASE WHEN problem IS NOT NULL THEN 'mismatched'
  WHEN checkpoint IS NOT NULL AND f_checkpoint IS NOT NULL THEN 'verified' ELSE 'unverified' END AS provenance FROM j""")
def provenance_match(spark, d):
    o = v.table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ck, model = F.concat(F.lit("ck-"), cust % 2), F.concat(F.lit("m-"), key % 3)
    meta = o.select(key.cast("string").alias("campaign_id"), F.when(F.col("o_orderstatus") != "P", ck).alias("checkpoint"), model.alias("model_id"),
                    (cust % 5 == 0).alias("gate_applied"))
    other = o.select(
        key.cast("string").alias("campaign_id"), F.when(key % 7 == 0, "ck-9").otherwise(ck).alias("checkpoint"),
        F.when(key % 11 == 0, "m-9").otherwise(model).alias("model_id"),
        F.when(key % 17 != 0, (cust % 5 == 0) != (key % 13 == 0)).alias("gate_applied"))
    return ranking.provenance_status(meta, other)


def run_meta(spark, d, plan):
    """The metadata row of a stored ranked background, as wide as the grid it came from."""
    return v.score_grid(spark, d).agg(F.count(F.lit(1)).alias("n_points")).select(
        F.lit("all").alias("campaign_id"), F.lit("ck").alias("checkpoint"), F.lit("m").alias("model_id"), F.lit(False).alias("gate_applied"),
        F.lit(-2.0).alias("keep_above"), F.lit(plan.n_lags).alias("n_lags"),
        (F.col("n_points") * v.STRIDE_S * plan.n_lags / X.SECONDS_PER_YEAR).alias("background_livetime_yr"))


def rescored(spark, d):
    bg, plan, assignment = ranked_background(spark, d)
    meta = run_meta(spark, d, plan)
    return reports.lr_rescore(
        bg.select("loglr"), meta, v.feature_foreground(spark, d), meta, assignment, models(spark), -2.0, (100.0, 30.0, 10.0))


@query("lr_rescore", f"""WITH {v.V7}, {v.V7_FOREGROUND}, {RANKED_THRESHOLDS}
SELECT far_per_yr, threshold, count(*) FILTER (loglr >= threshold) AS n_above, 4 * count(*) FILTER (loglr >= threshold) / (SELECT t FROM yr) AS achieved_far_per_yr,
  'verified' AS provenance FROM ranked_bg CROSS JOIN thr GROUP BY 1, 2""", {"threshold": 6, "achieved_far_per_yr": 6})
def lr_rescore(spark, d):
    out = rescored(spark, d)
    return out["achieved"].crossJoin(F.broadcast(out["provenance"].select("provenance")))  # one campaign


# --- volume ---------------------------------------------------------------------------------

GRID_SQL = """zg AS (SELECT i, 1e-6 + i * ((3.0::DOUBLE - 1e-6) / 3999) AS z FROM range(4000) t(i)),
ie AS (SELECT *, 1 / sqrt(0.30966 * pow(1 + z, 3) + (1 - 0.30966::DOUBLE)) AS e,
  1 / sqrt(0.30966 * pow(1 + z - (3.0::DOUBLE - 1e-6) / 7998, 3) + (1 - 0.30966::DOUBLE)) AS em FROM zg),
dc AS (SELECT i, z, e, 299792.458::DOUBLE / 67.66 * sum(CASE WHEN i = 0 THEN 1e-6 * (1 + e) / 2
  ELSE (3.0::DOUBLE - 1e-6) / 3999 / 6 * (prev + 4 * em + e) END) OVER (ORDER BY i) AS d_c
  FROM (SELECT *, lag(e) OVER (ORDER BY i) AS prev FROM ie)),
dl AS (SELECT *, (1 + z) * d_c AS d_l FROM dc),
sl AS (SELECT *, (coalesce(lead(d_l) OVER w, d_l) - coalesce(lag(d_l) OVER w, d_l))
  / (CASE WHEN i IN (0, 3999) THEN 1 ELSE 2 END * ((3.0::DOUBLE - 1e-6) / 3999)) AS slope FROM dl WINDOW w AS (ORDER BY i)),
cg AS (SELECT z, d_l AS d_l_mpc, 299792.458::DOUBLE / 67.66 * d_c * d_c * e / (d_l * d_l * slope) / (1 + z) AS weight,
  lead(d_l) OVER (ORDER BY i) AS next_d, lead(z) OVER (ORDER BY i) AS next_z FROM sl),
cw AS (SELECT *, lead(weight) OVER (ORDER BY d_l_mpc) AS next_w FROM cg)"""
DISTANT = """far AS (SELECT DISTINCT l_quantity * 100 + l_linenumber AS distance_mpc FROM lineitem)"""


def distant(spark, d):
    li = v.table(spark, d, "lineitem")
    return li.select((F.col("l_quantity") * 100 + F.col("l_linenumber")).alias("distance_mpc")).distinct()


@query("comoving_weight", f"""WITH {GRID_SQL}, {DISTANT} SELECT distance_mpc,
  c.z + (distance_mpc - d_l_mpc) / (next_d - d_l_mpc) * (next_z - c.z) AS z,
  weight + (distance_mpc - d_l_mpc) / (next_d - d_l_mpc) * (next_w - weight) AS weight
FROM far JOIN cw c ON distance_mpc >= d_l_mpc AND distance_mpc < next_d""", {"z": 6, "weight": 6})
def comoving_weight(spark, d):
    return volume.comoving_weight(distant(spark, d))


@query("vt_facts", f"""WITH {GRID_SQL}, {DISTANT}, w AS (SELECT c.z + (distance_mpc - d_l_mpc) / (next_d - d_l_mpc) * (next_z - c.z) AS z,
    weight + (distance_mpc - d_l_mpc) / (next_d - d_l_mpc) * (next_w - weight) AS weight
    FROM far JOIN cw c ON distance_mpc >= d_l_mpc AND distance_mpc < next_d), n AS (SELECT count(*) AS n, count(*) + count(*) // 50 AS tried FROM far)
SELECT tried AS n_attempted, n AS n_kept, tried - n AS n_lost, z_max, weight_min, weight_max,
  'lost ' || (tried - n) || ' of ' || tried || ' attempted injections' AS warning
FROM (SELECT max(z) AS z_max, min(weight) AS weight_min, max(weight) AS weight_max FROM w) CROSS JOIN n""", {"z_max": 6, "weight_min": 6, "weight_max": 6})
def vt_facts(spark, d):
    far = distant(spark, d)
    n = far.count()
    return reports.vt_facts(far, n + n // 50)


@query("grid_interpolate", """WITH g AS (SELECT CAST(c_custkey AS DOUBLE) * 3 AS x0, max(c_acctbal) AS y0 FROM customer GROUP BY 1),
  n AS (SELECT *, lead(x0) OVER (ORDER BY x0) AS x1, lead(y0) OVER (ORDER BY x0) AS y1, min(x0) OVER () AS low, max(x0) OVER () AS high FROM g),
  q AS (SELECT DISTINCT o_custkey * 3.0::DOUBLE + o_orderkey % 7 - 3 AS x FROM orders)
SELECT x, CASE WHEN x < (SELECT min(x0) FROM g) THEN (SELECT arg_min(y0, x0) FROM g) WHEN x > (SELECT max(x0) FROM g) THEN NULL
  ELSE coalesce(y0 + (x - x0) / (x1 - x0) * (y1 - y0), y0) END AS y FROM q ASOF LEFT JOIN n ON q.x >= n.x0""", {"y": 4})
def grid_interpolate(spark, d):
    nodes = v.table(spark, d, "customer").select((F.col("c_custkey").cast("double") * 3).alias("x0"), F.col("c_acctbal").alias("y"))
    nodes = nodes.groupBy("x0").agg(F.max("y").alias("y"))
    x = v.table(spark, d, "orders").select((F.col("o_custkey") * 3.0 + F.col("o_orderkey") % 7 - 3).alias("x")).distinct()
    return volume.grid_interpolate(x, "x", nodes, "x0", ["y"], beyond="null")


VOLUMETRIC = f"""{V3}, {thresholds_sql(by='')}, vf AS (SELECT stat, par / 50 AS weight FROM fg),
  kk AS (SELECT far_per_yr, threshold, (SELECT count(*) FROM bg WHERE stat >= threshold) AS k, n_background AS n FROM thr),
  ends AS (SELECT far_per_yr, k, 'at' AS e, threshold AS cut FROM kk UNION ALL
    SELECT far_per_yr, k, 'tight', (SELECT v FROM ranked WHERE rk = greatest(1, CAST(round_even(k - sqrt(k), 0) AS BIGINT))) FROM kk UNION ALL
    SELECT far_per_yr, k, 'loose', (SELECT v FROM ranked WHERE rk = least(n, CAST(round_even(k + sqrt(k), 0) AS BIGINT))) FROM kk),
  vol AS (SELECT far_per_yr, k, e, count(*) FILTER (stat > cut) AS n_found, 4 / 3.0::DOUBLE * pi() * pow(5.0::DOUBLE, 3)
    * coalesce(sum(weight) FILTER (stat > cut), 0) / (SELECT count(*) + 100 FROM vf) AS vol,
    4 / 3.0::DOUBLE * pi() * pow(5.0::DOUBLE, 3) * count(*) FILTER (stat > cut) / (SELECT count(*) + 100 FROM vf) AS ve
    FROM vf CROSS JOIN ends GROUP BY 1, 2, 3)"""


def volumetric(spark, d):
    fg = v.foreground(spark, d).select("stat", (F.col("par") / 50).alias("weight"))
    return fg, fg.count() + 100


@query("comoving_volume", f"""WITH {VOLUMETRIC} SELECT far_per_yr, n_found, ve AS v_euclid_gpc3, vol AS v_comoving_gpc3 FROM vol WHERE e = 'at'""",
       {"v_euclid_gpc3": 6, "v_comoving_gpc3": 6})
def comoving_volume(spark, d):
    fg, attempted = volumetric(spark, d)
    thr = rates.thresholds_at_far(v.background(spark, d), "stat", YEARS, TARGETS, TRIALS)
    judged = rates.own_channel_threshold(fg, thr, "stat", [], inclusive=False)
    return volume.comoving_volume(judged, 5000.0, attempted, by=["far_per_yr"])


RANKED_VOLUME = """SELECT far_per_yr, k AS n_background_above, max(n_found) FILTER (e = 'at') AS n_found, max(ve) FILTER (e = 'at') AS v_euclid_gpc3,
  max(vol) FILTER (e = 'at') AS v_comoving_gpc3, min(vol) FILTER (e <> 'at') AS v_low_gpc3, max(vol) FILTER (e <> 'at') AS v_high_gpc3,
  1 / sqrt(greatest(max(n_found) FILTER (e = 'at'), 1)) AS rel_error_found, 1 / sqrt(greatest(k, 1)) AS rel_error_background
FROM vol GROUP BY 1, 2"""
VOL_DIGITS = {c: 6 for c in ("v_euclid_gpc3", "v_comoving_gpc3", "v_low_gpc3", "v_high_gpc3", "rel_error_found", "rel_error_background")}


@query("volume_rank_error", f"WITH {VOLUMETRIC} {RANKED_VOLUME}", VOL_DIGITS)
def volume_rank_error(spark, d):
    fg, attempted = volumetric(spark, d)
    bg = v.background(spark, d)
    thr = rates.thresholds_at_far(bg, "stat", YEARS, TARGETS, TRIALS)
    return volume.volume_rank_error(fg, bg, "stat", thr, 5000.0, attempted)


@query("volume_over_seeds", f"""WITH {VOLUMETRIC}, one AS ({RANKED_VOLUME})
SELECT far_per_yr, count(*) AS n_seeds, CAST(floor(avg(n_found)) AS BIGINT) AS n_found_mean,
  CAST(floor(avg(n_background_above)) AS BIGINT) AS n_background_above, avg(v_comoving_gpc3) AS v_comoving_mean, min(v_comoving_gpc3) AS v_comoving_min,
  max(v_comoving_gpc3) AS v_comoving_max, avg(v_low_gpc3) AS v_low_mean, avg(v_high_gpc3) AS v_high_mean, avg(v_euclid_gpc3) AS v_euclid_mean,
  avg(rel_error_found) AS rel_error_found, avg(rel_error_background) AS rel_error_background
FROM (SELECT * FROM one UNION ALL SELECT far_per_yr, n_background_above, n_found, v_euclid_gpc3, v_comoving_gpc3 * 2, v_low_gpc3, v_high_gpc3,
  rel_error_found, rel_error_background FROM one WHERE far_per_yr > 10) GROUP BY 1""",
       {c: 6 for c in ("v_comoving_mean", "v_comoving_min", "v_comoving_max", "v_low_mean", "v_high_mean", "v_euclid_mean", "rel_error_found", "rel_error_background")})
def volume_over_seeds(spark, d):
    one = volume_rank_error(spark, d)
    two = one.filter("far_per_yr > 10").withColumn("v_comoving_gpc3", F.col("v_comoving_gpc3") * 2)
    return reports.vt_report({"42": one, "43": two})


@query("vt_report")
def vt_report(spark, d):
    bg, plan, assignment = ranked_background(spark, d)
    fg = reports.score_foreground(v.feature_foreground(spark, d), assignment, models(spark))
    seed = reports.vt_seed(bg, fg, plan.background_livetime_yr, 5000.0, fg.count(), (100.0, 30.0))
    return reports.vt_report({"42": seed})


# --- reports --------------------------------------------------------------------------------


@query("gate_report", f"""WITH {V3}, t AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY stat DESC, hm, lm) AS rk FROM bg)
SELECT channel, count(*) AS n_gated, count(*) FILTER (NOT greatest(hm, lm) < 0.5) AS n_kept,
  count(*) FILTER (NOT greatest(hm, lm) < 0.5) / CAST(count(*) AS DOUBLE) AS kept_fraction, min(stat) AS floor
FROM t WHERE rk <= 300 GROUP BY 1""", {"kept_fraction": 6, "floor": 6})
def gate_report(spark, d):
    top = rates.top_k_per_channel(v.background(spark, d), "stat", 300, ties=["hm", "lm"])
    return eff.gate_kept(top.withColumn("kept", ~X.is_glitch("hm", "lm")), "stat")


#: Triggers of the feature grid: net sigma above 2, clustered, in their channel.
CHANNELLED = f"""{v.FGRID}, gn AS (SELECT avg(score_a) AS mu_a, stddev_pop(score_a) AS sd_a, avg(score_b) AS mu_b, stddev_pop(score_b) AS sd_b FROM fgrid),
  sgrid AS (SELECT fgrid.*, (score_a - mu_a) / sd_a AS sa, (score_b - mu_b) / sd_b AS sb FROM fgrid CROSS JOIN gn), {v.slid_sql('sgrid', 23)},
  netted AS (SELECT * FROM (SELECT *, (sigma_a + sigma_b) / sqrt(2) AS net_sigma FROM every) WHERE net_sigma > 2.0),
  trig AS (SELECT *, CASE WHEN centroid_a < {X.CENTROID_CUT_HZ!r} AND centroid_b < {X.CENTROID_CUT_HZ!r} AND coherence >= {X.COHERENCE_CUT!r} THEN 'strict'
    ELSE 'general' END AS channel FROM (SELECT *, max(net_sigma) OVER (PARTITION BY span_start, lag_index ORDER BY i
    RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS best FROM netted) WHERE net_sigma >= best)"""


def channelled_curve(spark, d):
    grid = settle(v.feature_grid(spark, d))
    return grid, reports.far_curve(grid, v.STRIDE_S, 23, v.STEP_S, v.CLUSTER_S, v.NET_FLOOR, band=BAND)


@query("far_curve_channels", f"""WITH {CHANNELLED} SELECT channel, lag_index, count(*) AS n, max(net_sigma) AS loudest, avg(coherence) AS coherence
FROM trig GROUP BY 1, 2""", {"loudest": 6, "coherence": 6})
def far_curve_channels(spark, d):
    _, curve = channelled_curve(spark, d)
    return curve.triggers.groupBy("channel", "lag_index").agg(
        F.count(F.lit(1)).alias("n"), F.max("net_sigma").alias("loudest"), F.avg("coherence").alias("coherence"))


@query("far_curve_channel_thresholds", f"""WITH {CHANNELLED}, yr AS (SELECT count(*) * 1800.0::DOUBLE * 23 / (365.25 * 86400) AS t FROM grid),
  asked AS (SELECT CAST(f AS DOUBLE) AS far_per_yr, greatest(CAST(floor(f * t / 4) AS BIGINT), 1) AS n_allowed
    FROM yr CROSS JOIN (VALUES (100.0), (10.0), (1.0), (0.1)) x(f) WHERE f >= 4 / t),
  ranked AS (SELECT channel, net_sigma, row_number() OVER w AS rk, count(*) OVER (PARTITION BY channel) AS n FROM trig WINDOW w AS (PARTITION BY channel ORDER BY net_sigma DESC))
SELECT channel, far_per_yr, n_allowed, n AS n_background, net_sigma AS threshold, n_allowed < n AS resolved FROM asked JOIN ranked ON rk = least(n_allowed, n)""",
       {"threshold": 6})
def far_curve_channel_thresholds(spark, d):
    return channelled_curve(spark, d)[1].thresholds()


@query("gate_slides", f"""WITH {CHANNELLED}, top AS (SELECT *, greatest(1 / (1 + exp((centroid_a - 110) / 5)), 1 / (1 + exp((centroid_b - 110) / 5))) >= 0.5 AS kept
    FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY net_sigma DESC, span_start, lag_index, i) AS rk FROM trig) WHERE rk <= 500)
SELECT channel, count(*) AS n_gated, count(*) FILTER (kept) AS n_kept, count(*) FILTER (kept) / CAST(count(*) AS DOUBLE) AS kept_fraction, min(net_sigma) AS floor
FROM top GROUP BY 1""", {"kept_fraction": 6, "floor": 6})
def gate_slides(spark, d):
    grid, curve = channelled_curve(spark, d)
    windows = union_all([
        grid.select("span_start", F.lit(c).alias("channel"), F.col("i").alias("idx"), F.col(f"centroid_{c}").alias("centroid")) for c in "ab"
    ])

    def score(pairs):
        rate = lambda c: 1.0 / (1.0 + F.exp((F.col(c) - 110.0) / 5.0))
        return pairs.withColumn("hm", rate("centroid_a")).withColumn("lm", rate("centroid_b"))

    triggers = curve.triggers.drop("centroid_a", "centroid_b")
    return reports.gate_report(triggers, windows, ["centroid"], 500, score)["summary"]


TRACKED = " UNION ALL ".join(
    f"SELECT '{s}' AS score, '{p}' AS property, corr(r_{s}, r_{p}) AS spearman FROM r"
    for s in ("first", "second") for p in ("tile_mean", "tile_std", "tile_fraction")
)


@query("front_end_report", f"""WITH u AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[2] AS DOUBLE) AS second,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings WHERE label % 2 <> 1),
  p AS (SELECT vec_id, any_value(first) AS first, any_value(second) AS second, avg(x) AS tile_mean, stddev_pop(x) AS tile_std,
    avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0 END) AS tile_fraction FROM u GROUP BY 1),
  r AS (SELECT {', '.join(f'row_number() OVER (ORDER BY {c}, vec_id) AS r_{c}' for c in ('first', 'second', 'tile_mean', 'tile_std', 'tile_fraction'))} FROM p)
{TRACKED}""", {"spearman": 6})
def front_end_report(spark, d):
    return front_end(spark, d)["properties"]


FRONT = """fe AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[2] AS DOUBLE) AS second, label % 2 = 1 AS signal FROM embeddings),
  noise AS (SELECT * FROM fe WHERE NOT signal)"""
_OF = lambda template: " UNION ALL ".join(template.format(s=s) for s in ("first", "second"))


@query("front_end_agreement", f"""WITH {FRONT} SELECT corr(a, b) AS spearman FROM (SELECT row_number() OVER (ORDER BY first, vec_id) AS a,
  row_number() OVER (ORDER BY second, vec_id) AS b FROM noise)""", {"spearman": 6})
def front_end_agreement(spark, d):
    return front_end(spark, d)["agreement"]


@query("front_end_shape", f"""WITH {FRONT}, {_OF("m_{s} AS (SELECT avg({s}) AS mu, stddev_pop({s}) AS sd FROM noise)").replace(" UNION ALL ", ", ")}
{_OF("""SELECT '{s}' AS score, (quantile_cont({s}, 0.5) - any_value(mu)) / any_value(sd) AS median, (quantile_cont({s}, 0.99) - any_value(mu)) / any_value(sd) AS p99,
  (quantile_cont({s}, 0.999) - any_value(mu)) / any_value(sd) AS p999, (max({s}) - any_value(mu)) / any_value(sd) AS maximum,
  avg(pow(({s} - mu) / sd, 3)) AS skewness, avg(pow(({s} - mu) / sd, 4)) - 3 AS excess_kurtosis FROM noise CROSS JOIN m_{s}""")}""",
       {"median": 6, "p99": 6, "p999": 6, "maximum": 6, "skewness": 6, "excess_kurtosis": 6})
def front_end_shape(spark, d):
    return front_end(spark, d)["shape"]


@query("front_end_efficiency", f"""WITH {FRONT}, cut AS ({_OF("""SELECT '{s}' AS score, '3sigma' AS threshold_name, avg({s}) + 3 * stddev_pop({s}) AS threshold FROM noise
  UNION ALL SELECT '{s}', 'noise_p99', quantile_cont({s}, 0.99) FROM noise UNION ALL SELECT '{s}', 'noise_p999', quantile_cont({s}, 0.999) FROM noise""")}),
  x AS ({_OF("SELECT '{s}' AS score, {s} AS value, signal FROM fe")})
SELECT score, threshold_name, threshold, avg(CASE WHEN value > threshold THEN 1.0 ELSE 0 END) FILTER (signal) AS efficiency,
  avg(CASE WHEN value <= threshold THEN 1.0 ELSE 0 END) FILTER (NOT signal) AS noise_quantile FROM x JOIN cut USING (score) GROUP BY 1, 2, 3""",
       {"threshold": 6, "efficiency": 6, "noise_quantile": 6})
def front_end_efficiency(spark, d):
    return front_end(spark, d)["efficiency"]


def front_end(spark, d):
    e = v.table(spark, d, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("data"), (F.col("label") % 2).alias("y"),
        F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", 2).cast("double").alias("second"),
    )
    return reports.front_end_report(rows, "first", "second", "row_id", F.col("y") == 1)


@query("percentiles", f"WITH {V3} SELECT channel, quantile_cont(stat, 0.1) AS p10, quantile_cont(stat, 0.5) AS p50, quantile_cont(stat, 0.999) AS p999 FROM camp GROUP BY 1",
       {"p10": 6, "p50": 6, "p999": 6})
def percentile_query(spark, d):
    return percentiles(v.campaign(spark, d), "stat", {"p10": 0.1, "p50": 0.5, "p999": 0.999}, ["channel"])
