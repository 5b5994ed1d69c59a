"""The library's inputs as views over the test tables, for Spark and as SQL text for the comparison engine."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farspark.operators.settle import folder

STRIDE_S = 1800.0
STEP_S = 3600.0
N_LAGS = 23
CLUSTER_S = 3600.0
HALF = 1
NET_FLOOR = 2.0
YEARS = 10.0
TRIALS = 4
TARGETS = (100.0, 30.0, 10.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A fresh folder for round trips through files, in the storage the session shares with its executors."""
    return f"{folder(spark)}/scratch-{uuid.uuid4().hex}"


def _us() -> Column:
    # Between two zoneless timestamps, so the session's time zone does not matter.
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")


# --- V1: segments ---------------------------------------------------------------------------

V1 = """segs AS (
  SELECT event_type AS channel, epoch_us(ts) // 21600000000 AS blk, min(epoch_us(ts)) / 1e6 AS start_s,
         max(epoch_us(ts)) / 1e6 AS end_s
  FROM events GROUP BY 1, 2 HAVING max(epoch_us(ts)) > min(epoch_us(ts)))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), _us().alias("us"))
    s = e.groupBy("channel", F.expr("us div 21600000000").alias("blk")).agg(F.min("us").alias("a"), F.max("us").alias("b"))
    s = s.filter(F.col("b") > F.col("a"))
    return s.select("channel", "blk", (F.col("a") / 1e6).alias("start_s"), (F.col("b") / 1e6).alias("end_s"))


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per event with the channel and block of its segment."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), _us().alias("us")).select(
        "channel", F.expr("us div 21600000000").alias("blk"))


def plain_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("channel", "start_s", "end_s")


# --- V2: score grid -------------------------------------------------------------------------

V2 = """cells AS (
  SELECT epoch_us(ts) // 86400000000 AS d, (epoch_us(ts) % 86400000000) // 1800000000 AS i,
         sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS a,
         sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS b
  FROM events GROUP BY 1, 2),
grid AS (
  SELECT CAST(d.d AS DOUBLE) * 86400 AS span_start, g.i, coalesce(c.a, 0.0) AS score_a, coalesce(c.b, 0.0) AS score_b
  FROM (SELECT DISTINCT d FROM cells) d CROSS JOIN (SELECT unnest(range(48)) AS i) g
  LEFT JOIN cells c ON c.d = d.d AND c.i = g.i)"""

V2_STD = V2 + """,
norm AS (SELECT avg(score_a) AS mu_a, stddev_pop(score_a) AS sd_a, avg(score_b) AS mu_b, stddev_pop(score_b) AS sd_b FROM grid),
std AS (SELECT g.*, (score_a - mu_a) / sd_a AS sigma_a, (score_b - mu_b) / sd_b AS sigma_b FROM grid g CROSS JOIN norm)"""

V2_SLID = V2_STD + """,
lags AS (SELECT idx AS lag_index, (CASE WHEN idx % 2 = 1 THEN 1 ELSE -1 END) * ((idx + 1) // 2) * 2 AS k FROM range(1, 24) t(idx)),
pairs AS (
  SELECT a.span_start, l.lag_index, l.k, a.i, b.i AS j, a.sigma_a, b.sigma_b, (a.sigma_a + b.sigma_b) / sqrt(2) AS net_sigma
  FROM std a CROSS JOIN lags l JOIN std b ON b.span_start = a.span_start AND b.i = (((a.i - l.k) % 48) + 48) % 48),
clustered AS (
  SELECT * FROM (SELECT *, max(net_sigma) OVER (PARTITION BY span_start, lag_index ORDER BY i
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS best FROM pairs) WHERE net_sigma >= best),
triggers AS (SELECT * FROM clustered WHERE net_sigma > 2.0)"""


def score_grid(spark: SparkSession, sf_dir: str, stride_s: float = STRIDE_S) -> DataFrame:
    """Day spans of equal bins; score_a and score_b are the summed values of two event types."""
    n = int(86400 / stride_s)
    e = table(spark, sf_dir, "events").select("event_type", "value", _us().alias("us"))
    e = e.filter(F.col("event_type").isNotNull())
    cell = e.groupBy(
        F.expr("us div 86400000000").alias("d"), F.expr(f"(us % 86400000000) div {int(stride_s * 1_000_000)}L").alias("i")
    ).agg(*[
        F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)).alias(s)
        for t, s in (("click", "score_a"), ("view", "score_b"))
    ])
    days = e.select(F.expr("us div 86400000000").alias("d")).distinct()
    full = days.select("d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("i"))
    out = full.join(cell, ["d", "i"], "left").na.fill(0.0, ["score_a", "score_b"])
    return out.select((F.col("d") * 86400.0).alias("span_start"), "i", F.lit(n).cast("bigint").alias("n"), "score_a", "score_b")


# --- V3: campaign ---------------------------------------------------------------------------

V3 = """camp AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'background' ELSE 'foreground' END AS kind,
         CASE WHEN l_linestatus = 'O' THEN 'strict' ELSE 'general' END AS channel,
         l_extendedprice / 1000 AS stat, l_extendedprice / 1000 * (1 - l_discount) AS stat2, l_quantity AS par,
         1 - l_discount AS w, l_linenumber AS seed, l_discount * 10 AS hm, l_tax * 12.5 AS lm
  FROM lineitem),
bg AS (SELECT * FROM camp WHERE kind = 'background'), fg AS (SELECT * FROM camp WHERE kind = 'foreground')"""


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "R", "background").otherwise("foreground").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "strict").otherwise("general").alias("channel"),
        (F.col("l_extendedprice") / 1000).alias("stat"),
        (F.col("l_extendedprice") / 1000 * (1 - F.col("l_discount"))).alias("stat2"), F.col("l_quantity").alias("par"),
        (1 - F.col("l_discount")).alias("w"), F.col("l_linenumber").alias("seed"), (F.col("l_discount") * 10).alias("hm"),
        (F.col("l_tax") * 12.5).alias("lm"),
    )


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign(spark, sf_dir).filter(F.col("kind") == "background")


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign(spark, sf_dir).filter(F.col("kind") == "foreground")


# --- V4: probabilities ----------------------------------------------------------------------

V4 = """prob AS (
  SELECT l_quantity / 51 AS p, ln((l_quantity / 51) / (1 - l_quantity / 51)) AS z,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS score, l_quantity AS par
  FROM lineitem)"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = F.col("l_quantity") / 51
    return li.select(
        p.alias("p"), F.log(p / (1 - p)).alias("z"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("par"),
    )


# --- V5: series pairs -----------------------------------------------------------------------

V5 = """sp AS (
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS xa, CAST(b.embedding AS DOUBLE[]) AS xb, a.label
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def series_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")
    a = d.select("vec_id", F.col("x").alias("xa"), "label")
    return a.join(d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("xb")), "vec_id")


# --- V6: ranked features --------------------------------------------------------------------

V6 = """feat AS (
  SELECT l_quantity / 10 AS sigma_a, l_discount * 50 AS sigma_b, l_tax AS coherence, 100 + 4 * l_quantity AS centroid_a,
         CAST(100 + 25 * l_linenumber AS DOUBLE) AS centroid_b, CAST(l_linenumber AS DOUBLE) - 4 AS arm_a,
         l_quantity / 10 - 3 AS arm_b, CAST(l_orderkey % 2 AS INTEGER) AS fold, l_returnflag <> 'R' AS label,
         l_extendedprice / 1000 AS stat
  FROM lineitem)"""


def ranked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return li.select(
        (q / 10).alias("sigma_a"), (F.col("l_discount") * 50).alias("sigma_b"), F.col("l_tax").alias("coherence"),
        (100 + 4 * q).alias("centroid_a"), (100 + 25 * F.col("l_linenumber")).cast("double").alias("centroid_b"),
        (F.col("l_linenumber").cast("double") - 4).alias("arm_a"), (q / 10 - 3).alias("arm_b"),
        (F.col("l_orderkey") % 2).cast("int").alias("fold"), (F.col("l_returnflag") != "R").alias("label"),
        (F.col("l_extendedprice") / 1000).alias("stat"),
    )


# Two folds' models on the scale of the ranked features.
MODEL_MU = ((2.5, 2.5, 0.04, 200.0, 185.0, 0.1, 0.2), (2.6, 2.4, 0.045, 205.0, 180.0, 0.0, 0.1))
MODEL_SD = ((1.4, 1.6, 0.03, 58.0, 50.0, 1.5, 1.2), (1.5, 1.5, 0.025, 60.0, 52.0, 1.6, 1.1))
MODEL_BETA = ((0.1, 0.8, 0.6, 0.3, -0.2, -0.1, 0.4, 0.5), (-0.1, 0.7, 0.5, 0.4, -0.3, 0.1, 0.3, 0.6))

_CLIP = "least(greatest({g}, -6.0), 6.0) * least(greatest({s} / 3.0, 0.0), 1.0)"
GATED_A = _CLIP.format(g="arm_a", s="sigma_a")
GATED_B = _CLIP.format(g="arm_b", s="sigma_b")
_NAMES = ("sigma_a", "sigma_b", "coherence", "centroid_a", "centroid_b", f"({GATED_A})", f"({GATED_B})")


def _loglr(m: int) -> str:
    terms = [
        f"({c} - {MODEL_MU[m][i]!r}) / {MODEL_SD[m][i]!r} * {MODEL_BETA[m][i + 1]!r}" for i, c in enumerate(_NAMES)
    ]
    return f"{MODEL_BETA[m][0]!r} + " + " + ".join(terms)


LOGLR = f"CASE WHEN fold = 0 THEN {_loglr(1)} ELSE {_loglr(0)} END"


# --- grid with features: V2 joined to the embeddings as stored coefficients -----------------


def feature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score grid with per-channel coefficients (an embedding's halves), centroids and arms."""
    g = score_grid(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    half = lambda first: F.transform(F.slice("embedding", first, 32), lambda x: x.cast("double"))
    vec = e.select("vec_id", half(1).alias("re"), half(33).alias("im"))
    count = e.agg(F.max("vec_id").alias("_top"))  # one row
    point = F.col("span_start") / F.lit(STRIDE_S) + F.col("i")
    g = g.crossJoin(F.broadcast(count)).withColumn("_p", F.pmod(point.cast("bigint"), F.col("_top"))).drop("_top")
    for c, shift in (("a", 0), ("b", 1)):
        side = vec.select(
            (F.col("vec_id") - shift).alias("_p"), F.col("re").alias(f"re_{c}"), F.col("im").alias(f"im_{c}"),
            (100.0 + 90.0 * F.abs(F.element_at("re", 1))).alias(f"centroid_{c}"), F.element_at("im", 1).alias(f"arm_{c}"),
        )
        g = g.join(side, "_p")
    return g.drop("_p")


FIRST_BIN, WINDOW_N, LAG_SAMPLES = 4, 256, 8


def feature_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected rows derived from lineitem, each placed in one of the grid's spans."""
    li = table(spark, sf_dir, "lineitem")
    first = table(spark, sf_dir, "events").select(_us().alias("us")).agg(F.min(F.expr("us div 86400000000")).alias("_d0"))
    q = F.col("l_quantity")
    return li.crossJoin(F.broadcast(first)).select(
        ((F.col("_d0") + F.col("l_orderkey") % 30) * 86400.0).alias("span_start"), (300.0 + 12.0 * q).alias("score_a"),
        (300.0 + 6000.0 * F.col("l_discount")).alias("score_b"), (F.col("l_tax") + 0.1).alias("coherence"),
        (100 + 4 * q).cast("double").alias("centroid_a"), (100 + 25 * F.col("l_linenumber")).cast("double").alias("centroid_b"),
        (F.col("l_linenumber").cast("double") - 3.0).alias("arm_a"), (q / 10 - 3).alias("arm_b"),
        (6.0 + q * 0.6).alias("network_snr"), (F.col("l_extendedprice") / 25.0 + 10.0).alias("distance_mpc"),
    )


_EMB = "CAST(embedding AS DOUBLE[])"
FGRID = f"""{V2},
emb AS (SELECT vec_id, {_EMB}[1:32] AS re, {_EMB}[33:64] AS im FROM embeddings),
folded AS (SELECT span_start, CAST((row_number() OVER (ORDER BY span_start) - 1) % 2 AS INTEGER) AS fold FROM (SELECT DISTINCT span_start FROM grid)),
fgrid AS (SELECT g.span_start, g.i, f.fold, g.score_a, g.score_b, a.re AS re_a, a.im AS im_a, b.re AS re_b, b.im AS im_b,
  100 + 90 * abs(a.re[1]) AS ca, 100 + 90 * abs(b.re[1]) AS cb, a.im[1] AS ga, b.im[1] AS gb,
  list_dot_product(a.re, a.re) + list_dot_product(a.im, a.im) AS ea, list_dot_product(b.re, b.re) + list_dot_product(b.im, b.im) AS eb
  FROM grid g JOIN folded f USING (span_start)
  JOIN emb a ON a.vec_id = CAST(g.span_start / {STRIDE_S} + g.i AS BIGINT) % (SELECT max(vec_id) FROM embeddings)
  JOIN emb b ON b.vec_id = a.vec_id + 1),
turns AS (SELECT t, list_transform(range(32), lambda f: cos(2 * pi() * (f + {FIRST_BIN}) * t / {WINDOW_N})) AS c,
  list_transform(range(32), lambda f: sin(2 * pi() * (f + {FIRST_BIN}) * t / {WINDOW_N})) AS s FROM range(-{LAG_SAMPLES}, {LAG_SAMPLES} + 1) r(t))"""


def slid_sql(grid: str, n_lags: int) -> str:
    """CTE `every`: the features of every slid pair of `grid`, which has sa and sb beside the columns of fgrid."""
    return f"""slid AS (SELECT a.span_start, a.fold, l.lag_index, a.i, b.i AS j, a.sa AS sigma_a, b.sb AS sigma_b, a.ca AS centroid_a, b.cb AS centroid_b, a.ga AS arm_a,
  b.gb AS arm_b, a.ea + b.eb AS energy, list_transform(list_zip(a.re_a, a.im_a, b.re_b, b.im_b), lambda z: z[1] * z[3] + z[2] * z[4]) AS zr,
  list_transform(list_zip(a.re_a, a.im_a, b.re_b, b.im_b), lambda z: z[2] * z[3] - z[1] * z[4]) AS zi
  FROM {grid} a CROSS JOIN (SELECT idx AS lag_index, (CASE WHEN idx % 2 = 1 THEN 1 ELSE -1 END) * ((idx + 1) // 2) * 2 AS k FROM range(1, {n_lags + 1}) t(idx)) l
  JOIN {grid} b ON b.span_start = a.span_start AND b.i = (((a.i - l.k) % 48) + 48) % 48),
coh AS (SELECT span_start, lag_index, i, max(abs(list_dot_product(zr, c) - list_dot_product(zi, s))) AS top FROM slid CROSS JOIN turns GROUP BY 1, 2, 3),
every AS (SELECT slid.* EXCLUDE (zr, zi), 4.0 / {WINDOW_N} * top / (2.0 / {WINDOW_N} * energy + 1e-30) AS coherence FROM slid JOIN coh USING (span_start, lag_index, i))"""


_NEAR = "PARTITION BY span_start, lag_index ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING"

#: Every slid pair's coherence and ratio, cut and clustered: what a ranked background must equal.
V7 = f"""{FGRID}, sgrid AS (SELECT *, (score_a - 300) / 250 AS sa, (score_b - 310) / 240 AS sb FROM fgrid), {slid_sql('sgrid', 23)},
loud AS (SELECT * FROM (SELECT *, {LOGLR} AS loglr FROM every) WHERE loglr > -2.0),
ranked_bg AS (SELECT * FROM (SELECT *, max(loglr) OVER ({_NEAR}) AS best FROM loud) WHERE loglr >= best)"""

#: The injected rows of `feature_foreground`, scored by the other fold's model.
INJECTED = """injected AS (SELECT ((SELECT min(epoch_us(ts) // 86400000000) FROM events) + l_orderkey % 30) * 86400.0 AS span_start,
  300 + 12 * l_quantity AS score_a, 300 + 6000 * l_discount AS score_b, l_tax + 0.1 AS coherence,
  100 + 4 * l_quantity AS centroid_a, CAST(100 + 25 * l_linenumber AS DOUBLE) AS centroid_b, CAST(l_linenumber AS DOUBLE) - 3 AS arm_a, l_quantity / 10 - 3 AS arm_b,
  6 + l_quantity * 0.6 AS network_snr, l_extendedprice / 25 + 10 AS distance_mpc FROM lineitem)"""
V7_FOREGROUND = f"""{INJECTED}, inj AS (SELECT *, (score_a - 300) / 250 AS sigma_a, (score_b - 310) / 240 AS sigma_b FROM injected),
scored_fg AS (SELECT *, {LOGLR} AS loglr FROM inj JOIN folded USING (span_start))"""


# --- a fit in SQL ----------------------------------------------------------------------------

FEATURE_NAMES = ("sigma_a", "sigma_b", "coherence", "centroid_a", "centroid_b", "gated_arm_a", "gated_arm_b")


def newton_sql(rows: str, name: str, steps: int = 19) -> str:
    """CTE `<name>` (mu, sd, beta, n_rows) of a balanced logistic regression on `rows` (label 0 or 1, the features), by unrolled Newton steps.

    Each step adds up gradient and second derivatives and solves the eight equations by elimination. The coefficient of coherence is
    held at its bound, zero; where its gradient then points inwards the bound is not active and the coefficients come out NULL.
    """
    size = len(FEATURE_NAMES) + 1
    wide, held = size + 1, FEATURE_NAMES.index("coherence") + 1
    moments = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) + 1e-9 AS s{i}" for i, f in enumerate(FEATURE_NAMES))
    x = ", ".join(["1.0::DOUBLE AS x0", *(f"({f} - m{i}) / s{i} AS x{i + 1}" for i, f in enumerate(FEATURE_NAMES))])
    margin = " + ".join(f"b[{i + 1}] * x{i}" for i in range(size))
    out = [
        f"{rows}_m AS (SELECT count(*) AS n, sum(label) AS n1, {moments} FROM {rows})",
        f"""{rows}_z AS (SELECT CAST(label AS DOUBLE) AS y, CASE WHEN label = 1 THEN n / (2.0::DOUBLE * n1) ELSE n / (2.0::DOUBLE * (n - n1)) END AS w, {x}
  FROM {rows} CROSS JOIN {rows}_m)""",
        f"{name}_b0 AS (SELECT [{', '.join(['0.0::DOUBLE'] * size)}] AS b)",
    ]
    for k in range(1, steps + 1):
        cells = []
        for i in range(size):
            ridge = "0.002" if i else "0.0"
            for j in range(size):
                if held in (i, j):
                    cells.append("1.0::DOUBLE" if i == j else "0.0::DOUBLE")
                else:
                    cells.append(f"sum(h * x{i} * x{j})" + (f" + {ridge}" if i == j else ""))
            cells.append("0.0::DOUBLE" if i == held else f"-(sum(g * x{i}) + {ridge} * any_value(b)[{i + 1}])")
        out.append(f"""{name}_e{k}_0 AS (SELECT any_value(b) AS b, [{', '.join(cells)}] AS m, sum(g * x{held}) AS pull
  FROM (SELECT *, w * (p - y) AS g, w * p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM {rows}_z CROSS JOIN {name}_b{k - 1})))""")
        for pivot in range(size):
            row = f"m[{pivot * wide + 1} + t % {wide}] / m[{pivot * wide + pivot + 1}]"
            out.append(f"""{name}_e{k}_{pivot + 1} AS (SELECT b, pull, list_transform(range({size * wide}), lambda t: CASE WHEN t // {wide} = {pivot} THEN {row}
  ELSE m[t + 1] - m[(t // {wide}) * {wide} + {pivot + 1}] * {row} END) AS m FROM {name}_e{k}_{pivot})""")
        out.append(f"{name}_b{k} AS (SELECT list_transform(range({size}), lambda t: b[t + 1] + m[t * {wide} + {wide}]) AS b, pull FROM {name}_e{k}_{size})")
    mu, sd = (", ".join(f"{c}{i}" for i in range(len(FEATURE_NAMES))) for c in "ms")
    out.append(f"""{name} AS (SELECT [{mu}] AS mu, [{sd}] AS sd, CASE WHEN pull >= 0 THEN b END AS beta, n AS n_rows
  FROM {name}_b{steps} CROSS JOIN {rows}_m)""")
    return ", ".join(out)


_PER_FOLD = ("sigma_a", "sigma_b", "coherence", "centroid_a", "centroid_b", f"{GATED_A} AS gated_arm_a", f"{GATED_B} AS gated_arm_b")

#: Two models, each on noise pairs of its own fold's spans (8 lags, net sigma above 0, clustered) and the rows injected there.
TWO_FOLD = f"""{FGRID}, {INJECTED},
fnorm AS (SELECT fold, avg(score_a) AS mu_a, stddev_pop(score_a) AS sd_a, avg(score_b) AS mu_b, stddev_pop(score_b) AS sd_b FROM fgrid GROUP BY 1),
ngrid AS (SELECT g.*, (score_a - mu_a) / sd_a AS sa, (score_b - mu_b) / sd_b AS sb FROM fgrid g JOIN fnorm USING (fold)), {slid_sql('ngrid', 8)},
net AS (SELECT * FROM (SELECT *, (sigma_a + sigma_b) / sqrt(2) AS net FROM every) WHERE net > 0),
noise AS (SELECT * FROM (SELECT *, max(net) OVER ({_NEAR}) AS best FROM net) WHERE net >= best),
own AS (SELECT i.*, fold, (score_a - mu_a) / sd_a AS sigma_a, (score_b - mu_b) / sd_b AS sigma_b FROM injected i JOIN folded USING (span_start) JOIN fnorm USING (fold)),
{", ".join(f"rows{g} AS (SELECT 0 AS label, {', '.join(_PER_FOLD)} FROM noise WHERE fold = {g} UNION ALL SELECT 1, {', '.join(_PER_FOLD)} FROM own WHERE fold = {g})" for g in (0, 1))},
{newton_sql('rows0', 'model0')}, {newton_sql('rows1', 'model1')},
models AS (SELECT CAST(0 AS INTEGER) AS fold, * EXCLUDE (n_rows) FROM model0 UNION ALL SELECT CAST(1 AS INTEGER), * EXCLUDE (n_rows) FROM model1)"""
