"""Time slides: one channel's grid shifted against the other's, clustered and cut.

Grid rows are (span_start, i, n, score_a, score_b, ...): i counts from 0 in a span of n points. Lag k pairs
row i of channel a with row (i - k) mod n of channel b of the same span.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from farspark.errors import RefusedError
from farspark.functions.expressions import SECONDS_PER_YEAR, keep_above, net_sigma

MIN_LAG_S = 1.0
CLUSTER_BLOCK = 1 << 16


@dataclass(frozen=True)
class SlidePlan:
    """A ladder of lags +step, -step, +2 step, ..., and the coincident livetime each one buys.

    With `per_span` a span takes only the lags it can tell apart, and `slid_livetime_s` is the sum over spans and their lags.
    """

    n_lags: int
    step_s: float = 4.0
    coincident_livetime_s: float = 0.0
    include_zero: bool = False
    per_span: bool = False
    slid_livetime_s: float | None = None

    def __post_init__(self):
        if self.step_s < MIN_LAG_S:
            raise ValueError(
                f"lags of {self.step_s} s could still pair a wave with itself; the step starts at {MIN_LAG_S} s"
            )

    @property
    def background_livetime_s(self) -> float:
        return self.n_lags * self.coincident_livetime_s if self.slid_livetime_s is None else self.slid_livetime_s

    @property
    def background_livetime_yr(self) -> float:
        return self.background_livetime_s / SECONDS_PER_YEAR

    def lag_of(self, index) -> Column:
        """Lag in seconds of a 1-based ladder position; position 0 is zero lag."""
        return F.ceil(index / 2).cast("double") * F.when(index % 2 == 1, 1.0).otherwise(-1.0) * self.step_s

    def ladder(self) -> Column:
        """The lags as one array expression, so sliding is an `explode`, not a join."""
        first = 0 if self.include_zero else 1
        if first > self.n_lags:
            return F.array().cast("array<struct<lag_index:int,lag_s:double>>")
        return F.transform(
            F.sequence(F.lit(first), F.lit(self.n_lags)),
            lambda i: F.struct(i.alias("lag_index"), self.lag_of(i).alias("lag_s")),
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.explode(self.ladder()).alias("l")).select("l.lag_index", "l.lag_s")


def slide_plan(spark: SparkSession, n_lags: int, step_s: float = 4.0, include_zero: bool = False) -> DataFrame:
    return SlidePlan(n_lags, step_s, include_zero=include_zero).frame(spark)


def slide_plan_summary(lags: DataFrame, coincident_livetime_s) -> DataFrame:
    """Lag count, smallest non-zero lag and the background livetime; zero lag is foreground and buys none."""
    live = coincident_livetime_s if isinstance(coincident_livetime_s, Column) else F.lit(float(coincident_livetime_s))
    moved = F.when(F.col("lag_s") != 0, F.abs("lag_s"))
    return lags.agg(
        F.count(F.lit(1)).alias("n_lags"), F.min(moved).alias("min_abs_lag_s"), F.count(moved).alias("_moved"),
    ).select(
        "n_lags", "min_abs_lag_s", (F.col("_moved") * live).alias("background_livetime_s"),
        (F.col("_moved") * live / SECONDS_PER_YEAR).alias("background_livetime_yr"),
    )


def lag_points(lag_s, stride_s: float) -> Column:
    return F.rint(lag_s / F.lit(float(stride_s))).cast("bigint")


def distinct_pairings(lags: DataFrame, n: int, stride_s: float) -> DataFrame:
    """The pairings a span of n points can tell apart: lags repeat modulo n."""
    return lags.select(F.pmod(lag_points(F.col("lag_s"), stride_s), F.lit(n)).alias("shift")).distinct()


def capped_lags(n_lags: int, min_n: int, step_s: float, stride_s: float) -> int:
    """Lag count beyond which the ladder wraps onto itself in the shortest span."""
    step = max(1, round(step_s / stride_s))
    return max(0, min(n_lags, min_n // step - 1))


def span_lags(n_lags: int, step_s: float, stride_s: float) -> Column:
    """`capped_lags` of each span, by its points `n`."""
    step = max(1, round(step_s / stride_s))
    return F.greatest(F.lit(0), F.least(F.lit(n_lags), F.floor(F.col("n") / step) - 1)).cast("bigint")


def capped_plan(grid: DataFrame, n_lags: int, step_s: float, stride_s: float, half: int = 0) -> SlidePlan:
    """A plan in which a short span has few lags and takes none from the others; a span no longer than a cluster has none."""
    spans = grid.groupBy("span_start").agg(F.count(F.lit(1)).alias("n"))
    lags = F.when(F.col("n") > 2 * half, span_lags(n_lags, step_s, stride_s)).otherwise(F.lit(0))
    row = spans.select("n", lags.alias("lags")).agg(
        F.sum("n").alias("points"), F.max("lags").alias("most"), F.sum(F.col("n") * F.col("lags")).alias("slid")).first()
    if not row["points"]:
        raise RefusedError("the grid is empty")
    return SlidePlan(int(row["most"]), step_s, row["points"] * float(stride_s), per_span=True, slid_livetime_s=row["slid"] * float(stride_s))


def cluster_half(cluster_s: float, stride_s: float) -> int:
    return int(round(0.5 * cluster_s / stride_s))


# --- normalisation --------------------------------------------------------------------------


def sigma_norm(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per channel over all spans, or per fold."""
    return grid.groupBy(*by).agg(
        F.avg("score_a").alias("mu_a"), F.stddev_pop("score_a").alias("sd_a"),
        F.avg("score_b").alias("mu_b"), F.stddev_pop("score_b").alias("sd_b"),
    )


def norm_values(norm: DataFrame) -> dict[str, float]:
    """The one-row norm as numbers, so every later scan standardises by exactly the same bits."""
    row = norm.first()
    return {k: row[k] for k in ("mu_a", "sd_a", "mu_b", "sd_b")}


def standardise(df: DataFrame, norm: dict[str, float]) -> DataFrame:
    """Add sigma_a and sigma_b. Foreground takes the background's norm; it is never refitted."""
    for c in "ab":
        df = df.withColumn(f"sigma_{c}", (F.col(f"score_{c}") - F.lit(norm[f"mu_{c}"])) / F.lit(norm[f"sd_{c}"]))
    return df


def grid_livetime(grid: DataFrame, stride_s: float) -> DataFrame:
    """Points, coincident seconds (points times stride) and the shortest span."""
    spans = grid.groupBy("span_start").agg(F.count(F.lit(1)).alias("n"))
    return spans.agg(
        F.sum("n").alias("n_points"), (F.sum("n") * F.lit(float(stride_s))).alias("coincident_livetime_s"),
        F.min("n").alias("min_n"), F.count(F.lit(1)).alias("n_spans"),
    )


def with_span_size(grid: DataFrame) -> DataFrame:
    """Add n, the points in the row's span; counted by aggregation so a long span is not one task's window.

    Lags wrap around a span, so its points must be numbered 0 to n - 1: a gap or a repeated point stops the query.
    """
    spans = grid.groupBy("span_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("i").alias("_least"), F.max("i").alias("_most"), F.sum("i").alias("_sum")
    )
    dense = (F.col("_least") == 0) & (F.col("_most") == F.col("n") - 1) & (F.col("_sum") * 2 == F.col("n") * (F.col("n") - 1))
    broken = F.raise_error(F.lit("points of a span are not numbered from 0 on without gaps")).cast("bigint")
    spans = spans.select("span_start", F.when(dense, F.col("n")).otherwise(broken).alias("n"))
    return grid.drop("n").join(spans, "span_start")


# --- pairing --------------------------------------------------------------------------------


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows about to be multiplied by the lag count are first dealt out evenly; a fixed number keeps them so."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _explode_lags(side: DataFrame, plan: SlidePlan, stride_s: float, half: int) -> DataFrame:
    k = lag_points(F.col("l.lag_s"), stride_s)
    slid = side.select("*", F.explode(plan.ladder()).alias("l"))
    slid = slid.select(*side.columns, F.col("l.lag_index").alias("lag_index"), k.alias("k"))
    if plan.per_span:
        slid = slid.filter(F.col("lag_index") <= span_lags(plan.n_lags, plan.step_s, stride_s))
    return slid.filter((F.col("n") > F.abs("k")) & (F.col("n") > 2 * half))


def time_slide(
    grid: DataFrame, plan: SlidePlan, stride_s: float, half: int = 0, a_cols=("sigma_a",), b_cols=("sigma_b",)
) -> DataFrame:
    """Every pair of every lag: (span_start, lag_index, k, i, j, a_cols, b_cols). Keep the columns few."""
    a = _explode_lags(_spread(grid.select("span_start", "n", "i", *a_cols), "span_start", "i"), plan, stride_s, half)
    a = a.withColumn("j", F.pmod(F.col("i") - F.col("k"), F.col("n")))
    b = grid.select("span_start", F.col("i").alias("j"), *b_cols)
    return a.join(b, ["span_start", "j"]).select("span_start", "lag_index", "k", "i", "j", *a_cols, *b_cols)


def slide_above(grid: DataFrame, plan: SlidePlan, stride_s: float, floor: float, half: int = 0) -> DataFrame:
    """The pairs of all lags whose net sigma exceeds `floor`, without making the others.

    A sum above c needs one term above c/2. So loud rows of a meet all of b, and loud rows of b meet the quiet
    rows of a; quiet pairs, nearly all of them, are never formed. Exact: the final filter is the definition.
    """
    cut = floor / math.sqrt(2.0)
    cut -= 1e-9 * (1.0 + abs(cut))
    a = grid.select("span_start", "n", "i", "sigma_a")
    b = grid.select("span_start", "n", F.col("i").alias("j"), "sigma_b")
    loud_a = _explode_lags(_spread(a.filter(F.col("sigma_a") > cut), "span_start", "i"), plan, stride_s, half)
    loud_a = loud_a.withColumn("j", F.pmod(F.col("i") - F.col("k"), F.col("n"))).drop("n")
    loud_b = _explode_lags(_spread(b.filter(F.col("sigma_b") > cut), "span_start", "j"), plan, stride_s, half)
    loud_b = loud_b.withColumn("i", F.pmod(F.col("j") + F.col("k"), F.col("n"))).drop("n")
    first = loud_a.join(b.drop("n"), ["span_start", "j"])
    second = loud_b.join(a.filter(F.col("sigma_a") <= cut).drop("n"), ["span_start", "i"])
    pairs = first.unionByName(second).withColumn("net_sigma", net_sigma("sigma_a", "sigma_b"))
    return pairs.filter(keep_above("net_sigma", floor)).select(
        "span_start", "lag_index", "k", "i", "j", "sigma_a", "sigma_b", "net_sigma"
    )


def cluster_local_max(
    df: DataFrame, stat: str, half: int, by: Sequence[str] = ("span_start", "lag_index"), order: str = "i",
    block: int = CLUSTER_BLOCK,
) -> DataFrame:
    """Keep rows that no row within `half` positions beats; ties all stay, and order does not wrap.

    A row whose statistic is NaN or NULL neither stays nor beats another, as if a floor had removed it.

    The frame is by value, so rows a floor removed leave gaps, not shifts: cutting first gives the same result.
    Long spans are windowed in blocks of positions, with the rows near an edge copied to the next block.
    """
    if half <= 0:
        return df
    block = max(block, half)
    home = F.floor(F.col(order) / block)
    touched = F.array_distinct(
        F.array(F.floor((F.col(order) - half) / block), home, F.floor((F.col(order) + half) / block))
    )
    number = F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double"))
    copies = df.filter(number).select("*", F.explode(touched).alias("_block"))
    w = W.partitionBy(*by, "_block").orderBy(F.col(order).cast("bigint")).rangeBetween(-half, half)
    best = copies.withColumn("_max", F.max(stat).over(w))
    return best.filter((F.col(stat) >= F.col("_max")) & (F.col("_block") == home)).drop("_block", "_max")


def slide_triggers(grid: DataFrame, plan: SlidePlan, stride_s: float, floor: float, half: int) -> DataFrame:
    """Clustered joint excursions above the floor over all lags."""
    return cluster_local_max(slide_above(grid, plan, stride_s, floor, half), "net_sigma", half)


def count_clustered(grid: DataFrame, plan: SlidePlan, stride_s: float, half: int) -> DataFrame:
    """How many clustered pairs there are with no floor at all; this one does form every pair."""
    pairs = time_slide(grid, plan, stride_s, half).withColumn("net_sigma", net_sigma("sigma_a", "sigma_b"))
    return cluster_local_max(pairs, "net_sigma", half).agg(F.count(F.lit(1)).alias("n_clustered_triggers"))


def trigger_lookup(triggers: DataFrame, grid: DataFrame, a_cols: Sequence[str], b_cols: Sequence[str]) -> DataFrame:
    """Fetch wide columns for surviving triggers only: channel a at i, channel b at j."""
    a = grid.select("span_start", "i", *a_cols)
    b = grid.select("span_start", F.col("i").alias("j"), *b_cols)
    return triggers.join(a, ["span_start", "i"]).join(b, ["span_start", "j"])


def wanted_windows(triggers: DataFrame) -> DataFrame:
    """The distinct windows a set of triggers needs: pairs repeat windows, windows should be worked on once."""
    a = triggers.select("span_start", F.lit("a").alias("channel"), F.col("i").alias("idx"))
    b = triggers.select("span_start", F.lit("b").alias("channel"), F.col("j").alias("idx"))
    return a.unionByName(b).distinct()


def window_lookup(triggers: DataFrame, windows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring per-window results back to the pairs, as <column>_a and <column>_b."""
    for side, position in (("a", "i"), ("b", "j")):
        mine = windows.filter(F.col("channel") == side).select(
            "span_start", F.col("idx").alias(position), *[F.col(c).alias(f"{c}_{side}") for c in columns]
        )
        triggers = triggers.join(mine, ["span_start", position], "left")
    return triggers


# --- user hooks -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    """A complete selection as one DataFrame transform, applied to background and foreground alike.

    `parts` are two expressions, over a row of channel a and over one of channel b, whose sum the statistic of a pair never
    exceeds. With them the loudest pairs are found without forming the others; a row may then be kept or dropped for its own
    values and for louder rows only.
    """

    transform: Callable[[DataFrame], DataFrame]
    trials: int = 4
    name: str = ""
    parts: tuple[Column, Column] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df)


def run_slides(
    grid: DataFrame, plan: SlidePlan, stride_s: float, selection: Callable[[DataFrame], DataFrame], half: int = 0,
    a_cols=("sigma_a",), b_cols=("sigma_b",),
) -> DataFrame:
    """The selection applied to every lag of the plan in one job, with the lag kept beside each result.

    A plan that includes zero lag yields its rows too, at lag_index 0; they add no livetime.
    """
    slid = selection(time_slide(grid, plan, stride_s, half, a_cols, b_cols))
    if "lag_index" not in slid.columns:
        raise RefusedError("the selection dropped lag_index, so its results cannot be tied to the plan's livetime")
    return slid
