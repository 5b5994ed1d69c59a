"""Time-grouped folds, the splits inside them, who may read what, and the trail of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.errors import AnalysisException

from farspark.errors import FoldLeakError
from farspark.operators.ordered import Cells, ordinal, running
from farspark.operators.segments import duration, numbered_starts
from farspark.operators.settle import settle

# Which phase may read which split.
PERMISSIONS = {
    "sealed": (),
    "training": ("train", "hpo_train", "hpo_val"),
    "hpo": ("hpo_train", "hpo_val"),
    "calibration": ("train", "hpo_train", "hpo_val", "hpo_bg"),
    "final": ("eval", "train"),
}
SPLITS = ("train", "hpo_train", "hpo_val", "hpo_bg", "eval")

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("t", T.DoubleType()),
        T.StructField("phase", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("trial", T.IntegerType()),
        T.StructField("n_segments", T.LongType()),
        T.StructField("livetime", T.DoubleType()),
        T.StructField("caller", T.StringType()),
    ]
)


def permission_table(spark: SparkSession) -> DataFrame:
    rows = [(p, s) for p, splits in PERMISSIONS.items() for s in splits]
    return spark.createDataFrame(rows, "phase string, split string")


def phase_permission(requests: DataFrame) -> DataFrame:
    """Add `allowed` to rows of (phase, split)."""
    table = permission_table(requests.sparkSession).withColumn("allowed", F.lit(True))  # 11 rows
    return requests.join(F.broadcast(table), ["phase", "split"], "left").withColumn(
        "allowed", F.coalesce("allowed", F.lit(False))
    )


# --- folds ----------------------------------------------------------------------------------


def gps_grouped_folds(segments: DataFrame, n_folds: int = 2, cells: Cells | None = None) -> DataFrame:
    """Add `fold`: contiguous in time, about equal livetime, whole overlap blocks only.

    A block opens the next fold once the livetime before it has reached that fold's share, one fold at a time,
    and must do so when only as many blocks as folds are left. With `c` the shares reached before block g, which never
    fall, the fold is the least of c and of `c' + g - g'` over the last block g' of every smaller c', raised to
    `g + n_folds - blocks` at the end; so a row per value of c is all that has to be known of the other blocks.
    """
    if n_folds < 2:
        raise ValueError(f"n_folds must be at least 2, got {n_folds}")
    starts = numbered_starts(segments, cells)
    total = starts.agg(F.coalesce(F.sum("opens"), F.lit(0)).alias("blocks"), F.sum("live").alias("live")).first()
    if total["blocks"] < n_folds:
        raise ValueError(f"{total['blocks']} independent blocks of time cannot fill {n_folds} folds")
    share = total["live"] / n_folds
    reached = F.lit(0)
    for k in range(1, n_folds):
        reached = reached + (F.col("live_before") >= F.lit(share * k)).cast("int")
    starts = starts.select("start_s", "grp", reached.cast("bigint").alias("_c"))
    last = {r["_c"]: r["g"] for r in starts.groupBy("_c").agg(F.max("grp").alias("g")).collect()}  # at most n_folds rows
    stepped = F.col("_c")
    for c, g in last.items():
        stepped = F.least(stepped, F.when(F.col("_c") > c, F.lit(c - g) + F.col("grp")).otherwise(F.col("_c")))
    fold = F.greatest(stepped, F.col("grp") + n_folds - total["blocks"])
    return segments.join(starts.select("start_s", fold.cast("int").alias("fold")), "start_s").select(*segments.columns, "fold")


def fold_spans(folded: DataFrame) -> DataFrame:
    return folded.groupBy("fold").agg(
        F.min("start_s").alias("span_start"), F.max("end_s").alias("span_end"), F.count(F.lit(1)).alias("n_segments"),
        F.sum(duration()).alias("livetime_s"),
    )


def fold_overlaps(folded: DataFrame) -> DataFrame:
    """Neighbouring folds that share time (one row per fold, so the window is as small as the fold count)."""
    w = W.partitionBy(F.lit(0)).orderBy("fold")
    spans = fold_spans(folded).withColumn("previous_end", F.lag("span_end").over(w))
    return spans.filter(F.col("span_start") < F.col("previous_end")).select("fold", "span_start", "previous_end")


def assert_disjoint_folds(folded: DataFrame) -> DataFrame:
    bad = fold_overlaps(folded).first()
    if bad is not None:
        raise FoldLeakError(
            f"folds {bad['fold'] - 1} and {bad['fold']} overlap in time: {bad['span_start']:.0f} is before "
            f"{bad['previous_end']:.0f}"
        )
    return folded


def train_eval_labels(folded: DataFrame, eval_fold: int) -> DataFrame:
    return folded.withColumn("split", F.when(F.col("fold") == eval_fold, "eval").otherwise("train"))


def alternating_folds(spans: DataFrame, start: str = "span_start", n_folds: int = 2) -> DataFrame:
    """Span number i in time order goes to fold i mod n_folds."""
    distinct = spans.select(start).distinct()
    numbered = ordinal(distinct, [start], Cells.fit(distinct, start))
    return numbered.select(start, (F.col("ordinal") % n_folds).cast("int").alias("fold"))


def three_way_split(
    training: DataFrame, val_frac: float = 0.20, bg_frac: float = 0.30, unit: str = "block", cells: Cells | None = None
) -> DataFrame:
    """Cut training segments in time order into hpo_train, hpo_val and hpo_bg by livetime.

    Cuts fall between overlap blocks, so two channels of one stretch of time stay together; `unit="segment"`
    cuts between segments instead.
    """
    shares = {"hpo_train": round(1.0 - val_frac - bg_frac, 12), "hpo_val": val_frac, "hpo_bg": bg_frac}
    wrong = [name for name, share in shares.items() if share < 0 or (share == 0 and name != "hpo_bg")]
    if wrong:
        raise ValueError(f"no such split of the livetime: {shares}; check {', '.join(wrong)}")
    cells = cells or Cells.fit(training, "start_s")
    if unit == "block":
        units, keys = numbered_starts(training, cells), ["start_s"]
        one = F.col("opens")
    else:
        keys = ["start_s", "end_s", "channel"]
        live = training.select(*keys, duration().alias("live"), F.lit(1).cast("bigint").alias("_one"))
        units = settle(running(live, keys, {"grp": ("sum", "_one", False), "live_before": ("sum", "live", False)}, cells).na.fill(0))
        one = F.col("_one")
    fit_frac = shares["hpo_train"]
    total = units.agg(F.sum("live").alias("live"), F.sum(one).alias("n")).first()
    if (total["n"] or 0) < 3:
        raise ValueError(f"{total['n'] or 0} blocks of training time cannot fill three splits")
    below = lambda cut: F.sum(F.when(F.col("live_before") < F.lit(cut), one).otherwise(0))
    at = units.agg(
        below(total["live"] * fit_frac).alias("fit"), below(total["live"] * (fit_frac + val_frac)).alias("val")
    ).first()
    first = min(max(at["fit"], 1), total["n"] - 2)
    second = min(max(at["val"], first + 1), total["n"] - 1)
    split = F.when(F.col("grp") < first, "hpo_train").when(F.col("grp") < second, "hpo_val").otherwise("hpo_bg")
    return training.join(units.select(*keys, split.alias("split")), keys).select(*training.columns, "split")


def split_partition_check(parts: DataFrame, whole: DataFrame, keys=("channel", "start_s", "end_s")) -> DataFrame:
    """Counts that are all zero when the splits are disjoint and together are the whole."""
    keys = list(keys)
    union = parts.select(*keys, "split").distinct()
    shared = union.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        count(shared, "in_two_splits")
        .crossJoin(count(whole.select(*keys).exceptAll(parts.select(*keys)), "missing"))
        .crossJoin(count(parts.select(*keys).exceptAll(whole.select(*keys)), "extra"))
    )


def span_set_equality(a: DataFrame, b: DataFrame, key: str = "span_start") -> DataFrame:
    """How many spans only one side holds, matched by whole microseconds rather than by float equality."""
    micros = lambda df: df.select(F.rint(F.col(key) * 1e6).cast("bigint").alias("us")).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(micros(a).exceptAll(micros(b)), "only_in_a").crossJoin(
        count(micros(b).exceptAll(micros(a)), "only_in_b")
    )


def fold_summary(folded: DataFrame, by: str = "fold") -> DataFrame:
    """Segments, livetime and bounds per fold or per split."""
    return folded.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(duration()).alias("livetime_s"),
        F.min("start_s").alias("span_start"), F.max("end_s").alias("span_end"),
    )


# --- audit ----------------------------------------------------------------------------------


def append_audit(audit: DataFrame, path: str) -> None:
    audit.select(*AUDIT_SCHEMA.fieldNames()).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(AUDIT_SCHEMA).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)


def audit_offenders(audit: DataFrame) -> DataFrame:
    """Reads of the evaluation fold outside the final report."""
    return audit.filter((F.col("split") == "eval") & (F.col("phase") != "final"))


def assert_eval_untouched(audit: DataFrame) -> None:
    bad = audit_offenders(audit).limit(5).collect()
    if bad:
        raise FoldLeakError("the trail shows early reads of eval: " + "; ".join(f"{r.label} in {r.phase} by {r.caller}" for r in bad))


def judge_reads(requests: DataFrame, parts: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Judge requests to read a split: (phase, split, label, trial, t, caller) with size and livetime of the split and `refusal`.

    `parts` are segments with their `split`, `audit` what was read so far. `refusal` is null for a read that is granted. The
    evaluation split may be read for one final report, so a request for it is refused once the trail shows such a read.
    """
    sizes = parts.groupBy("split").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(duration()).alias("livetime"))
    judged = phase_permission(requests).join(F.broadcast(sizes.filter(F.col("split").isin(*SPLITS))), "split", "left")  # five rows
    past = requests.sparkSession.createDataFrame([], AUDIT_SCHEMA) if audit is None else audit
    spent = past.agg(F.coalesce(F.bool_or((F.col("phase") == "final") & (F.col("split") == "eval")), F.lit(False)).alias("_spent"))
    once = (F.col("phase") == "final") & (F.col("split") == "eval") & F.col("_spent")
    refusal = (
        F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.lit("there is no such split"))
        .when(~F.col("allowed"), F.lit("the phase has no right to this split"))
        .when(once, F.lit("the one final report was made before"))
    )
    return judged.crossJoin(F.broadcast(spent)).select(  # one row
        "t", "phase", "split", "label", "trial", F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"),
        F.coalesce("livetime", F.lit(0.0)).alias("livetime"), "caller", refusal.alias("refusal"),
    )


def granted_reads(judged: DataFrame) -> DataFrame:
    """The audit rows of the requests that were granted, to be appended to the trail."""
    return judged.filter(F.col("refusal").isNull()).select(*AUDIT_SCHEMA.fieldNames())


def require_granted(judged: DataFrame) -> DataFrame:
    refused = judged.filter(F.col("refusal").isNotNull()).limit(5).collect()
    if refused:
        raise FoldLeakError("; ".join(f"{r['phase']} asked for {r['split']}: {r['refusal']}" for r in refused))
    return judged


def read_request(spark: SparkSession, phase: str, split: str, label: str, caller: str = "", trial: int | None = None) -> DataFrame:
    """One request, made now."""
    schema = "phase string, split string, label string, trial int, caller string"
    return spark.createDataFrame([(phase, split, label, trial, caller)], schema).withColumn(
        "t", F.unix_micros(F.current_timestamp()) / 1e6
    )
