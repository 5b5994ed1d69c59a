"""Run records, trial logs and parameter budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from farspark.errors import RefusedError
from farspark.functions.expressions import budget_verdict as _verdict

# The verdicts a record may carry.
VERDICTS = ("keep", "discard", "needs-more-work")
MIN_SEEDS = 3


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def _empty(c: str) -> Column:
    return F.coalesce(F.size(c) <= 0, F.lit(True))


def record_problems(records: DataFrame) -> DataFrame:
    """Add `problems`, the field and rule of everything that keeps a record from supporting a claim, and `valid`."""
    verdict = F.col("verdict")
    rules = {
        "blank": [(c, _blank(c)) for c in ("hypothesis", "change", "reasoning")],
        "without entries": [(c, _empty(c)) for c in ("parameters", "folds", "primary")],
        "not a known value": [("verdict", ~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)))],
        f"under {MIN_SEEDS} for keep": [("seeds", F.coalesce((verdict == "keep") & (F.coalesce(F.size("seeds"), F.lit(0)) < MIN_SEEDS), F.lit(False)))],
    }
    found = [F.when(broken, F.lit(f"{field}: {rule}")) for rule, fields in rules.items() for field, broken in fields]
    return records.withColumn("problems", F.array_compact(F.array(*found))).withColumn("valid", F.size("problems") == 0)


def require_valid(records: DataFrame) -> DataFrame:
    bad = record_problems(records).filter(~F.col("valid")).select("name", "problems").limit(5).collect()
    if bad:
        raise RefusedError("; ".join(f"{r['name']}: {', '.join(r['problems'])}" for r in bad))
    return records


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to one column per leaf, named by its dotted path."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    quoted = lambda path: ".".join(f"`{p}`" for p in path)
    return df.select(*[F.col(quoted(p)).alias(sep.join(p)) for p in leaves(df.schema, ())])


def _usable() -> Column:
    return (F.col("state") == "done") & F.col("objective").isNotNull() & ~F.isnan("objective")


def best_trial(trials: DataFrame) -> DataFrame:
    """The completed trial with the smallest objective, the earlier one on a tie; none completed is an error."""
    row = F.struct(*trials.columns)
    best = trials.filter(_usable()).agg(F.min_by(row, F.struct("objective", "index")).alias("b"))
    none = F.raise_error(F.lit("no trial completed"))
    checked = best.select(F.when(F.col("b").isNull(), none.cast(best.schema["b"].dataType)).otherwise(F.col("b")).alias("b"))
    return checked.select("b.*")


def sweep_summary(trials: DataFrame) -> DataFrame:
    row = F.struct("objective", "index", "params")
    return trials.agg(
        F.count(F.lit(1)).alias("n_trials"), F.count(F.when(F.col("state") == "done", 1)).alias("n_done"),
        F.count(F.when(~F.col("state").eqNullSafe("done"), 1)).alias("n_failed"),
        F.min_by(F.when(_usable(), row), F.when(_usable(), F.struct("objective", "index"))).alias("best"),
    )


def budget_verdict(candidates: DataFrame, reference: DataFrame, tolerance: float = 0.10, strict: bool = False) -> DataFrame:
    """Join measured counts to reference counts per component: (component, candidate, baseline, passed, ratio)."""
    j = candidates.select("component", F.col("count").alias("candidate")).join(
        reference.select("component", F.col("count").alias("baseline")), "component"
    )
    bad = F.raise_error(F.lit("baseline count must be positive")).cast("bigint")
    j = j.withColumn("baseline", F.when(F.col("baseline") <= 0, bad).otherwise(F.col("baseline")))
    passed, rate = _verdict("candidate", "baseline", tolerance)
    out = j.select("component", "candidate", "baseline", passed, rate)
    if strict:
        fail = F.raise_error(F.concat(F.col("component"), F.lit(" is outside the parameter budget"))).cast("boolean")
        out = out.withColumn("passed", F.when(~F.col("passed"), fail).otherwise(F.col("passed")))
    return out
