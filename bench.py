"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from farspark.operators import slides
from farspark.plans import reports
from suite import session, views as v
from suite.all import QUERIES

HEADLINE = (
    "far_curve", "efficiency_report", "lr_efficiency", "fit_lr", "coincident_livetime", "fold_report", "threshold_at_far",
    "efficiency_at_far", "far_of", "efficiency_vs_achieved_far", "veto_ablation", "sensitive_volume", "spearman",
    "fit_temperature", "lr_background", "coherence_from_coefficients_bulk",
)


def fine_slides(spark, sf_dir):
    """The slide background on a grid of five-minute bins: 1.2 million pairs over 143 lags."""
    grid = v.score_grid(spark, sf_dir, 300.0)
    curve = reports.far_curve(grid, 300.0, 2000, 600.0, 600.0, 4.0)
    return curve.totals()


def dense_pairs(spark, sf_dir):
    """Every pair of the five-minute grid formed and clustered, nothing pruned."""
    grid = v.score_grid(spark, sf_dir, 300.0)
    grid = slides.standardise(grid, slides.norm_values(slides.sigma_norm(grid)))
    return slides.count_clustered(grid, slides.SlidePlan(143, 600.0), 300.0, 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local(os.environ.get("BENCH_CPUS"))
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {n: QUERIES[n] for n in HEADLINE} | {"fine_slides": fine_slides, "dense_pairs": dense_pairs}
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    v.table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity")).collect()  # start the executors
    seconds = {}
    for name, fn in jobs.items():
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            fn(spark, sf_dir).collect()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
