"""Declared schemas (DDL), checked once where data is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from farspark.errors import RefusedError

GRID = (
    "span_start double, span_end double, i bigint, ts double, score_a double, score_b double, centroid_a double, "
    "centroid_b double, arm_a double, arm_b double, re_a array<float>, im_a array<float>, re_b array<float>, "
    "im_b array<float>, checkpoint string"
)
GRID_REQUIRED = ("span_start", "i", "score_a", "score_b")
BANK = ("tile_id bigint, data array<float>, h int, w int, y float, source string")
TRIGGERS = (
    "span_start double, lag_index int, i bigint, j bigint, stat double, channel string"
)
RUN_META = (
    "campaign_id string, background_livetime_s double, n_lags bigint, keep_above double, checkpoint string, "
    "model_id string, gate_applied boolean"
)
TRIALS = (
    "index int, params map<string,double>, objective double, state string, seconds double, fold map<string,string>, "
    "error string"
)
RECORDS = (
    "name string, hypothesis string, change string, parameters map<string,string>, folds map<string,string>, "
    "primary map<string,string>, secondary map<string,string>, seeds array<int>, compute_gpu_hours double, "
    "verdict string, reasoning string, config map<string,string>, extra map<string,string>, created_at double"
)


def names(ddl: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [part.split()[0] for part in ddl.split(", ")]


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """Refuse at analysis time, before any job, what lacks a column the query needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise RefusedError(f"{what} lacks {', '.join(missing)}")
    return df
