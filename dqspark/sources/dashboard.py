"""A release from its metrics to the trend, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import release_trend
from ..operators.metrics import action_items, action_items_metric, breaches, composite_metric, composite_score
from ..schemas import require
from .logs import append_runs, read_metrics, read_runs, save_metrics


def record_release(run: DataFrame, metrics: DataFrame, root: str, run_id: str) -> DataFrame:
    """Store a run with its metrics, its composite score and its action items; the trend of all runs, this one included.

    `metrics` is computed once, when it is written; the rest follows from what is stored of this run. The run enters the
    log last, and only once, so that a call that broke off can be repeated.
    """
    require(run, ["run_id", "run_ts"], "run")
    spark = metrics.sparkSession
    save_metrics(metrics, root, run_ids=[run_id])
    stored = read_metrics(spark, root).where(F.col("run_id") == run_id)
    derived = composite_metric(composite_score(stored)).unionByName(
        action_items_metric(action_items(breaches(stored))), allowMissingColumns=True
    )
    save_metrics(derived, root, run_ids=[run_id])
    known = read_runs(spark, root).where(F.col("run_id") == run_id)
    if known.isEmpty():
        append_runs(run.where(F.col("run_id") == run_id), root)
    return release_trend(read_runs(spark, root), read_metrics(spark, root))
