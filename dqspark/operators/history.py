"""The metric log across releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import require
from .metrics import COMPOSITE_KEY

KEY = ["run_id", "metric_key"]
STATE = ["metric_key", "has_value", "value_pct", "prev_pct", "last_pct"]


def upsert_metrics(existing: DataFrame, new: DataFrame, order_by: str | None = None) -> DataFrame:
    """`existing` with the rows of `new` added, or in place of those with the same run and metric.

    Should `new` hold a key more than once, the highest `order_by` wins; without it any one row does.
    """
    require(existing, KEY, "metric log")
    require(new, KEY, "new metrics")
    if order_by is None:
        latest = new.dropDuplicates(KEY)
    else:
        newest = Window.partitionBy(*KEY).orderBy(F.desc(order_by))
        latest = new.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") == 1).drop("_nth")
        if order_by not in existing.columns:
            latest = latest.drop(order_by)
    kept = existing.join(latest.select(*KEY), KEY, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def release_trend(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The stored composite score per run, oldest first; a run without a label shows its date."""
    require(runs, ["run_id", "run_ts", "release_label"], "runs")
    require(metrics, ["run_id", "metric_key", "value_pct"], "metrics")
    scores = metrics.where(F.col("metric_key") == COMPOSITE_KEY).select(
        "run_id", F.col("value_pct").alias("composite_score")
    )
    label = F.coalesce("release_label", F.date_format("run_ts", "yyyy-MM-dd"))
    joined = runs.join(scores, "run_id")
    return joined.select("run_ts", label.alias("release_label"), "composite_score").orderBy("run_ts", "release_label")


# --- change by change: a run's state is made from that of the run before --------------------------------


def release_state(before: DataFrame, of_run: DataFrame) -> DataFrame:
    """The state of a run, from that of the run before it and its own (metric_key, value_pct): a row per metric that it
    or any earlier run has.

    `prev_pct` is the value in the newest earlier run that has the metric, `last_pct` the value that the next run takes
    as its previous one. Metrics that the run lacks are carried on, with `has_value` false.
    """
    require(before, ["metric_key", "last_pct"], "state before")
    require(of_run, ["metric_key", "value_pct"], "metrics of the run")
    known = before.select("metric_key", F.col("last_pct").alias("prev_pct"), F.lit(False).alias("has_value"), F.lit(None).cast("double").alias("value_pct"))
    own = of_run.select("metric_key", F.lit(None).cast("double").alias("prev_pct"), F.lit(True).alias("has_value"), "value_pct")
    state = known.unionByName(own).groupBy("metric_key").agg(
        F.bool_or("has_value").alias("has_value"), F.max("value_pct").alias("value_pct"), F.max("prev_pct").alias("prev_pct")
    )
    last = F.when(F.col("has_value"), F.col("value_pct")).otherwise(F.col("prev_pct"))
    return state.withColumn("last_pct", last).select(*STATE)


def change_of_states(runs: DataFrame, states: DataFrame) -> DataFrame:
    """`release_change` from the states of runs: each metric next to its value in the run before."""
    require(runs, ["run_id", "run_ts"], "runs")
    require(states, ["run_id", *STATE], "states")
    change = F.round(F.col("value_pct") - F.col("prev_pct"), 6).alias("change")
    own = states.where("has_value").join(runs.select("run_id", "run_ts"), "run_id")
    return own.select("metric_key", "run_ts", "value_pct", "prev_pct", change).orderBy("metric_key", "run_ts")


def latest_release_change(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The change of the newest run alone: its metrics next to the newest earlier values, found by one aggregation."""
    require(runs, ["run_id", "run_ts"], "runs")
    require(metrics, [*KEY, "value_pct"], "metrics")
    newest = runs.agg(F.max(F.struct("run_ts", "run_id")).alias("run")).select("run.run_ts", "run.run_id")
    stamped = metrics.join(runs.select("run_id", "run_ts"), "run_id")
    marked = stamped.withColumn("newest", newest.select("run_id").scalar() == F.col("run_id"))
    order = F.struct("run_ts", "run_id")
    before = marked.where(~F.col("newest")).groupBy("metric_key").agg(F.max_by("value_pct", order).alias("last_pct"))
    state = release_state(before, marked.where("newest"))
    change = F.round(F.col("value_pct") - F.col("prev_pct"), 6).alias("change")
    run_ts = newest.select("run_ts").scalar().alias("run_ts")
    return state.where("has_value").select("metric_key", run_ts, "value_pct", "prev_pct", change).orderBy("metric_key")
