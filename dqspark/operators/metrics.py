"""SLA metrics in long form: severity, breaches, recommendations, composite score, change per release."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio2
from ..schemas import require

# Metric keys with their labels, in report order.
METRIC_LABELS = {
    "coverage_with_email_pct": "Coverage: % companies with ≥1 email",
    "coverage_without_email_pct": "Coverage: % companies without email",
    "domain_status_not_200_pct": "Domains: % not-200",
    "invalid_format_pct": "Email format: % invalid",
    "duplicate_email_pct": "Duplicate emails: %",
    "domain_mismatch_pct": "Domain mismatch: %",
    "blocked_email_pct": "Blocked emails: %",
    "gt5_email_country_pct_max": "Max country % of companies with >5 emails",
}

# A rate at or above its threshold breaches the SLA.
DEFAULT_THRESHOLDS = {
    "coverage_without_email_pct": 30,
    "domain_status_not_200_pct": 30,
    "invalid_format_pct": 2,
    "duplicate_email_pct": 5,
    "domain_mismatch_pct": 30,
    "blocked_email_pct": 1,
    "gt5_email_country_pct_max": 2,
}

# Recommendation per breached metric.
ACTION_RULES = {
    "coverage_without_email_pct": "[SLA] Low email coverage — investigate ingestion gaps and ID mapping.",
    "domain_status_not_200_pct": "[SLA] High non-200 domains — improve enrichment/retry and validate vendor domains.",
    "invalid_format_pct": "[DQ] High invalid formats — improve cleaning, block masked/placeholder values, fix upstream.",
    "duplicate_email_pct": "[DQ] High duplicates — enforce dedupe and identify duplicate-producing source.",
    "domain_mismatch_pct": "[DQ] High mismatch — improve parsing/mapping + controlled exceptions (free-mail, group domains).",
    "blocked_email_pct": "[DQ] High blocked emails — expand blocklist and drop no-reply early.",
    "gt5_email_country_pct_max": "[DQ] High >5 emails rate — enforce top-5 policy and prune noisy emails per country.",
}
GENERIC_ACTION = "[DQ] Review breach: "

# Parts of the composite score; True where a higher rate is better.
COMPONENTS = {
    "coverage_with_email_pct": True,
    "invalid_format_pct": False,
    "duplicate_email_pct": False,
    "blocked_email_pct": False,
    "domain_mismatch_pct": False,
    "domain_status_not_200_pct": False,
    "gt5_email_country_pct_max": False,
}
COMPOSITE_KEY, COMPOSITE_LABEL = "composite_score", "Composite DQ score (higher is better)"
ACTIONS_KEY, ACTIONS_LABEL = "action_items", "Auto-generated action items"

METRIC_COLUMNS = ["run_id", "metric_key", "metric_label", "value_pct", "severity", "details"]


def _lookup(values: dict, key: Column, dtype: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key).cast(dtype) if values else F.lit(None).cast(dtype)


def severity(rate: Column, threshold: Column, direction: str = "above") -> Column:
    """unknown without a rate; breach at or beyond the threshold; else ok."""
    if direction not in ("above", "below"):
        raise ValueError("direction is 'above' or 'below'")
    beyond = rate >= threshold if direction == "above" else rate <= threshold
    return F.when(rate.isNull(), "unknown").when(beyond, "breach").otherwise("ok")


def with_severity(metrics: DataFrame, thresholds: dict | None = None, direction: str = "above") -> DataFrame:
    """Grade `value_pct` by the threshold of its key; a key without a threshold is always ok."""
    require(metrics, ["metric_key", "value_pct"], "metrics")
    thresholds = DEFAULT_THRESHOLDS if thresholds is None else thresholds
    limit = _lookup(thresholds, F.col("metric_key"), "double")
    graded = severity(F.col("value_pct"), limit, direction)
    return metrics.withColumn("severity", F.when(limit.isNull(), "ok").otherwise(graded))


def side_by_side(one_row_frames: list[DataFrame]) -> DataFrame:
    """The columns of several one-row frames in one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def metrics_from_wide(wide: DataFrame, run_id: str, thresholds: dict | None = None) -> DataFrame:
    """The eight SLA metrics from one row with a column per metric key and `unique_duplicate_emails`."""
    require(wide, [*METRIC_LABELS, "unique_duplicate_emails"], "metric values")
    thresholds = DEFAULT_THRESHOLDS if thresholds is None else thresholds

    def details(key: str) -> Column:
        if key == "coverage_with_email_pct":
            facts = [("pct_without_email", F.col("coverage_without_email_pct").cast("string"))]
        else:
            facts = [("threshold", F.lit(str(thresholds.get(key, ""))))]
        if key == "duplicate_email_pct":
            facts.append(("unique_duplicate_emails", F.col("unique_duplicate_emails").cast("string")))
        return F.create_map(*[x for name, value in facts for x in (F.lit(name), value)])

    rows = [
        F.struct(
            F.lit(key).alias("metric_key"),
            F.lit(label).alias("metric_label"),
            F.col(key).cast("double").alias("value_pct"),
            details(key).alias("details"),
        )
        for key, label in METRIC_LABELS.items()
    ]
    long = wide.select(F.lit(run_id).alias("run_id"), F.inline(F.array(*rows)))
    return with_severity(long, thresholds).select(*METRIC_COLUMNS)


def metric_frame(
    coverage: DataFrame,
    domain_status: DataFrame,
    formats: DataFrame,
    duplicates: DataFrame,
    unique_duplicates: DataFrame,
    mismatch: DataFrame,
    blocked: DataFrame,
    volume: DataFrame,
    run_id: str,
    thresholds: dict | None = None,
) -> DataFrame:
    """The eight SLA metrics of a run from the results of the single checks."""

    def one(df: DataFrame, column: str, name: str, where: Column | None = None) -> DataFrame:
        picked = df if where is None else df.where(where)
        return picked.agg(F.max(column).alias(name))

    rates = [
        one(coverage, "pct_with_email", "coverage_with_email_pct"),
        one(coverage, "pct_without_email", "coverage_without_email_pct"),
        one(domain_status, "pct", "domain_status_not_200_pct", F.col("status") == "Status Code not 200"),
        one(formats, "pct", "invalid_format_pct", F.col("format_status") == "invalid"),
        one(duplicates, "duplicate_percentage", "duplicate_email_pct"),
        one(mismatch, "mismatch_pct", "domain_mismatch_pct"),
        one(blocked, "pct_blocked", "blocked_email_pct"),
        one(volume, "pct_companies_gt5_emails", "gt5_email_country_pct_max"),
        one(unique_duplicates, "unique_duplicate_emails", "unique_duplicate_emails"),
    ]
    return metrics_from_wide(side_by_side(rates), run_id, thresholds)


def breaches(metrics: DataFrame) -> DataFrame:
    require(metrics, ["metric_key", "severity"], "metrics")
    return metrics.where(F.col("severity") == "breach")


def action_items(breached: DataFrame, rules: dict | None = None) -> DataFrame:
    """A recommendation per breach; keys without a rule get a generic one."""
    require(breached, ["metric_key", "metric_label", "value_pct"], "breaches")
    rule = _lookup(ACTION_RULES if rules is None else rules, F.col("metric_key"), "string")
    text = F.coalesce(rule, F.concat(F.lit(GENERIC_ACTION), F.col("metric_label")))
    keys = ["run_id"] if "run_id" in breached.columns else []
    return breached.select(*keys, "metric_key", "metric_label", "value_pct", text.alias("action_item"))


def action_items_metric(items: DataFrame) -> DataFrame:
    """The recommendations of each run as one metric row. A run has one item per metric key at most."""
    require(items, ["run_id", "metric_key", "action_item"], "action items")
    ordered = F.array_sort(F.collect_list(F.struct("metric_key", "action_item")))["action_item"]
    per_run = items.groupBy("run_id").agg(F.to_json(F.struct(ordered.alias("items"))).alias("details_json"))
    return per_run.select(
        "run_id",
        F.lit(ACTIONS_KEY).alias("metric_key"),
        F.lit(ACTIONS_LABEL).alias("metric_label"),
        F.lit(None).cast("double").alias("value_pct"),
        F.lit("info").alias("severity"),
        "details_json",
    )


def composite_score(metrics: DataFrame) -> DataFrame:
    """Per run the mean of the component rates, low-is-better ones as 100 minus the rate; NULLs skipped."""
    require(metrics, ["run_id", "metric_key", "value_pct"], "metrics")
    higher = _lookup(COMPONENTS, F.col("metric_key"), "boolean")
    value = F.when(higher, F.col("value_pct")).otherwise(100 - F.col("value_pct"))
    # Millionths of a point keep the sum exact in any order.
    points = metrics.where(F.col("metric_key").isin(*COMPONENTS)).select(
        "run_id", F.round(value * 1_000_000).cast("bigint").alias("points")
    )
    score = ratio2(F.sum("points"), 1_000_000 * F.count("points"))
    return points.groupBy("run_id").agg(score.alias("composite_score"))


def composite_metric(scores: DataFrame) -> DataFrame:
    """Composite scores as metric rows; runs without a score have none."""
    require(scores, ["run_id", "composite_score"], "composite scores")
    parts = [[key, METRIC_LABELS[key], "higher" if higher else "lower"] for key, higher in COMPONENTS.items()]
    return scores.where(F.col("composite_score").isNotNull()).select(
        "run_id",
        F.lit(COMPOSITE_KEY).alias("metric_key"),
        F.lit(COMPOSITE_LABEL).alias("metric_label"),
        F.col("composite_score").alias("value_pct"),
        F.lit("info").alias("severity"),
        F.lit(json.dumps({"components": parts})).alias("details_json"),
    )


def _beside_previous(runs: DataFrame, metrics: DataFrame, value: str, prev: str) -> DataFrame:
    """(metric_key, run_ts, value, prev): each value next to that of the same metric in the run before.

    History is cut by month: within a month the previous row is a window away, and the first row of a
    month takes the last row of the month before that has one. No task sees more than one month of a key.
    """
    require(runs, ["run_id", "run_ts"], "runs")
    require(metrics, ["run_id", "metric_key", value], "metrics")
    history = metrics.join(runs.select("run_id", "run_ts"), "run_id").select(
        "metric_key", "run_ts", "run_id", value, F.trunc("run_ts", "MM").alias("month")
    )
    order = ["run_ts", "run_id"]
    inside = Window.partitionBy("metric_key", "month").orderBy(*order)
    stamped = history.withColumn("nth", F.row_number().over(inside)).withColumn("inside", F.lag(value).over(inside))
    last = history.groupBy("metric_key", "month").agg(F.max_by(F.struct(value), F.struct(*order)).alias("last"))
    months = Window.partitionBy("metric_key").orderBy("month")
    carried = last.select("metric_key", "month", F.lag("last").over(months)[value].alias("carried"))
    before = F.when(F.col("nth") == 1, F.col("carried")).otherwise(F.col("inside"))
    return stamped.join(carried, ["metric_key", "month"]).select("metric_key", "run_ts", value, before.alias(prev))


def release_change(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each metric next to its value in the run before, and the difference."""
    change = F.round(F.col("value_pct") - F.col("prev_pct"), 6).alias("change")
    return _beside_previous(runs, metrics, "value_pct", "prev_pct").select("*", change).orderBy("metric_key", "run_ts")


def release_volume_change(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each count next to that of the run before, with the difference and the growth in percent.

    The growth is NULL where the count before was zero or is missing. Metrics without a count are left out.
    """
    require(metrics, ["value_num"], "metrics")
    beside = _beside_previous(runs, metrics.where(F.col("value_num").isNotNull()), "value_num", "prev_num")
    change = F.col("value_num") - F.col("prev_num")
    growth = F.round(100 * change / F.nullif(F.col("prev_num"), F.lit(0.0)), 6)
    return beside.select("*", change.alias("change"), growth.alias("change_pct")).orderBy("metric_key", "run_ts")
