"""Metrics, thresholds, the log tables and the comparison of releases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dqspark import operators as op
from dqspark.operators.metrics import DEFAULT_THRESHOLDS, METRIC_LABELS, severity
from dqspark.plans.release import release_metrics
from dqspark.sources import append_runs, new_run, read_metrics, read_runs, record_release, save_metrics

from .adversarial import DDL, tables

METRICS = "run_id string, metric_key string, metric_label string, value_pct double"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_severity(spark):
    df = spark.createDataFrame([(None,), (29.99,), (30.0,), (31.0,)], "v double")
    graded = df.select(severity(F.col("v"), F.lit(30)).alias("a"), severity(F.col("v"), F.lit(30), "below").alias("b"))
    assert [tuple(r) for r in graded.collect()] == [
        ("unknown", "unknown"), ("ok", "breach"), ("breach", "breach"), ("breach", "ok"),
    ]
    with pytest.raises(ValueError):
        severity(F.col("v"), F.lit(30), "sideways")


def test_metrics_from_single_checks_and_in_one_pass_agree(spark):
    f = {name: spark.createDataFrame(rows, DDL[name]) for name, rows in tables(seed=11).items()}
    hub, emails, domains = f["persona_hub"], f["emails"], f["domains"]
    single = op.metric_frame(
        coverage=op.coverage_overall(hub, emails),
        domain_status=op.domain_status_distribution(domains),
        formats=op.email_format_distribution(emails),
        duplicates=op.duplicate_summary(emails),
        unique_duplicates=op.unique_duplicate_count(emails),
        mismatch=op.domain_mismatch_pct(op.domain_match_by_country(hub, emails)),
        blocked=op.blocked_summary(emails),
        volume=op.email_volume_by_country(emails),
        run_id="r",
    )
    a = sorted(map(str, single.collect()))
    assert a == sorted(map(str, release_metrics(hub, emails, domains, "r").collect()))
    assert len(a) == len(METRIC_LABELS)


def test_metrics_of_empty_tables_are_unknown(spark):
    f = {name: spark.createDataFrame([], ddl) for name, ddl in DDL.items()}
    rows = {r["metric_key"]: r for r in release_metrics(f["persona_hub"], f["emails"], f["domains"], "r").collect()}
    assert all(r["value_pct"] is None for r in rows.values())
    assert {k: rows[k]["severity"] for k in DEFAULT_THRESHOLDS} == dict.fromkeys(DEFAULT_THRESHOLDS, "unknown")
    assert rows["coverage_with_email_pct"]["severity"] == "ok"


def test_breaches_get_action_items(spark):
    rows = [("r", "blocked_email_pct", "Blocked", 3.0), ("r", "made_up_pct", "Made up", 9.0), ("r", "invalid_format_pct", "F", 1.0)]
    metrics = op.with_severity(spark.createDataFrame(rows, METRICS), {**DEFAULT_THRESHOLDS, "made_up_pct": 5})
    items = {r["metric_key"]: r["action_item"] for r in op.action_items(op.breaches(metrics)).collect()}
    assert items == {
        "blocked_email_pct": "[DQ] High blocked emails — expand blocklist and drop no-reply early.",
        "made_up_pct": "[DQ] Review breach: Made up",
    }
    row = op.action_items_metric(op.action_items(op.breaches(metrics))).first()
    assert json.loads(row["details_json"])["items"] == [items["blocked_email_pct"], items["made_up_pct"]]


def test_composite_score_over_all_runs(spark):
    rows = [
        ("a", "coverage_with_email_pct", "", 80.0),
        ("a", "invalid_format_pct", "", 10.0),
        ("a", "blocked_email_pct", "", None),
        ("a", "coverage_without_email_pct", "", 20.0),
        ("b", "duplicate_email_pct", "", None),
        ("c", "duplicate_email_pct", "", 0.01),
        ("c", "coverage_with_email_pct", "", 0.0),
    ]
    scores = op.composite_score(spark.createDataFrame(rows, METRICS))
    assert {r[0]: r[1] for r in scores.collect()} == {"a": 85.0, "b": None, "c": 50.0}
    metric = {r["run_id"]: r for r in op.composite_metric(scores).collect()}
    assert set(metric) == {"a", "c"}
    assert len(json.loads(metric["a"]["details_json"])["components"]) == 7


def test_upsert_is_idempotent_and_newest_wins(spark):
    old = spark.createDataFrame([("a", "k", "x", 1.0), ("b", "k", "x", 2.0)], METRICS)
    new = spark.createDataFrame([("a", "k", "y", 5.0, 1), ("a", "k", "z", 6.0, 2), ("c", "k", "y", 7.0, 1)], METRICS + ", at int")
    once = op.upsert_metrics(old, new, order_by="at")
    expected = [("a", "k", "z", 6.0), ("b", "k", "x", 2.0), ("c", "k", "y", 7.0)]
    assert sorted(tuple(r) for r in once.collect()) == expected
    assert sorted(tuple(r) for r in op.upsert_metrics(once, new, order_by="at").collect()) == expected


def test_release_trend_labels(spark):
    runs = spark.createDataFrame([("a", day(1), None), ("b", day(0), "first"), ("c", day(2), "")], "run_id string, run_ts timestamp, release_label string")
    metrics = spark.createDataFrame([("a", "composite_score", "", 90.0), ("b", "composite_score", "", 80.0), ("c", "composite_score", "", 70.0), ("a", "other", "", 1.0)], METRICS)
    rows = [tuple(r)[1:] for r in op.release_trend(runs, metrics).collect()]
    assert rows == [("first", 80.0), ("2026-01-02", 90.0), ("", 70.0)]


def test_release_change_crosses_months_and_gaps(spark):
    days = [0, 3, 30, 31, 200, 201]
    runs = spark.createDataFrame([(str(d), day(d)) for d in days], "run_id string, run_ts timestamp")
    values = dict(zip(days, [1.0, 2.0, None, 4.5, 5.0, 7.0]))
    rows = [(str(d), "k", "", v) for d, v in values.items()] + [("200", "late", "", 3.0)]
    got = op.release_change(runs, spark.createDataFrame(rows, METRICS)).collect()
    assert [(r["metric_key"], r["value_pct"], r["prev_pct"], r["change"]) for r in got] == [
        ("k", 1.0, None, None), ("k", 2.0, 1.0, 1.0), ("k", None, 2.0, None), ("k", 4.5, None, None),
        ("k", 5.0, 4.5, 0.5), ("k", 7.0, 5.0, 2.0), ("late", 3.0, None, None),
    ]


def test_logs_on_disk(spark, tmp_path):
    root = str(tmp_path / "dq")
    assert read_metrics(spark, root).count() == 0 and read_runs(spark, root).count() == 0
    append_runs(new_run(spark, "r1", "me", None), root)
    append_runs(new_run(spark, None, None, None), root)
    assert read_runs(spark, root).count() == 2
    first = spark.createDataFrame([("2026-01-01", "a", "A", 1.0), ("2026-01-01", "b", "B", 2.0), ("r2", "a", "A", 3.0)], METRICS)
    save_metrics(first.withColumn("details", F.create_map(F.lit("threshold"), F.lit("5"))), root)
    save_metrics(spark.createDataFrame([("2026-01-01", "a", "A", 9.0), ("r3", "a", "A", 4.0)], METRICS), root)
    rows = {(r["run_id"], r["metric_key"]): (r["value_pct"], r["details_json"]) for r in read_metrics(spark, root).collect()}
    assert rows == {
        ("2026-01-01", "a"): (9.0, None),
        ("2026-01-01", "b"): (2.0, '{"threshold":"5"}'),
        ("r2", "a"): (3.0, '{"threshold":"5"}'),
        ("r3", "a"): (4.0, None),
    }


def test_only_the_given_runs_are_read_and_written(spark, tmp_path):
    root = str(tmp_path)
    save_metrics(spark.createDataFrame([("r1", "a", "A", 1.0), ("r2", "a", "A", 2.0)], METRICS), root)
    save_metrics(spark.createDataFrame([("r1", "a", "A", 5.0), ("r2", "a", "A", 6.0)], METRICS), root, run_ids=["r1"])
    got = {(r["run_id"], r["value_pct"]) for r in read_metrics(spark, root).collect()}
    assert got == {("r1", 5.0), ("r2", 2.0)}
    plan = read_metrics(spark, root).where(F.col("run_id").isin(["r1"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "r1" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pair_counts_beyond_a_long(spark):
    from dqspark.functions.rates import pct

    row = spark.sql("SELECT cast(5e17 AS decimal(38,0)) AS a, cast(2e18 AS decimal(38,0)) AS b")
    assert row.select(pct(F.col("a"), F.col("b")).alias("p")).first()["p"] == 25.0


def test_a_release_in_one_call(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([("a", day(0), "first"), ("b", day(1), None)], "run_id string, run_ts timestamp, release_label string")
    rows = [("a", "invalid_format_pct", "Invalid", 10.0, "ok"), ("b", "invalid_format_pct", "Invalid", 40.0, "breach"), ("b", "blocked_email_pct", "Blocked", 20.0, "ok")]
    metrics = spark.createDataFrame(rows, METRICS + ", severity string")
    for run in "aab":  # the first one twice, as after a call that broke off
        trend = record_release(runs, metrics.where(F.col("run_id") == run), root, run)
    assert [(r["release_label"], r["composite_score"]) for r in trend.collect()] == [("first", 90.0), ("2026-01-02", 70.0)]
    assert read_runs(spark, root).count() == 2
    keys = {(r["run_id"], r["metric_key"]) for r in read_metrics(spark, root).collect()}
    assert keys == {(r[0], r[1]) for r in rows} | {("a", "composite_score"), ("b", "composite_score"), ("b", "action_items")}


def test_mismatch_of_a_release_by_first_labels(spark):
    f = {name: spark.createDataFrame(rows, DDL[name]) for name, rows in tables(seed=11).items()}
    by_rule = release_metrics(f["persona_hub"], f["emails"], f["domains"], "r", root_rule=True)
    match = op.domain_root_match(f["domains"], f["emails"]).first()["match_pct"]
    got = by_rule.where(F.col("metric_key") == "domain_mismatch_pct").first()["value_pct"]
    assert match not in (None, 100.0) and got == round(100 - match, 2)


def test_reconcile_reasons_explain_both_sides(spark):
    hub = spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (2, "x"), (2, "z"), (3, "x"), (None, "x"), (None, "y")], "id bigint, source string")
    emails = spark.createDataFrame([(1, "a@b.c"), (2, " "), (9, "q@r.s"), (None, "n@n.n")], "id bigint, email string")
    got = [tuple(r) for r in op.coverage_reconcile_email_reasons(hub, emails).collect()]
    assert got == [("with e-mail", 1, 2, 0, 2), ("without e-mail", 1, 1, 1, 2)]
    sums = op.coverage_by_source(hub, emails).agg(F.sum("companies_with_email"), F.sum("companies_without_email")).first()
    whole = op.coverage_overall(hub, emails).first()
    assert [sums[0] - whole["companies_with_email"], sums[1] - whole["companies_without_email"]] == [r[4] for r in got]
    none = op.coverage_reconcile_email_reasons(hub.limit(0), emails.limit(0)).collect()
    assert [tuple(r) for r in none] == [("with e-mail", 0, 0, 0, 0), ("without e-mail", 0, 0, 0, 0)]
