"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark import functions as fn
from dqspark import operators as op
from dqspark.operators.carried import CHECKS
from dqspark.plans.release import release_metrics, release_volumes
from dqspark.plans.report import release_report

from .fixtures import change, view

Query = Callable[[SparkSession, str], DataFrame]

# The views have at most 19 e-mails per company and country, and metric values that are daily event counts.
MIN_TOTAL = 8
RUN_ID = "release-1"
# Ten of eleven companies of the views have an e-mail.
VENDOR_THRESHOLD = 11
EVENT_THRESHOLDS = {"invalid_format_pct": 65, "duplicate_email_pct": 70, "domain_mismatch_pct": 60, "blocked_email_pct": 66}


def _over(operator: Callable[..., DataFrame], *views: str, **options) -> Query:
    return lambda spark, sf_dir: operator(*[view(spark, sf_dir, v) for v in views], **options)


def _per_row(table: str, keys: list[str], **columns) -> Query:
    """Row-level functions over a whole view."""
    return lambda spark, sf_dir: view(spark, sf_dir, table).select(
        *keys, *[make().alias(name) for name, make in columns.items()]
    )


def _hub_and_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    hub = view(spark, sf_dir, "persona_hub").select("id", "name", "fqdn")
    emails = view(spark, sf_dir, "emails").select("email_id", "id", "email")
    email, domain = F.col("email"), fn.normalize_domain(F.col("fqdn"))
    matched = fn.six_clause_match(
        fn.email_domain(email),
        fn.local_part(email),
        fn.alnum_clean(F.split_part(email, F.lit("@"), F.lit(1))),
        domain,
        fn.domain_root(domain),
        fn.alnum_clean(F.col("name")),
    )
    return emails.join(hub, "id").select("email_id", matched.alias("matched"))


def _coverage_delta(spark, sf_dir):
    source = op.coverage_published_total(view(spark, sf_dir, "persona_hub"), view(spark, sf_dir, "emails"))
    bronze = op.coverage_domain_universe(view(spark, sf_dir, "domains"), view(spark, sf_dir, "emails"))
    return op.coverage_delta(source, bronze)


def _coverage_reconcile(spark, sf_dir):
    hub, emails = view(spark, sf_dir, "persona_hub"), view(spark, sf_dir, "emails")
    return op.coverage_reconcile(op.coverage_overall(hub, emails), op.coverage_by_source(hub, emails))


def _vendor_reachout(spark, sf_dir):
    by_source = op.coverage_by_source(view(spark, sf_dir, "persona_hub"), view(spark, sf_dir, "emails"))
    return op.vendor_reachout(by_source, threshold=VENDOR_THRESHOLD)


def _mismatch_pct(spark, sf_dir):
    return op.domain_mismatch_pct(
        op.domain_match_by_country(view(spark, sf_dir, "persona_hub"), view(spark, sf_dir, "emails"))
    )


def _worst_country(by):
    return lambda spark, sf_dir: op.email_volume_worst_country(
        op.email_volume_by_country(view(spark, sf_dir, "emails")), by=by
    )


def _as_rows(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("details_json", F.to_json("details")).drop("details")


def _metric_frame(spark, sf_dir):
    hub, emails, domains = (view(spark, sf_dir, v) for v in ("persona_hub", "emails", "domains"))
    metrics = op.metric_frame(
        coverage=op.coverage_overall(hub, emails),
        domain_status=op.domain_status_distribution(domains),
        formats=op.email_format_distribution(emails),
        duplicates=op.duplicate_summary(emails),
        unique_duplicates=op.unique_duplicate_count(emails),
        mismatch=op.domain_mismatch_pct(op.domain_match_by_country(hub, emails)),
        blocked=op.blocked_summary(emails),
        volume=op.email_volume_by_country(emails),
        run_id=RUN_ID,
    )
    return _as_rows(metrics)


def _release_metrics(spark, sf_dir):
    hub, emails, domains = (view(spark, sf_dir, v) for v in ("persona_hub", "emails", "domains"))
    return _as_rows(release_metrics(hub, emails, domains, RUN_ID))


def _history(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "dq_metrics").withColumn("metric_label", F.concat(F.lit("Label of "), "metric_key"))


def _runs(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "dq_runs").withColumn("run_ts", F.col("run_id"))


def _with_severity(spark, sf_dir):
    return op.with_severity(view(spark, sf_dir, "dq_metrics"), EVENT_THRESHOLDS)


def _breached(spark, sf_dir):
    return op.breaches(op.with_severity(_history(spark, sf_dir), EVENT_THRESHOLDS))


def _action_items(spark, sf_dir):
    # A rule set without blocked_email_pct, so that the generic text occurs too.
    rules = {k: v for k, v in op.ACTION_RULES.items() if k != "blocked_email_pct"}
    return op.action_items(_breached(spark, sf_dir), rules)


def _action_items_metric(spark, sf_dir):
    return op.action_items_metric(op.action_items(_breached(spark, sf_dir)))


def _composite(spark, sf_dir):
    return op.composite_score(view(spark, sf_dir, "dq_metrics"))


def _upserted(spark, sf_dir):
    """Halved invalid-format rates replace the stored ones; composite scores come in new."""
    stored = view(spark, sf_dir, "dq_metrics")
    halved = stored.where(F.col("metric_key") == "invalid_format_pct").withColumn("value_pct", F.col("value_pct") / 2)
    scores = op.composite_metric(_composite(spark, sf_dir)).select("run_id", "metric_key", "value_pct")
    return op.upsert_metrics(stored, halved.unionByName(scores))


def _release_volumes(spark, sf_dir):
    return release_volumes(*(view(spark, sf_dir, v) for v in ("persona_hub", "emails", "domains")), RUN_ID)


def _release_report(spark, sf_dir):
    hub, emails, domains = (view(spark, sf_dir, v) for v in ("persona_hub", "emails", "domains"))
    return _as_rows(release_report(hub, emails, domains, RUN_ID, vendor_threshold=VENDOR_THRESHOLD))


def _release_volume_change(spark, sf_dir):
    counts = view(spark, sf_dir, "dq_metrics").withColumnRenamed("value_pct", "value_num")
    return op.release_volume_change(_runs(spark, sf_dir), counts)


def _release_trend(spark, sf_dir):
    return op.release_trend(_runs(spark, sf_dir), op.composite_metric(_composite(spark, sf_dir)))


def _release_change(spark, sf_dir):
    return op.release_change(_runs(spark, sf_dir), view(spark, sf_dir, "dq_metrics"))


def _latest_release_change(spark, sf_dir):
    return op.latest_release_change(_runs(spark, sf_dir), view(spark, sf_dir, "dq_metrics"))


def _pct_by_status(spark, sf_dir):
    invalid = F.count_if(F.col("email").isNull())
    return view(spark, sf_dir, "emails").groupBy("id").agg(fn.pct(invalid, F.count(F.lit(1))).alias("pct_null"))


def _carried(check: str) -> Query:
    """A check of the later release, from the counts of the release before and the signed counts of the change."""
    count = {"persona_hub": op.hub_counts, "emails": op.email_counts, "domains": op.domain_counts}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, since = {}, {}
        for name, counts_of in count.items():
            rows = view(spark, sf_dir, name)
            before |= counts_of(rows)
            since |= counts_of(op.signed(*change(rows, name)))
        return op.carried_check(check, op.merge_counts(before, since))

    return query


def _clean():
    return fn.email_clean(F.col("email"))


OPERATORS: dict[str, Query] = {
    "coverage_overall": _over(op.coverage_overall, "persona_hub", "emails"),
    "coverage_by_source": _over(op.coverage_by_source, "persona_hub", "emails"),
    "coverage_by_source_blank_counts": _over(
        op.coverage_by_source, "persona_hub", "emails", blank_is_missing=False
    ),
    "coverage_published_by_source": _over(op.coverage_published_by_source, "persona_hub", "emails"),
    "coverage_published_total": _over(op.coverage_published_total, "persona_hub", "emails"),
    "coverage_domain_universe": _over(op.coverage_domain_universe, "domains", "emails"),
    "coverage_delta": _coverage_delta,
    "coverage_reconcile": _coverage_reconcile,
    "coverage_reconcile_email_reasons": _over(op.coverage_reconcile_email_reasons, "persona_hub", "emails"),
    "coverage_reconcile_reasons": _over(op.coverage_reconcile_reasons, "persona_hub"),
    "vendor_reachout": _vendor_reachout,
    "domain_status_distribution": _over(op.domain_status_distribution, "domains"),
    "domain_status_summary": _over(op.domain_status_summary, "domains"),
    "email_format_distribution": _over(op.email_format_distribution, "emails"),
    "invalid_email_examples": _over(op.invalid_email_examples, "emails"),
    "company_valid_format": _over(op.company_valid_format, "emails"),
    "duplicate_summary": _over(op.duplicate_summary, "emails"),
    "unique_duplicate_count": _over(op.unique_duplicate_count, "emails"),
    "duplicate_top": _over(op.duplicate_top, "emails"),
    "duplicate_buckets": _over(op.duplicate_buckets, "emails"),
    "domain_match_by_country": _over(op.domain_match_by_country, "persona_hub", "emails"),
    "domain_match_by_country_lower_first": _over(
        op.domain_match_by_country, "persona_hub", "emails", lower_first=True
    ),
    "domain_match_rollup": _over(op.domain_match_rollup, "persona_hub", "emails"),
    "domain_match_company_review": _over(op.domain_match_company_review, "persona_hub", "emails"),
    "domain_match_review_addresses": _over(op.domain_match_review_addresses, "persona_hub", "emails"),
    "domain_match_emails": _over(op.domain_match_emails, "domains", "emails"),
    "domain_root_match": _over(op.domain_root_match, "domains", "emails"),
    "domain_root_mismatch_pct": _over(op.domain_root_mismatch_pct, "domains", "emails"),
    "domain_mismatch_examples": _over(op.domain_mismatch_examples, "domains", "emails"),
    "domain_mismatch_pct": _mismatch_pct,
    "blocked_summary": _over(op.blocked_summary, "emails"),
    "blocked_examples": _over(op.blocked_examples, "emails"),
    "deliverability_distribution": _over(op.deliverability_distribution, "emails"),
    "deliverability_distribution_blank_kept": _over(op.deliverability_distribution, "emails", blank_as_null=False),
    "email_volume_by_country": _over(op.email_volume_by_country, "emails"),
    "email_volume_worst_country": _worst_country("pct"),
    "email_volume_worst_country_by_count": _worst_country("count"),
    "email_volume_examples": _over(op.email_volume_examples, "emails"),
    "priority_top_emails": _over(op.priority_top_emails, "emails", "domains", min_total=MIN_TOTAL),
    "priority_top_emails_all": _over(op.priority_top_emails, "emails", "domains", min_total=MIN_TOTAL, n=None),
    "priority_top_emails_deduped": _over(
        op.priority_top_emails, "emails", "domains", min_total=MIN_TOTAL, dedupe_domains=True
    ),
    **{f"carried_{check}": _carried(check) for check in CHECKS},
    "metric_frame": _metric_frame,
    "release_metrics": _release_metrics,
    "release_volumes": _release_volumes,
    "release_report": _release_report,
    "with_severity": _with_severity,
    "breaches": _breached,
    "action_items": _action_items,
    "action_items_metric": _action_items_metric,
    "composite_score": _composite,
    "upsert_metrics": _upserted,
    "release_trend": _release_trend,
    "release_change": _release_change,
    "latest_release_change": _latest_release_change,
    "release_volume_change": _release_volume_change,
}

ROW_FUNCTIONS: dict[str, Query] = {
    "non_blank": _per_row("emails", ["email_id"], present=lambda: fn.non_blank(F.col("email"))),
    "email_clean": _per_row("emails", ["email_id"], email_clean=_clean),
    "is_valid_email": _per_row("emails", ["email_id"], valid=lambda: fn.is_valid_email(_clean())),
    "format_status": _per_row("emails", ["email_id"], format_status=lambda: fn.format_status(_clean())),
    "is_blocked": _per_row("emails", ["email_id"], blocked=lambda: fn.is_blocked(_clean())),
    "local_part_and_domain": _per_row(
        "emails",
        ["email_id"],
        local_part=lambda: fn.local_part(F.col("email")),
        email_domain=lambda: fn.email_domain(F.col("email")),
        raw_email_domain=lambda: fn.email_domain(F.col("email"), trimmed=False),
    ),
    "normalize_domain": _per_row("persona_hub", ["id"], company_domain=lambda: fn.normalize_domain(F.col("fqdn"))),
    "website_domain": _per_row("domains", ["id", "fqdn"], website_domain=lambda: fn.website_domain(F.col("website"))),
    "domain_root": _per_row(
        "persona_hub", ["id"], company_root=lambda: fn.domain_root(fn.normalize_domain(F.col("fqdn")))
    ),
    "alnum_clean": _per_row(
        "persona_hub",
        ["id"],
        name_clean=lambda: fn.alnum_clean(F.col("name")),
        name_clean_lower_first=lambda: fn.alnum_clean(F.col("name"), lower_first=True),
    ),
    "domain_related": _per_row(
        "domains",
        ["id", "fqdn"],
        related=lambda: fn.domain_related(
            fn.normalize_domain(F.col("fqdn")), F.coalesce(fn.website_domain(F.col("website")), F.lit(""))
        ),
    ),
    "six_clause_match": _hub_and_email,
    "country_key": _per_row("emails", ["email_id"], country=lambda: fn.country_key(F.col("country"))),
    "status_label": _per_row("emails", ["email_id"], status=lambda: fn.status_label(F.col("verification_status"))),
    "occurrence_bucket": lambda spark, sf_dir: (
        view(spark, sf_dir, "emails")
        .groupBy("email")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("email", fn.occurrence_bucket(F.col("n")).alias("occ_bucket"))
    ),
    "role_score": _per_row(
        "emails", ["email_id"], role_score=lambda: fn.role_score(fn.local_part(F.col("email"), trimmed=False))
    ),
    "pct": _pct_by_status,
}

QUERIES: dict[str, Query] = {**OPERATORS, **ROW_FUNCTIONS}
