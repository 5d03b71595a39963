"""The data-quality operators. Each takes DataFrames and returns one; none triggers a job."""

from .carried import carried_check, domain_counts, email_counts, hub_counts, impossible_counts, merge_counts, signed
from .coverage import (
    coverage_by_source,
    coverage_delta,
    coverage_domain_universe,
    coverage_overall,
    coverage_published_by_source,
    coverage_published_total,
    coverage_reconcile,
    coverage_reconcile_email_reasons,
    coverage_reconcile_reasons,
    vendor_reachout,
)
from .domains import domain_status_distribution, domain_status_summary
from .duplicates import duplicate_buckets, duplicate_summary, duplicate_top, unique_duplicate_count
from .formats import (
    blocked_examples,
    blocked_summary,
    company_valid_format,
    deliverability_distribution,
    email_format_distribution,
    invalid_email_examples,
)
from .history import change_of_states, latest_release_change, release_state, release_trend, upsert_metrics
from .matching import (
    domain_match_by_country,
    domain_match_emails,
    domain_match_rollup,
    domain_mismatch_examples,
    domain_mismatch_pct,
    domain_root_match,
    domain_root_mismatch_pct,
)
from .metrics import (
    ACTION_RULES,
    action_items,
    action_items_metric,
    breaches,
    composite_metric,
    composite_score,
    metric_frame,
    metrics_from_wide,
    release_change,
    release_volume_change,
    with_severity,
)
from .ranking import priority_top_emails
from .review import domain_match_company_review, domain_match_review_addresses
from .volume import email_volume_by_country, email_volume_examples, email_volume_worst_country

__all__ = [
    "ACTION_RULES",
    "action_items", "action_items_metric", "blocked_examples", "blocked_summary", "breaches", "carried_check", "change_of_states",
    "company_valid_format",
    "composite_metric", "composite_score", "coverage_by_source", "coverage_delta", "coverage_domain_universe",
    "coverage_overall", "coverage_published_by_source", "coverage_published_total", "coverage_reconcile",
    "coverage_reconcile_email_reasons", "coverage_reconcile_reasons", "domain_counts", "email_counts", "hub_counts", "impossible_counts", "latest_release_change", "merge_counts", "signed",
    "deliverability_distribution", "domain_match_by_country", "domain_match_company_review", "domain_match_emails",
    "domain_match_review_addresses", "domain_match_rollup", "domain_mismatch_examples", "domain_mismatch_pct",
    "domain_root_match", "domain_root_mismatch_pct", "domain_status_distribution", "domain_status_summary", "duplicate_buckets",
    "duplicate_summary", "duplicate_top", "email_format_distribution", "email_volume_by_country",
    "email_volume_examples", "email_volume_worst_country", "invalid_email_examples", "metric_frame",
    "metrics_from_wide", "priority_top_emails", "release_change", "release_state", "release_volume_change", "release_trend", "unique_duplicate_count",
    "upsert_metrics", "vendor_reachout", "with_severity",
]
