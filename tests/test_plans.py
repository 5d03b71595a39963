"""The shape of the physical plans over stored tables."""

from __future__ import annotations

import re

import pytest

from dqspark import operators as op
from dqspark.plans.release import release_metrics
from dqspark.plans.report import release_report

from .adversarial import DDL, tables

COUNTRY_CHECKS = [op.domain_match_by_country, op.domain_match_rollup]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    frames = {}
    for name, rows in tables().items():
        spark.createDataFrame(rows, DDL[name]).write.parquet(str(root / name))
        frames[name] = spark.read.parquet(str(root / name))
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    return frames


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


def operators(f):
    hub, emails, domains = f["persona_hub"], f["emails"], f["domains"]
    overall, by_source = op.coverage_overall(hub, emails), op.coverage_by_source(hub, emails)
    volume, by_country = op.email_volume_by_country(emails), op.domain_match_by_country(hub, emails)
    return {
        "coverage_overall": overall,
        "coverage_by_source": by_source,
        "coverage_published_by_source": op.coverage_published_by_source(hub, emails),
        "coverage_published_total": op.coverage_published_total(hub, emails),
        "coverage_domain_universe": op.coverage_domain_universe(domains, emails),
        "coverage_delta": op.coverage_delta(overall, op.coverage_domain_universe(domains, emails)),
        "coverage_reconcile": op.coverage_reconcile(overall, by_source),
        "coverage_reconcile_reasons": op.coverage_reconcile_reasons(hub),
        "vendor_reachout": op.vendor_reachout(by_source),
        "domain_status_distribution": op.domain_status_distribution(domains),
        "domain_status_summary": op.domain_status_summary(domains),
        "email_format_distribution": op.email_format_distribution(emails),
        "invalid_email_examples": op.invalid_email_examples(emails),
        "company_valid_format": op.company_valid_format(emails),
        "duplicate_summary": op.duplicate_summary(emails),
        "unique_duplicate_count": op.unique_duplicate_count(emails),
        "duplicate_top": op.duplicate_top(emails),
        "duplicate_buckets": op.duplicate_buckets(emails),
        "domain_match_by_country": by_country,
        "domain_match_rollup": op.domain_match_rollup(hub, emails),
        "domain_match_company_review": op.domain_match_company_review(hub, emails),
        "domain_match_review_addresses": op.domain_match_review_addresses(hub, emails),
        "domain_match_emails": op.domain_match_emails(domains, emails),
        "domain_root_match": op.domain_root_match(domains, emails),
        "domain_mismatch_examples": op.domain_mismatch_examples(domains, emails),
        "domain_mismatch_pct": op.domain_mismatch_pct(by_country),
        "blocked_summary": op.blocked_summary(emails),
        "blocked_examples": op.blocked_examples(emails),
        "deliverability_distribution": op.deliverability_distribution(emails),
        "email_volume_by_country": volume,
        "email_volume_worst_country": op.email_volume_worst_country(volume),
        "email_volume_examples": op.email_volume_examples(emails),
        "priority_top_emails": op.priority_top_emails(emails, domains, min_total=8),
        "priority_top_emails_all": op.priority_top_emails(emails, domains, min_total=8, n=None),
        "release_metrics": release_metrics(hub, emails, domains, "r"),
    }


@pytest.fixture(scope="module")
def plans(stored):
    return {name: plan(df) for name, df in operators(stored).items()}


def test_no_python_no_products(plans):
    for name, text in plans.items():
        assert not re.search(r"Python|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin|MapInPandas", text), name


def scans(text: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan parquet" in line]


def read_columns(line: str) -> set[str]:
    schema = re.search(r"ReadSchema: struct<(.*?)>", line).group(1)
    return {part.split(":")[0] for part in schema.split(",") if part}


@pytest.mark.parametrize(
    "name, columns",
    [
        ("email_format_distribution", {"email"}),
        ("blocked_summary", {"email"}),
        ("duplicate_summary", {"id", "country", "email"}),
        ("unique_duplicate_count", {"email"}),
        ("deliverability_distribution", {"verification_status"}),
        ("email_volume_by_country", {"id", "country", "email"}),
        ("domain_status_distribution", {"status_code"}),
        ("domain_status_summary", {"status_code"}),
        ("company_valid_format", {"id", "email"}),
    ],
)
def test_scans_read_only_needed_columns(plans, name, columns):
    found = scans(plans[name])
    assert found and all(read_columns(line) == columns for line in found)


def test_filters_reach_the_scan(stored):
    (scan,) = scans(plan(op.blocked_summary(stored["emails"])))
    assert re.search(r"PushedFilters: \[.*IsNotNull\(email\)", scan)
    text = plan(op.coverage_published_by_source(stored["persona_hub"], stored["emails"]))
    assert "EqualTo(status,PUBLISHED)" in text


def test_one_scan_and_one_exchange_per_plain_summary(plans):
    for name in ("email_format_distribution", "blocked_summary", "domain_status_distribution", "domain_status_summary"):
        text = plans[name]
        assert len(scans(text)) == 1, name
        assert text.count("Exchange SinglePartition") == 1 and "Exchange hash" not in text, name


def test_addresses_are_cleaned_once_per_scan(stored):
    for df in (op.blocked_summary(stored["emails"]), op.duplicate_summary(stored["emails"])):
        assert plan(df).count("regexp_replace(lower(trim(") == 1


def test_pair_counts_need_no_join(stored):
    for operator in (op.domain_match_emails, op.domain_root_match):
        assert "Join" not in plan(operator(stored["domains"], stored["emails"]))
    assert "Join" not in plan(op.coverage_overall(stored["persona_hub"], stored["emails"]))


def test_best_k_are_cut_before_the_shuffle(stored):
    text = plan(op.priority_top_emails(stored["emails"], stored["domains"], min_total=8))
    partial = [line for line in text.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert len(partial) == 2  # per e-mail domain of a group, and per group
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("n, reads", [(50, 2), (None, 1)])
def test_ranking_reads_the_emails_at_most_twice(stored, n, reads):
    text = final_plan(op.priority_top_emails(stored["emails"], stored["domains"], min_total=8, n=n))
    final = text.split("== Initial Plan ==")[0]
    emails = [line for line in scans(final) if "verification_status" in line or "country:string,email:string" in line]
    assert len(emails) <= reads


def test_top_lists_never_sort_everything(stored):
    emails = stored["emails"]
    for df in (op.invalid_email_examples(emails), op.blocked_examples(emails), op.duplicate_top(emails)):
        assert "TakeOrderedAndProject" in plan(df) and "Exchange rangepartitioning" not in plan(df)


def test_release_metrics_clean_the_emails_once(stored):
    text = final_plan(release_metrics(stored["persona_hub"], stored["emails"], stored["domains"], "r"))
    final = text.split("== Initial Plan ==")[0]
    assert final.count("regexp_replace(lower(trim(") == 1
    reused = [line for line in final.splitlines() if "ReusedExchange" in line and "email_clean" in line]
    assert len(reused) >= 3


def test_the_report_reads_the_emails_once_besides_the_domain_match(stored):
    hub, emails, domains = (stored[t] for t in ("persona_hub", "emails", "domains"))

    def reads(df):
        final = final_plan(df).split("== Initial Plan ==")[0]
        return sum("email:string" in line for line in scans(final))

    assert reads(release_report(hub, emails, domains, "r")) <= reads(op.domain_match_by_country(hub, emails)) + 1
