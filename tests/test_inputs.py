"""Missing columns, empty tables, and reading tables."""

import pytest

from dqspark import operators as op
from dqspark.schemas import COMPANY_EMAILS, METRIC_LOG, MissingColumns, require
from dqspark.sources import jdbc_options, read_files

from .adversarial import DDL


@pytest.fixture(scope="module")
def empty(spark):
    return {name: spark.createDataFrame([], ddl) for name, ddl in DDL.items()}


def test_missing_column_is_named_at_plan_time(empty):
    with pytest.raises(MissingColumns, match="emails lacks verification_status"):
        op.deliverability_distribution(empty["emails"].drop("verification_status"))
    assert require(empty["emails"], ["id"], "emails") is empty["emails"]


def test_empty_tables_give_null_rates(empty):
    hub, emails, domains = empty["persona_hub"], empty["emails"], empty["domains"]
    assert op.coverage_overall(hub, emails).first().asDict() == {
        "total_companies": 0, "companies_with_email": 0, "companies_without_email": 0,
        "pct_with_email": None, "pct_without_email": None,
    }
    assert op.coverage_published_total(hub, emails).first()["pct_with_email"] is None
    assert [tuple(r)[1:] for r in op.domain_status_distribution(domains).collect()] == [(0, None)] * 3
    assert op.email_format_distribution(emails).count() == 0
    assert tuple(op.duplicate_summary(emails).first()) == (0, 0, 0, None)
    assert tuple(op.blocked_summary(emails).first()) == (0, 0, None)
    assert tuple(op.domain_match_emails(domains, emails).first()) == (0, 0, None)
    assert op.domain_root_match(domains, emails).first()["match_pct"] is None
    assert op.duplicate_buckets(emails).count() == 0
    assert tuple(op.domain_match_rollup(hub, emails).first()) == ("ALL", 0, 0, None, 0, None)
    assert tuple(op.domain_mismatch_pct(op.domain_match_by_country(hub, emails)).first()) == (None, None)
    by_source = op.coverage_by_source(hub, emails)
    assert op.coverage_reconcile(op.coverage_overall(hub, emails), by_source).first()["matches"]
    assert tuple(op.coverage_reconcile_reasons(hub).first()) == (0, 0, 0, 0, 0, 0)
    delta = op.coverage_delta(op.coverage_overall(hub, emails), op.coverage_domain_universe(domains, emails)).first()
    assert (delta["delta_pct_with"], delta["ok"]) == (0.0, True)
    for rows in (
        op.domain_match_company_review(hub, emails), op.domain_mismatch_examples(domains, emails),
        op.priority_top_emails(emails, domains), op.email_volume_examples(emails), op.vendor_reachout(by_source),
    ):
        assert rows.count() == 0


def test_read_files(spark, tmp_path):
    path = str(tmp_path / "emails")
    spark.createDataFrame([(1, "AU", "a@x.com", None)], COMPANY_EMAILS).write.parquet(path)
    assert read_files(spark, path, COMPANY_EMAILS).count() == 1
    with pytest.raises(MissingColumns):
        read_files(spark, path, METRIC_LOG)
    text = str(tmp_path / "csv")
    spark.createDataFrame([(1, "AU", "a@x.com", "valid")], COMPANY_EMAILS).write.option("header", True).csv(text)
    assert read_files(spark, text, COMPANY_EMAILS, "csv").first()["id"] == 1


def test_jdbc_reads_are_partitioned():
    options = jdbc_options("jdbc:postgresql://host/db", "emails", "id", 0, 1000, 16)
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:postgresql://host/db", "emails", "id", 5, 5, 16)
