"""The whole report of a release as one table: SLA rates, counts and vendor rows, with the e-mails read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pct
from ..operators.carried import Counts, carried_check, domain_counts, email_counts, hub_counts
from ..operators.domains import domain_status_distribution
from ..operators.matching import domain_match_by_country, domain_mismatch_pct
from ..operators.metrics import metric_frame, side_by_side
from .release import VOLUME_LABELS

REPORT_COLUMNS = ["run_id", "metric_key", "metric_label", "value_num", "value_pct", "severity", "details"]
# Keys and labels of the rows of a vendor; the vendor's name follows.
VENDOR_KEY, VENDOR_LABEL, NO_VENDOR = "vendor_without_email_pct", "Coverage: % companies without email, vendor ", "(none)"


def _total(table: DataFrame, counter: str, name: str, where: Column | None = None) -> DataFrame:
    picked = table if where is None else table.where(where)
    return picked.agg(F.coalesce(F.sum(counter), F.lit(0)).alias(name))


def volumes_of_counts(counts: Counts) -> DataFrame:
    """(metric_key, metric_label, value_num): how many companies, e-mails and domain rows there are."""
    standing = counts["vendors"].where(F.col("n") > 0)
    wide = side_by_side(
        [
            standing.agg(F.count_distinct("id").alias("companies_num")),
            _total(counts["companies"], "filled", "emails_num"),
            _total(counts["formats"], "n", "valid_emails_num", F.col("status") == "valid"),
            _total(counts["domain_ids"], "n", "domains_num"),
        ]
    )
    rows = [
        F.struct(F.lit(key).alias("metric_key"), F.lit(label).alias("metric_label"), F.col(key).cast("double").alias("value_num"))
        for key, label in VOLUME_LABELS.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def vendors_of_counts(counts: Counts, threshold: float = 70) -> DataFrame:
    """(metric_key, metric_label, value_num, value_pct, severity): a row per vendor with its number of companies, its share
    of companies without an e-mail, and whether that share calls for the vendor to be contacted."""
    by_source = carried_check("coverage_by_source", counts)
    vendor = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(NO_VENDOR))
    # Vendors whose names only differ in blanks, and all without a name, are one row.
    sums = by_source.groupBy(vendor.alias("vendor")).agg(
        F.sum("total_companies").alias("companies"),
        F.sum("companies_with_email").alias("having"),
        F.sum("companies_without_email").alias("lacking"),
    )
    share = pct(F.col("lacking"), F.col("having") + F.col("lacking"))
    return sums.select(
        F.concat(F.lit(VENDOR_KEY + ":"), "vendor").alias("metric_key"),
        F.concat(F.lit(VENDOR_LABEL), "vendor").alias("metric_label"),
        F.col("companies").cast("double").alias("value_num"),
        share.alias("value_pct"),
        F.when(share >= threshold, "breach").otherwise("ok").alias("severity"),
    )


def report_of_counts(
    counts: Counts, domain_status: DataFrame, mismatch: DataFrame, run_id: str, thresholds: dict | None = None, vendor_threshold: float = 70
) -> DataFrame:
    """The report from counts, such as carried ones, the domain status distribution and the domain mismatch."""
    rates = metric_frame(
        coverage=carried_check("coverage_overall", counts),
        domain_status=domain_status,
        formats=carried_check("email_format_distribution", counts),
        duplicates=carried_check("duplicate_summary", counts),
        unique_duplicates=carried_check("unique_duplicate_count", counts),
        mismatch=mismatch,
        blocked=carried_check("blocked_summary", counts),
        volume=carried_check("email_volume_by_country", counts),
        run_id=run_id,
        thresholds=thresholds,
    )
    run = F.lit(run_id).alias("run_id")
    volumes = volumes_of_counts(counts).select(run, "*", F.lit("info").alias("severity"))
    vendors = vendors_of_counts(counts, vendor_threshold).select(run, "*")
    return (
        rates.unionByName(volumes, allowMissingColumns=True)
        .unionByName(vendors, allowMissingColumns=True)
        .select(*REPORT_COLUMNS)
    )


def release_report(
    hub: DataFrame, emails: DataFrame, domains: DataFrame, run_id: str, thresholds: dict | None = None, vendor_threshold: float = 70
) -> DataFrame:
    """SLA rates, counts and vendor rows of a release.

    All but the domain match follow from one fold of the e-mails, whose shuffle every branch reads again; the domain
    match reads them as they are written.
    """
    counts = {**email_counts(emails), **hub_counts(hub), **domain_counts(domains)}
    mismatch = domain_mismatch_pct(domain_match_by_country(hub, emails))
    return report_of_counts(counts, domain_status_distribution(domains), mismatch, run_id, thresholds, vendor_threshold)

