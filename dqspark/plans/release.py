"""All metrics of a release with the e-mail table cleaned once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import country_key, email_clean, format_status, is_blocked, non_blank, pct, row_count
from ..operators.domains import domain_status_distribution
from ..operators.matching import domain_match_by_country, domain_mismatch_pct, domain_root_mismatch_pct
from ..operators.metrics import metrics_from_wide, side_by_side
from ..schemas import require


def email_facts(emails: DataFrame) -> DataFrame:
    """(id, country, filled, email_clean, n): the e-mails folded into counts.

    Format, duplicates, blocked addresses, coverage and volume all follow from it. Its shuffle is the same
    in every branch that starts here, so Spark runs it once and reads it several times.
    """
    require(emails, ["id", "country", "email"], "emails")
    return (
        emails.select(
            "id",
            "country",
            non_blank(F.col("email")).alias("filled"),
            email_clean(F.col("email")).alias("email_clean"),
        )
        .groupBy("id", "country", "filled", "email_clean")
        .agg(row_count().alias("n"))
    )


def release_metrics(
    hub: DataFrame, emails: DataFrame, domains: DataFrame, run_id: str, thresholds: dict | None = None, k: int = 5, root_rule: bool = False
) -> DataFrame:
    """The eight SLA metrics of a run, straight from the tables. The domain mismatch follows the six-clause rule, or with
    `root_rule` that of equal first labels."""
    facts = email_facts(emails).withColumn("status", format_status(F.col("email_clean")))
    n, valid = F.col("n"), F.col("status") == "valid"

    def rows_where(condition):
        return F.sum(F.when(condition, n).otherwise(0))

    total, invalid, good = F.sum("n"), rows_where(F.col("status") == "invalid"), rows_where(valid)
    distinct, repeated = F.count_if(valid), F.count_if(valid & (n > 1))
    rates = facts.agg(
        # Without an invalid row there is no such line in the format check, hence no rate.
        pct(F.nullif(invalid, F.lit(0).cast("bigint")), total).alias("invalid_format_pct"),
        pct(repeated, distinct).alias("duplicate_email_pct"),
        pct(rows_where(valid & is_blocked(F.col("email_clean"))), good).alias("blocked_email_pct"),
    )
    per_address = facts.groupBy("email_clean").agg(F.sum("n").alias("n"), F.bool_or(valid).alias("valid"))
    unique = per_address.agg(F.count_if(F.col("valid") & (n > 1)).alias("unique_duplicate_emails"))

    pairs = facts.groupBy("id", country_key(F.col("country")).alias("country")).agg(
        rows_where(F.col("filled")).alias("email_count")
    )
    noisy = pct(F.count_if(F.col("email_count") > k), row_count())
    volume = pairs.groupBy("country").agg(noisy.alias("share")).agg(F.max("share").alias("gt5_email_country_pct_max"))

    # Every branch reads n, or it would need a shuffle of its own without the counts.
    mailed = facts.select("id", F.lit(False).alias("listed"), (F.col("filled") & (n > 0)).alias("filled"))
    listed = hub.select("id", F.lit(True).alias("listed"), F.lit(False).alias("filled"))
    flags = listed.unionByName(mailed).groupBy("id").agg(
        F.bool_or("listed").alias("listed"), (F.bool_or("filled") & F.col("id").isNotNull()).alias("has_email")
    )
    companies, having = F.count_if("listed"), F.count_if(F.col("listed") & F.col("has_email"))
    coverage = flags.agg(
        pct(having, companies).alias("coverage_with_email_pct"),
        pct(companies - having, companies).alias("coverage_without_email_pct"),
    )

    status = domain_status_distribution(domains).where(F.col("status") == "Status Code not 200")
    if root_rule:
        mismatch = domain_root_mismatch_pct(domains, emails)
    else:
        mismatch = domain_mismatch_pct(domain_match_by_country(hub, emails))
    wide = side_by_side(
        [
            rates,
            unique,
            volume,
            coverage,
            status.select(F.col("pct").alias("domain_status_not_200_pct")),
            mismatch.select(F.col("mismatch_pct").alias("domain_mismatch_pct")),
        ]
    )
    return metrics_from_wide(wide, run_id, thresholds)


VOLUME_LABELS = {
    "companies_num": "Volume: companies",
    "emails_num": "Volume: emails",
    "valid_emails_num": "Volume: emails of valid format",
    "domains_num": "Volume: domain rows",
}


def release_volumes(hub: DataFrame, emails: DataFrame, domains: DataFrame, run_id: str) -> DataFrame:
    """The counts of a run as metric rows with `value_num`, for `release_volume_change`."""
    require(hub, ["id"], "hub")
    require(emails, ["email"], "emails")
    good = format_status(email_clean(F.col("email"))) == "valid"
    counted = side_by_side(
        [
            hub.agg(F.count_distinct("id").alias("companies_num")),
            emails.agg(
                F.count_if(non_blank(F.col("email"))).alias("emails_num"), F.count_if(good).alias("valid_emails_num")
            ),
            domains.agg(row_count().alias("domains_num")),
        ]
    )
    rows = [
        F.struct(
            F.lit(key).alias("metric_key"), F.lit(label).alias("metric_label"), F.col(key).cast("double").alias("value_num")
        )
        for key, label in VOLUME_LABELS.items()
    ]
    long = counted.select(F.lit(run_id).alias("run_id"), F.inline(F.array(*rows)))
    return long.select("*", F.lit(None).cast("double").alias("value_pct"), F.lit("info").alias("severity"))
