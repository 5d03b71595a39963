"""Address format, blocked addresses and deliverability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import email_clean, format_status, is_blocked, is_valid_email, non_blank, pct, row_count, status_label
from ..plans import computed_once
from ..schemas import require

CLEAN = "email_clean"


def clean_emails(emails: DataFrame, *columns: str) -> DataFrame:
    """The non-blank e-mails as `columns` plus `email_clean`."""
    require(emails, [*columns, "email"], "emails")
    filled = emails.where(non_blank(F.col("email")))
    return computed_once(filled, list(columns), **{CLEAN: email_clean(F.col("email"))})


def valid_emails(emails: DataFrame, *columns: str) -> DataFrame:
    """The e-mails of valid format as `columns` plus `email_clean`."""
    return clean_emails(emails, *columns).where(is_valid_email(F.col(CLEAN)))


def labelled_counts(df: DataFrame, label: str, count: str, cases: list, keep_empty: bool) -> DataFrame:
    """(label, count, pct) rows for a fixed list of (text, condition) cases, in one pass over `df`."""
    conditions = [F.count_if(cond).alias(f"n{i}") for i, (_, cond) in enumerate(cases)]
    totals = df.agg(row_count().alias("total"), *conditions)
    out = labelled_rows(totals, label, count, {text: F.col(f"n{i}") for i, (text, _) in enumerate(cases)})
    return out if keep_empty else out.where(F.col(count) > 0)


def labelled_rows(totals: DataFrame, label: str, count: str, counts: dict[str, Column]) -> DataFrame:
    """(label, count, pct) rows from one row of counts with their `total`."""
    rows = F.array(*[F.struct(F.lit(text).alias(label), n.alias(count)) for text, n in counts.items()])
    return totals.select("total", F.inline(rows)).select(label, count, pct(F.col(count), F.col("total")).alias("pct"))


def email_format_distribution(emails: DataFrame) -> DataFrame:
    """Rows per format status (empty, invalid, valid); a status without rows has no line."""
    require(emails, ["email"], "emails")
    status = emails.select(format_status(email_clean(F.col("email"))).alias("status"))
    cases = [(s, F.col("status") == s) for s in ("empty", "invalid", "valid")]
    out = labelled_counts(status, "format_status", "email_rows", cases, keep_empty=False)
    return out.orderBy(F.desc("email_rows"), "format_status")


def _examples(rows: DataFrame, n: int) -> DataFrame:
    order = [F.asc_nulls_last(c) for c in (CLEAN, "id", "country", "email")]
    return rows.select("id", "country", "email", CLEAN).orderBy(*order).limit(n)


def invalid_email_examples(emails: DataFrame, n: int = 20) -> DataFrame:
    """Non-blank e-mails of invalid format, first in address order."""
    cleaned = clean_emails(emails, "id", "country", "email")
    return _examples(cleaned.where(~is_valid_email(F.col(CLEAN))), n)


def company_valid_format(emails: DataFrame) -> DataFrame:
    """Of the companies with any e-mail, how many have one of valid format."""
    per_company = clean_emails(emails, "id").groupBy("id").agg(F.bool_or(is_valid_email(F.col(CLEAN))).alias("valid"))
    having, valid = row_count(), F.count_if("valid")
    return per_company.agg(
        having.alias("companies_with_any_email"),
        valid.alias("companies_with_valid_email"),
        pct(valid, having).alias("pct_companies_with_valid_email"),
    )


def blocked_summary(emails: DataFrame) -> DataFrame:
    """No-reply style addresses among the valid ones."""
    total, blocked = row_count(), F.count_if(is_blocked(F.col(CLEAN)))
    return valid_emails(emails).agg(
        total.alias("total_valid_emails"), blocked.alias("blocked_emails"), pct(blocked, total).alias("pct_blocked")
    )


def blocked_examples(emails: DataFrame, n: int = 20) -> DataFrame:
    """Blocked addresses of valid format, first in address order."""
    return _examples(valid_emails(emails, "id", "country", "email").where(is_blocked(F.col(CLEAN))), n)


def deliverability_distribution(emails: DataFrame, blank_as_null: bool = True) -> DataFrame:
    """Row share per verification status. Blank counts as NULL, or stays a status of its own."""
    require(emails, ["verification_status"], "emails")
    raw = F.col("verification_status")
    status = status_label(raw) if blank_as_null else F.coalesce(raw, F.lit("NULL"))
    counts = (
        emails.select(status.alias("verification_status"))
        .groupBy("verification_status")
        .agg(row_count().alias("row_count"))
    )
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn("pct", pct(F.col("row_count"), total)).orderBy(
        F.desc("row_count"), "verification_status"
    )
