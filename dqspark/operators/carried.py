"""Counts that carry from release to release, and the checks that follow from them.

A release changes few rows. The tables here hold counts by address, company, vendor and so on; all of them are sums over
rows, so the counts of a release are those of the release before plus signed counts of what changed: +1 for an added
row, -1 for a removed one, both for a changed one. No check reads the rows themselves again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import country_key, email_clean, format_status, is_blocked, non_blank, pct, row_count, status_label
from ..plans.once import computed_once
from ..schemas import require
from .coverage import (
    coverage_by_source,
    coverage_domain_universe,
    coverage_overall,
    coverage_published_by_source,
    coverage_published_total,
)
from .duplicates import buckets_of_pairs, summary_of_keys
from .formats import CLEAN, labelled_rows
from .volume import volume_of_pairs

SIGN = "sign"
Counts = dict[str, DataFrame]

# Keys and counters of each table of counts.
EMAIL_TABLES = {
    "formats": (["status", "blocked"], ["n"]),
    "statuses": (["verification_status"], ["n"]),
    "companies": (["id"], ["present", "filled", "valid"]),
    "slugs": (["slug"], ["present"]),
    "company_countries": (["id", "country"], ["n", "filled"]),
    "company_addresses": (["id", "country", CLEAN], ["n"]),
    "invalid_addresses": (["id", "country", "email", CLEAN], ["n"]),
}
HUB_TABLES = {"vendors": (["id", "source"], ["n"]), "published": (["id", "source", "slug"], ["n"])}
DOMAIN_TABLES = {"domain_ids": (["id"], ["n"])}
TABLES = {**EMAIL_TABLES, **HUB_TABLES, **DOMAIN_TABLES}


def signed(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The rows of a change with their sign. A changed row is removed as it was and added as it is."""
    parts = [df.withColumn(SIGN, F.lit(sign)) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    if not parts:
        raise ValueError("a change has added or removed rows")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _summed(rows: DataFrame, name: str) -> DataFrame:
    """The table of counts: counters summed by key, without keys whose counters are all zero."""
    keys, counters = TABLES[name]
    sums = rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in counters])
    return sums.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in counters]))


def _with_sign(rows: DataFrame) -> DataFrame:
    return rows if SIGN in rows.columns else rows.withColumn(SIGN, F.lit(1))


def email_counts(emails: DataFrame) -> Counts:
    """The tables of counts of e-mail rows, signed if the rows carry a sign.

    Equal rows are folded before they are cleaned; the tables start from that one shuffle.
    """
    columns = ["id", "slug", "country", "email", "verification_status"]
    require(emails, columns, "emails")
    folded = _with_sign(emails).groupBy(*columns).agg(F.sum(SIGN).alias("n"))
    clean = email_clean(F.col("email"))
    # No filter of a later check gets below this, or its fold would be another one and the e-mails be read again.
    cleaned = {**{c: F.col(c) for c in [*columns, "n"]}, CLEAN: clean, "is_filled": non_blank(F.col("email"))}
    rows = computed_once(folded, [], **cleaned).withColumn("status", format_status(F.col(CLEAN)))
    n, valid, filled = F.col("n"), F.col("status") == "valid", F.coalesce(F.col("is_filled"), F.lit(False))

    def where(condition: Column) -> Column:
        return F.when(condition, n).otherwise(0)

    present = where(F.col("email").isNotNull()).alias("present")
    tables = {
        "formats": rows.select("status", (valid & is_blocked(F.col(CLEAN))).alias("blocked"), "n"),
        "statuses": rows.select("verification_status", "n"),
        "companies": rows.select("id", present, where(filled).alias("filled"), where(filled & valid).alias("valid")),
        "slugs": rows.select("slug", present),
        "company_countries": rows.select("id", country_key(F.col("country")).alias("country"), "n", where(filled).alias("filled")),
        "company_addresses": rows.where(filled & valid).select("id", "country", CLEAN, "n"),
        "invalid_addresses": rows.where(filled & ~valid).select("id", "country", "email", CLEAN, "n"),
    }
    return {name: _summed(table, name) for name, table in tables.items()}


def hub_counts(hub: DataFrame) -> Counts:
    """The tables of counts of hub rows: by company and vendor, and by slug among the published ones."""
    require(hub, ["id", "source", "slug", "status"], "hub")
    rows = _with_sign(hub).withColumn("n", F.col(SIGN))
    published = rows.where(F.col("status") == "PUBLISHED")
    return {"vendors": _summed(rows, "vendors"), "published": _summed(published, "published")}


def domain_counts(domains: DataFrame) -> Counts:
    """The counts of domain rows by company."""
    require(domains, ["id"], "domains")
    return {"domain_ids": _summed(_with_sign(domains).withColumn("n", F.col(SIGN)), "domain_ids")}


def merge_counts(*counts: Counts) -> Counts:
    """The sum of tables of counts, such as those of a release and of the changes since. The order does not matter."""
    names = list(dict.fromkeys(name for each in counts for name in each))
    return {
        name: _summed(reduce(lambda a, b: a.unionByName(b), [each[name] for each in counts if name in each]), name)
        for name in names
    }


def impossible_counts(counts: Counts) -> DataFrame:
    """(table, key, counter, value) of the counters below zero: rows were removed that had never been counted."""
    found = []
    for name, table in counts.items():
        keys, counters = TABLES[name]
        values = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in counters])
        named = table.select(F.lit(name).alias("table"), F.to_json(F.struct(*keys)).alias("key"), F.inline(values))
        found.append(named.where(F.col("value") < 0))
    return reduce(lambda a, b: a.unionByName(b), found)


# --- the checks, from counts --------------------------------------------------------------------------


def carried_format_distribution(counts: Counts) -> DataFrame:
    sums = counts["formats"].agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("empty", "invalid", "valid")],
    )
    rows = labelled_rows(sums, "format_status", "email_rows", {s: F.col(s) for s in ("empty", "invalid", "valid")})
    return rows.where(F.col("email_rows") > 0).orderBy(F.desc("email_rows"), "format_status")


def carried_blocked_summary(counts: Counts) -> DataFrame:
    good = counts["formats"].where(F.col("status") == "valid")
    total = F.coalesce(F.sum("n"), F.lit(0))
    blocked = F.coalesce(F.sum(F.when(F.col("blocked"), F.col("n"))), F.lit(0))
    return good.agg(total.alias("total_valid_emails"), blocked.alias("blocked_emails"), pct(blocked, total).alias("pct_blocked"))


def carried_deliverability(counts: Counts, blank_as_null: bool = True) -> DataFrame:
    raw = F.col("verification_status")
    status = status_label(raw) if blank_as_null else F.coalesce(raw, F.lit("NULL"))
    per_status = counts["statuses"].groupBy(status.alias("verification_status")).agg(F.sum("n").alias("row_count"))
    total = per_status.agg(F.sum("row_count")).scalar()
    return per_status.withColumn("pct", pct(F.col("row_count"), total)).orderBy(F.desc("row_count"), "verification_status")


def carried_company_valid_format(counts: Counts) -> DataFrame:
    having, valid = row_count(), F.count_if(F.col("valid") > 0)
    return counts["companies"].where(F.col("filled") > 0).agg(
        having.alias("companies_with_any_email"),
        valid.alias("companies_with_valid_email"),
        pct(valid, having).alias("pct_companies_with_valid_email"),
    )


def carried_invalid_examples(counts: Counts, n: int = 20) -> DataFrame:
    order = [F.asc_nulls_last(c) for c in (CLEAN, "id", "country", "email")]
    first = counts["invalid_addresses"].orderBy(*order).limit(n)
    # Each row as often as it was counted, as far as the list can show it.
    times = F.array_repeat(F.lit(1), F.least("n", F.lit(n)).cast("int"))
    rows = first.select("id", "country", "email", CLEAN, F.explode(times).alias("one"))
    return rows.drop("one").orderBy(*order).limit(n)


def _occurrences(counts: Counts) -> DataFrame:
    return counts["company_addresses"].groupBy(CLEAN).agg(F.sum("n").alias("occurrences")).where(F.col("occurrences") > 1)


def carried_unique_duplicate_count(counts: Counts) -> DataFrame:
    return _occurrences(counts).agg(row_count().alias("unique_duplicate_emails"))


def carried_duplicate_top(counts: Counts, n: int = 20) -> DataFrame:
    return _occurrences(counts).orderBy(F.desc("occurrences"), CLEAN).limit(n)


def carried_duplicate_buckets(counts: Counts) -> DataFrame:
    return buckets_of_pairs(counts["company_addresses"].groupBy(CLEAN, "id").agg(F.sum("n").alias("n")))


def _mailed(counts: Counts, table: str, counter: str) -> DataFrame:
    """One e-mail row per company or slug that has any."""
    return counts[table].where(F.col(counter) > 0).withColumn("email", F.lit("any"))


def _standing(counts: Counts, table: str) -> DataFrame:
    return counts[table].where(F.col("n") > 0)


def _persona(counts: Counts) -> DataFrame:
    return _standing(counts, "published").withColumn("status", F.lit("PUBLISHED"))


#: Each check by the name of the operator that counts the rows anew.
CHECKS = {
    "email_format_distribution": carried_format_distribution,
    "invalid_email_examples": carried_invalid_examples,
    "company_valid_format": carried_company_valid_format,
    "duplicate_summary": lambda c: summary_of_keys(c["company_addresses"]),
    "unique_duplicate_count": carried_unique_duplicate_count,
    "duplicate_top": carried_duplicate_top,
    "duplicate_buckets": carried_duplicate_buckets,
    "blocked_summary": carried_blocked_summary,
    "deliverability_distribution": carried_deliverability,
    "email_volume_by_country": lambda c: volume_of_pairs(
        _standing(c, "company_countries").select("id", "country", F.col("filled").alias("email_count"))
    ),
    "coverage_overall": lambda c: coverage_overall(_standing(c, "vendors"), _mailed(c, "companies", "filled")),
    "coverage_by_source": lambda c: coverage_by_source(_standing(c, "vendors"), _mailed(c, "companies", "filled")),
    "coverage_published_by_source": lambda c: coverage_published_by_source(_persona(c), _mailed(c, "slugs", "present")),
    "coverage_published_total": lambda c: coverage_published_total(_persona(c), _mailed(c, "slugs", "present")),
    "coverage_domain_universe": lambda c: coverage_domain_universe(
        _standing(c, "domain_ids"), _mailed(c, "companies", "present")
    ),
}


def carried_check(name: str, counts: Counts) -> DataFrame:
    """The result of the operator `name`, from counts alone."""
    if name not in CHECKS:
        raise ValueError(f"{name} does not follow from the counts; known are {', '.join(CHECKS)}")
    return CHECKS[name](counts)
