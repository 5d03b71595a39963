"""Repeated addresses: within a company, anywhere, and by how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import occurrence_bucket, pct, row_count
from ..functions.text import OCCURRENCE_BUCKETS
from ..plans import hot_keys, salted_join
from .formats import CLEAN, valid_emails


def duplicate_summary(emails: DataFrame) -> DataFrame:
    """Distinct (company, country, address) of valid format, split by occurring once or more often."""
    keys = ["id", "country", CLEAN]
    return summary_of_keys(valid_emails(emails, "id", "country").groupBy(*keys).agg(row_count().alias("n")))


def summary_of_keys(per_key: DataFrame) -> DataFrame:
    """The summary from one row per key with its number of rows `n`."""
    total, repeated = row_count(), F.count_if(F.col("n") > 1)
    return per_key.agg(
        total.alias("total_email"),
        F.count_if(F.col("n") == 1).alias("unique_email"),
        repeated.alias("duplicate_email"),
        pct(repeated, total).alias("duplicate_percentage"),
    )


def _occurrences(emails: DataFrame) -> DataFrame:
    return valid_emails(emails).groupBy(CLEAN).agg(row_count().alias("occurrences"))


def unique_duplicate_count(emails: DataFrame) -> DataFrame:
    """Number of addresses seen more than once anywhere."""
    return _occurrences(emails).agg(F.count_if(F.col("occurrences") > 1).alias("unique_duplicate_emails"))


def duplicate_top(emails: DataFrame, n: int = 20) -> DataFrame:
    """The most repeated addresses."""
    repeated = _occurrences(emails).where(F.col("occurrences") > 1)
    return repeated.orderBy(F.desc("occurrences"), CLEAN).limit(n)


def duplicate_buckets(emails: DataFrame) -> DataFrame:
    """Per occurrence bucket: repeated addresses, companies touched, and their share of all companies.

    Works on (company, address) pairs. An address shared by very many companies is cut into splits when
    its bucket is handed to its pairs; every company then reduces to one flag per bucket.
    """
    return buckets_of_pairs(valid_emails(emails, "id").groupBy(CLEAN, "id").agg(row_count().alias("n")))


def buckets_of_pairs(pairs: DataFrame) -> DataFrame:
    """The buckets from one row per (address, company) with its number of rows `n`."""
    per_address = pairs.groupBy(CLEAN).agg(F.sum("n").alias("occurrences"), row_count().alias("rows"))
    repeated = per_address.where(F.col("occurrences") > 1).withColumn(
        "occ_bucket", occurrence_bucket(F.col("occurrences"))
    )

    # Reading n here too keeps the shuffle behind `pairs` the same in both uses, so that it runs once.
    listed = pairs.where(F.col("n") > 0).select(CLEAN, "id")
    hot = hot_keys(per_address, CLEAN)
    touched = salted_join(listed, repeated.select(CLEAN, "occ_bucket"), CLEAN, hot, [F.col("id")], "left")
    indexes = range(len(OCCURRENCE_BUCKETS))
    in_bucket = [F.coalesce(F.col("occ_bucket") == b, F.lit(False)) for b in OCCURRENCE_BUCKETS]
    per_company = touched.groupBy("id").agg(*[F.bool_or(in_bucket[i]).alias(f"b{i}") for i in indexes])
    companies = per_company.where(F.col("id").isNotNull()).agg(
        row_count().alias("total"), F.array(*[F.count_if(f"b{i}") for i in indexes]).alias("companies")
    )

    addresses = repeated.groupBy("occ_bucket").agg(row_count().alias("duplicate_email_count"))
    position = F.array_position(F.array(*[F.lit(b) for b in OCCURRENCE_BUCKETS]), F.col("occ_bucket")).cast("int")
    totals = companies.select(F.struct("total", "companies")).scalar()
    filled = addresses.withColumn("position", position).withColumn("totals", totals)
    in_this = F.element_at("totals.companies", F.col("position"))
    return (
        filled.withColumn("companies_in_bucket", in_this)
        .withColumn("pct_of_companies", pct(F.col("companies_in_bucket"), F.col("totals.total")))
        .orderBy("position")
        .select("occ_bucket", "duplicate_email_count", "companies_in_bucket", "pct_of_companies")
    )
