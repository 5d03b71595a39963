"""How many e-mails a company has in a country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import country_key, non_blank, pct, row_count
from ..schemas import require


def _company_country(emails: DataFrame) -> DataFrame:
    """(id, country, email_count): non-blank e-mails per company and country, zero included."""
    require(emails, ["id", "country", "email"], "emails")
    return (
        emails.select("id", country_key(F.col("country")).alias("country"), non_blank(F.col("email")).alias("filled"))
        .groupBy("id", "country")
        .agg(F.count_if("filled").alias("email_count"))
    )


def _rollup(pairs: DataFrame, k: int) -> DataFrame:
    total = row_count()
    few, many = F.count_if(F.col("email_count") <= k), F.count_if(F.col("email_count") > k)
    return pairs.groupBy("country").agg(
        total.alias("total_company_country"),
        few.alias(f"companies_le{k}_emails"),
        pct(few, total).alias(f"pct_companies_le{k}_emails"),
        many.alias(f"companies_gt{k}_emails"),
        pct(many, total).alias(f"pct_companies_gt{k}_emails"),
    )


def email_volume_by_country(emails: DataFrame, k: int = 5) -> DataFrame:
    """Per country, the (company, country) pairs with at most k and with more than k e-mails."""
    return volume_of_pairs(_company_country(emails), k)


def volume_of_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The volume from one row per (company, country) with its `email_count`."""
    return _rollup(pairs, k).orderBy(F.desc("total_company_country"), "country")


def email_volume_worst_country(volume: DataFrame, by: str = "pct", k: int = 5) -> DataFrame:
    """The country with the highest share of pairs above k, or (`by='count'`) the highest number."""
    if by not in ("pct", "count"):
        raise ValueError("by is 'pct' or 'count'")
    share, number = f"pct_companies_gt{k}_emails", f"companies_gt{k}_emails"
    require(volume, ["country", share, number], "volume by country")
    keys = [share] if by == "pct" else [number, share]
    return volume.orderBy(*[F.desc_nulls_last(c) for c in keys], "country").limit(1)


def email_volume_examples(emails: DataFrame, k: int = 5, n: int = 20) -> DataFrame:
    """The companies with most e-mails in the country with the highest share above k."""
    pairs = _company_country(emails)
    worst = email_volume_worst_country(_rollup(pairs, k), k=k).select("country").scalar()
    noisy = pairs.where((F.col("country") == worst) & (F.col("email_count") > k))
    return noisy.orderBy(F.desc("email_count"), F.asc_nulls_last("id")).limit(n)
