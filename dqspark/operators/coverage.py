"""How many companies have an e-mail address: overall, by vendor, between layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cents, non_blank, pct, row_count
from ..plans import hot_keys, key_counts, salted_join
from ..schemas import require

COUNTS = ["total_companies", "companies_with_email", "companies_without_email"]


def _present(email: Column, blank_is_missing: bool) -> Column:
    return non_blank(email) if blank_is_missing else email.isNotNull()


def _summary(total: Column) -> list[Column]:
    """Coverage columns over rows carrying a boolean `has_email`."""
    rows = row_count()
    having, lacking = F.count_if("has_email"), F.count_if(~F.col("has_email"))
    return [
        total.alias("total_companies"),
        having.alias("companies_with_email"),
        lacking.alias("companies_without_email"),
        pct(having, rows).alias("pct_with_email"),
        pct(lacking, rows).alias("pct_without_email"),
    ]


def _ids_with_flag(companies: DataFrame, emails: DataFrame, blank_is_missing: bool) -> DataFrame:
    """One row per distinct company id with `has_email`, from a single tagged aggregation.

    Both tables shrink to their distinct ids before the only shuffle, so no id is hot in it.
    """
    company = companies.select("id", F.lit(True).alias("listed"), F.lit(False).alias("has_email"))
    email = emails.where(_present(F.col("email"), blank_is_missing) & F.col("id").isNotNull()).select(
        "id", F.lit(False).alias("listed"), F.lit(True).alias("has_email")
    )
    flags = company.unionByName(email).groupBy("id").agg(
        F.bool_or("listed").alias("listed"), F.bool_or("has_email").alias("has_email")
    )
    return flags.where("listed").select("id", "has_email")


def coverage_overall(hub: DataFrame, emails: DataFrame, blank_is_missing: bool = True) -> DataFrame:
    """Share of the hub's companies with at least one e-mail; for bronze or source tables alike."""
    require(hub, ["id"], "hub")
    require(emails, ["id", "email"], "emails")
    return _ids_with_flag(hub, emails, blank_is_missing).agg(*_summary(row_count()))


def coverage_domain_universe(domains: DataFrame, emails: DataFrame, blank_is_missing: bool = False) -> DataFrame:
    """Coverage over the companies that have a domain row; a blank e-mail counts by default."""
    require(domains, ["id"], "domains")
    require(emails, ["id", "email"], "emails")
    listed = domains.where(F.col("id").isNotNull())
    return _ids_with_flag(listed, emails, blank_is_missing).agg(*_summary(row_count()))


def _mailed(emails: DataFrame, key: str, blank_is_missing: bool) -> DataFrame:
    present = emails.where(_present(F.col("email"), blank_is_missing) & F.col(key).isNotNull())
    return present.select(key).distinct().withColumn("mailed", F.lit(True))


def _has_email() -> Column:
    return F.coalesce(F.col("mailed"), F.lit(False))


def coverage_by_source(hub: DataFrame, emails: DataFrame, blank_is_missing: bool = True) -> DataFrame:
    """Coverage per vendor. The total counts distinct ids, the rates are over (vendor, id) pairs."""
    require(hub, ["id", "source"], "hub")
    require(emails, ["id", "email"], "emails")
    listed = hub.select("source", "id").distinct()
    pairs = listed.join(_mailed(emails, "id", blank_is_missing), "id", "left").withColumn("has_email", _has_email())
    # Pairs are distinct, so within a vendor counting non-null ids counts distinct ids.
    return pairs.groupBy("source").agg(*_summary(F.count("id"))).orderBy(F.asc_nulls_last("source"))


def _published(persona: DataFrame, emails: DataFrame) -> DataFrame:
    """One row per distinct (source, id) of the published personas, with `has_email`."""
    require(persona, ["id", "slug", "source", "status"], "persona")
    require(emails, ["slug", "email"], "source emails")
    listed = persona.where(F.col("status") == "PUBLISHED").select("source", "id", "slug").distinct()
    hot = hot_keys(key_counts(listed, "slug"), "slug")
    joined = salted_join(listed, _mailed(emails, "slug", False), "slug", hot, [F.col("source"), F.col("id")], "left")
    return joined.groupBy("source", "id").agg(F.bool_or(_has_email()).alias("has_email"))


def coverage_published_by_source(persona: DataFrame, emails: DataFrame) -> DataFrame:
    """Coverage per vendor over published personas, joined on slug; a blank e-mail counts."""
    pairs = _published(persona, emails)
    return pairs.groupBy("source").agg(*_summary(row_count())).orderBy(F.desc("total_companies"), "source")


def coverage_published_total(persona: DataFrame, emails: DataFrame) -> DataFrame:
    """Overall figures over published (vendor, id) pairs; the total counts distinct ids."""
    per_id = (
        _published(persona, emails)
        .groupBy("id")
        .agg(F.count_if("has_email").alias("having"), F.count_if(~F.col("has_email")).alias("lacking"))
    )
    having, lacking = F.coalesce(F.sum("having"), F.lit(0)), F.coalesce(F.sum("lacking"), F.lit(0))
    return per_id.agg(
        F.count("id").alias("total_companies"),
        having.alias("companies_with_email"),
        lacking.alias("companies_without_email"),
        pct(having, having + lacking).alias("pct_with_email"),
        pct(lacking, having + lacking).alias("pct_without_email"),
    )


def coverage_delta(source: DataFrame, bronze: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Bronze minus source, from two one-row coverage frames; ok when the rate moved less than `tolerance`."""
    needed = ["companies_with_email", "total_companies", "pct_with_email"]
    require(source, needed, "source coverage")
    require(bronze, needed, "bronze coverage")
    src = source.select(F.struct(*needed)).scalar()
    now, before = F.col("pct_with_email"), F.col("src.pct_with_email")
    rate = (F.coalesce(cents(now), F.lit(0)) - F.coalesce(cents(before), F.lit(0))) / 100
    moved = bronze.withColumn("src", src).select(
        (F.col("companies_with_email") - F.col("src.companies_with_email")).alias("delta_with"),
        (F.col("total_companies") - F.col("src.total_companies")).alias("delta_total"),
        rate.alias("delta_pct_with"),
    )
    return moved.withColumn("ok", F.abs("delta_pct_with") < tolerance)


def coverage_reconcile(overall: DataFrame, by_source: DataFrame) -> DataFrame:
    """Do the vendor totals add up to the overall figures?"""
    require(overall, COUNTS, "overall coverage")
    require(by_source, COUNTS, "coverage by source")
    rollup = by_source.agg(F.struct(*[F.sum(c).alias(c) for c in COUNTS])).scalar()
    both = overall.withColumn("rollup", rollup).select(
        *[F.col(c).alias(f"overall_{c}") for c in COUNTS], *[F.col(f"rollup.{c}").alias(f"rollup_{c}") for c in COUNTS]
    )
    # Without any vendor row there is nothing to contradict the overall figures.
    differs = F.lit(False)
    for c in COUNTS:
        differs = differs | (F.col(f"rollup_{c}") != F.col(f"overall_{c}"))
    return both.withColumn("matches", ~F.coalesce(differs, F.lit(False)))


def coverage_reconcile_reasons(hub: DataFrame) -> DataFrame:
    """Why the vendor totals of companies exceed the overall total, and by how many.

    An id counts once per vendor there and once overall; rows without an id are one company overall and none
    per vendor. So `total_difference` is the further vendors of ids minus that company. Ids without a vendor
    and repeated hub rows are shown too; they alone change neither total.
    """
    require(hub, ["id", "source"], "hub")
    pairs = hub.groupBy("id", "source").agg(row_count().alias("rows"))
    nameless = ~F.coalesce(non_blank(F.col("source")), F.lit(False))
    per_id = pairs.groupBy("id").agg(
        row_count().alias("vendors"), F.bool_or(nameless).alias("nameless"), F.sum(F.col("rows") - 1).alias("repeated")
    )
    known, zero = F.col("id").isNotNull(), F.lit(0).cast("bigint")
    reasons = per_id.agg(
        F.count_if(known & (F.col("vendors") > 1)).alias("ids_with_several_vendors"),
        F.coalesce(F.sum(F.when(known, F.col("vendors") - 1)), zero).alias("further_vendors"),
        F.count_if(~known).alias("companies_without_id"),
        F.count_if(known & F.col("nameless")).alias("ids_without_vendor"),
        F.coalesce(F.sum("repeated"), zero).alias("repeated_hub_rows"),
    )
    return reasons.withColumn("total_difference", F.col("further_vendors") - F.col("companies_without_id"))


def coverage_reconcile_email_reasons(hub: DataFrame, emails: DataFrame, blank_is_missing: bool = True) -> DataFrame:
    """Why the vendor totals of companies with, and of those without an e-mail exceed the overall figures.

    Two rows. Every further vendor of an id adds one to the vendors' side; so does every further vendor that has rows
    without an id, which are one company without e-mail overall. `difference` is the sum of both.
    """
    require(hub, ["id", "source"], "hub")
    require(emails, ["id", "email"], "emails")
    vendors = hub.select("id", "source").distinct().groupBy("id").agg(row_count().alias("vendors"))
    mailed = emails.where(_present(F.col("email"), blank_is_missing) & F.col("id").isNotNull()).select("id").distinct()
    sides = vendors.unionByName(mailed.withColumn("mailed", F.lit(True)), allowMissingColumns=True)
    per_id = sides.groupBy("id").agg(F.max("vendors").alias("vendors"), F.bool_or("mailed").alias("mailed"))
    known, further = F.col("id").isNotNull(), F.col("vendors") - 1
    having = _has_email()

    def reasons(of_kind: Column, name: str) -> Column:
        listed = of_kind & F.col("vendors").isNotNull()
        by_id, no_id = (F.coalesce(F.sum(F.when(listed & c, further)), F.lit(0)).cast("bigint") for c in (known, ~known))
        return F.struct(
            F.lit(name).alias("companies"),
            F.count_if(listed & known & (further > 0)).alias("ids_with_several_vendors"),
            by_id.alias("further_vendors"),
            no_id.alias("further_vendors_without_id"),
            (by_id + no_id).alias("difference"),
        )

    both = per_id.agg(F.array(reasons(having, "with e-mail"), reasons(~having, "without e-mail")).alias("rows"))
    return both.select(F.inline("rows"))


def vendor_reachout(by_source: DataFrame, threshold: float = 70) -> DataFrame:
    """Flag the vendors whose share of companies without e-mail reaches the threshold, worst first."""
    require(by_source, ["source", "pct_without_email"], "coverage by source")
    flag = F.coalesce(F.col("pct_without_email") >= threshold, F.lit(False))
    return (
        by_source.withColumn("reach_out_flag", flag)
        .withColumn("reach_out_label", F.when(F.col("reach_out_flag"), "Reach out").otherwise("OK"))
        .orderBy(F.desc("pct_without_email"), F.asc_nulls_last("source"))
    )
