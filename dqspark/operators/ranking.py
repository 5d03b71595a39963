"""Score the e-mails of a company in a country and keep the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    country_key,
    dotted_suffixes,
    email_clean,
    email_domain,
    is_blocked,
    is_valid_email,
    local_part,
    non_blank,
    normalize_domain,
    role_score,
    row_count,
    status_label,
)
from ..functions.text import DELIVERABLE_STATUSES
from ..plans import hot_keys_of, null_safe_join, salted_join
from ..schemas import require

# Points per property; role inboxes bring 10 or 7 (see role_score).
VALID_POINTS, UNIQUE_POINTS, NOT_BLOCKED_POINTS, DOMAIN_POINTS, VERIFIED_POINTS = 50, 15, 15, 10, 5
_GROUP, _ROW = ["id", "country"], ["email", "verification_status"]
# An address as written but for capitals: blanks around it count in its parts.
_WRITTEN = "written"
_TOTAL = "total_emails_for_company_country"
# What stands in the table of company names: a name, or the number of domain rows of the company.
_NAME, _FAN_OUT = 0, 1


def _best(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """The first k rows per key. The limit also runs before the shuffle, so a hot key sends few rows."""
    numbered = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def _emails(emails: DataFrame) -> DataFrame:
    require(emails, ["id", "country", "email", "verification_status"], "emails")
    email = F.col("email")
    return emails.where(non_blank(email)).select(
        "id",
        country_key(F.col("country")).alias("country"),
        F.lower(email).alias(_WRITTEN),
        status_label(F.col("verification_status")).alias("verification_status"),
    )


def _domain_rows(domains: DataFrame) -> DataFrame:
    """(id, company_domain): the usable domain rows."""
    require(domains, ["id", "fqdn"], "domains")
    usable = domains.where(F.col("id").isNotNull() & non_blank(F.col("fqdn")) & F.col("fqdn").contains("."))
    return usable.select("id", normalize_domain(F.col("fqdn")).alias("company_domain"))


def _named_rows(rows: DataFrame) -> DataFrame:
    """(id, kind, name, own, below): domain rows with exactly this name, and with a name below it; and per company one
    row that counts all of its rows. An e-mail domain is related to `own` of each of its dotted suffixes and to `below`
    of its whole name, so one equi-join finds both directions and the total."""
    suffixes = dotted_suffixes(F.col("company_domain"))
    names = F.transform(
        suffixes,
        lambda s, i: F.struct(F.lit(_NAME).alias("kind"), s.alias("name"), (i == 0).cast("int").alias("own"), (i > 0).cast("int").alias("below")),
    )
    whole = F.struct(F.lit(_FAN_OUT).alias("kind"), F.lit("").alias("name"), F.lit(1).alias("own"), F.lit(0).alias("below"))
    return (
        rows.select("id", F.inline(F.concat(names, F.array(whole))))
        .groupBy("id", "kind", "name")
        .agg(F.sum("own").alias("own"), F.sum("below").alias("below"))
    )


def _with_company(few: DataFrame, domains: DataFrame, hot: DataFrame) -> DataFrame:
    """`few` with `related` and `fan_out`: how many domain rows of the company fit the e-mail domain, and how many there
    are. Rows of hot companies meet their names in splits, then come together again by their own columns."""
    wanted = F.transform(
        dotted_suffixes(F.col("email_domain")),
        lambda s, i: F.struct(F.lit(_NAME).alias("kind"), s.alias("name"), (i == 0).alias("whole")),
    )
    fan_out = F.struct(F.lit(_FAN_OUT).alias("kind"), F.lit("").alias("name"), F.lit(False).alias("whole"))
    asked = few.select("*", F.inline(F.concat(wanted, F.array(fan_out))))
    met = salted_join(asked, _named_rows(_domain_rows(domains)), "id", hot, [F.col(c) for c in _ROW], "left", ["kind", "name"])
    found = F.col("own") + F.when(F.col("whole"), F.col("below")).otherwise(0)
    return met.groupBy(*few.columns).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == _NAME, found)), F.lit(0)).alias("related"),
        F.coalesce(F.sum(F.when(F.col("kind") == _FAN_OUT, F.col("own"))), F.lit(1)).alias("fan_out"),
    )


def _totals(counts: DataFrame, domains: DataFrame, dedupe_domains: bool, min_total: int) -> DataFrame:
    """(id, country, total) of the groups with at least `min_total` rows, from (id, country, rows)."""
    groups = counts.groupBy(*_GROUP).agg(F.sum("rows").alias("rows"))
    if dedupe_domains:
        total = F.col("rows")
    else:
        fan_out = _domain_rows(domains).groupBy("id").agg(row_count().alias("of_company"))
        groups = groups.join(fan_out, "id", "left")
        total = F.col("rows") * F.coalesce("of_company", F.lit(1).cast("bigint"))
    return groups.select(*_GROUP, total.alias(_TOTAL)).where(F.col(_TOTAL) >= min_total)


def _folded(rows: DataFrame) -> DataFrame:
    """(id, country, address as written, status, rows): equal rows as one."""
    return rows.groupBy(*_GROUP, _WRITTEN, "verification_status").agg(row_count().alias("rows"))


def _few_per_domain(folded: DataFrame, k: int) -> DataFrame:
    """The distinct (address, status) rows that can be among the best k of their group, scored but for the domain.

    Within an e-mail domain of a group only the domain's points are open, and these are equal for all, so the best k of
    each domain suffice.
    """
    cleaned = folded.withColumn("email_clean", email_clean(F.col(_WRITTEN)))
    of_address = Window.partitionBy(*_GROUP, "email_clean")
    status, clean, local = F.col("verification_status"), F.col("email_clean"), local_part(F.col(_WRITTEN), trimmed=False)
    flagged = cleaned.withColumn("is_duplicate_within_company", (F.sum("rows").over(of_address) > 1).cast("int")).select(
        *_GROUP,
        F.trim(_WRITTEN).alias("email"),
        "verification_status",
        _WRITTEN,
        "email_clean",
        "rows",
        "is_duplicate_within_company",
        email_domain(F.col(_WRITTEN), trimmed=False).alias("email_domain"),
        is_valid_email(clean).cast("int").alias("is_valid_format"),
        is_blocked(clean).cast("int").alias("is_blocked"),
        (role_score(local) + F.when(status.isin(*DELIVERABLE_STATUSES), VERIFIED_POINTS).otherwise(0)).alias("person"),
    )
    score = (
        F.col("is_valid_format") * VALID_POINTS
        + (1 - F.col("is_duplicate_within_company")) * UNIQUE_POINTS
        + (1 - F.col("is_blocked")) * NOT_BLOCKED_POINTS
        + F.col("person")
    )
    scored = flagged.withColumn("score", score).drop("person")
    return _best(scored, [*_GROUP, "email_domain"], [F.desc("score"), clean, *_ROW], k).drop("_rank")


def priority_top_emails(
    emails: DataFrame,
    domains: DataFrame,
    k: int = 5,
    min_total: int = 100,
    n: int | None = 50,
    dedupe_domains: bool = False,
) -> DataFrame:
    """The k best e-mails per (company, country) with at least `min_total` rows; the first n result rows.

    A company with several domain rows has each e-mail once per domain row, in the total and in the
    ranking; `dedupe_domains` keeps every e-mail once. `n=None` returns all groups.

    Equal rows are folded into counts by company, country, address and status; all else follows from that one shuffle.
    Every group gives at least one result row, so n groups suffice: they are picked from counts, and only their e-mails
    are folded. Without n, the totals come from the folded rows and join the k rows that a group has left. A hot group
    is cut to k rows per task before each shuffle, and meets its company's names in splits.
    """
    base = _emails(emails)
    group_order = [F.desc(_TOTAL), F.asc_nulls_last("id"), F.col("country")]
    if n is None:
        folded = _folded(base)
        groups = _totals(folded, domains, dedupe_domains, min_total)
    else:
        counts = base.groupBy(*_GROUP).agg(row_count().alias("rows"))
        groups = F.broadcast(_totals(counts, domains, dedupe_domains, min_total).orderBy(*group_order).limit(n))  # n rows
        folded = _folded(null_safe_join(base, groups.select(*_GROUP), _GROUP, "left_semi"))

    # Reading the counts here too keeps the shuffle behind `folded` the same in all its uses, so that it runs once.
    hot = hot_keys_of(folded.where(F.col("rows") > 0), "id")
    matched = _with_company(_few_per_domain(folded, k), domains, hot)
    if dedupe_domains:
        matched = matched.withColumns({"related": F.least("related", F.lit(1)), "fan_out": F.lit(1)})
    # One row per copy and joined domain row, of which never more than k can be among the best k.
    several = F.least("rows", F.lit(k))
    hits = F.array_repeat(F.lit(1), F.least(F.col("related") * several, F.lit(k)).cast("int"))
    misses = F.array_repeat(F.lit(0), F.least((F.col("fan_out") - F.col("related")) * several, F.lit(k)).cast("int"))
    copies = matched.withColumn("domain_match", F.explode(F.concat(hits, misses)))
    copies = copies.withColumn("priority_score", F.col("score") + F.col("domain_match") * DOMAIN_POINTS)
    order = [F.desc("priority_score"), F.col("email_clean"), *_ROW, F.desc("domain_match")]
    ranked = null_safe_join(_best(copies, _GROUP, order, k, "email_rank"), groups, _GROUP).select(
        *_GROUP,
        _TOTAL,
        "email_rank",
        "priority_score",
        "email",
        "is_valid_format",
        "is_duplicate_within_company",
        "is_blocked",
        "domain_match",
        "verification_status",
    )
    ranked = ranked.orderBy(*group_order, "email_rank")
    return ranked if n is None else ranked.limit(n)
