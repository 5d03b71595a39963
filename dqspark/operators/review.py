"""Review list of the companies with most e-mails: counts and sorted address lists."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import row_count
from ..plans import hot_keys, key_counts, null_safe_join, salted_join, shuffle_partitions
from .matching import fits, fitting_pairs, usable_addresses, usable_companies

_ROW = ["id", "name", "company_domain"]
_LIST = [*_ROW, "fits"]


def _addresses(emails: DataFrame) -> DataFrame:
    """The usable addresses of each company, equal ones folded into one with `written`."""
    return (
        usable_addresses(emails, False)
        .groupBy("id", "email", "local_part", "email_domain", "local_clean")
        .agg(row_count().alias("written"))
    )


def _largest(companies: DataFrame, addresses: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n ids with most (company, address) pairs, and the n company rows to list.

    Pairs of an id are the product of two counts, so the ranking joins counts only.
    """
    per_id = companies.groupBy("id").agg(F.sum("copies").alias("hub_rows"))
    addressed = addresses.groupBy("id").agg(F.sum("written").alias("rows"))
    ids = (
        per_id.join(addressed, "id")
        .select("id", (F.col("hub_rows") * F.col("rows")).alias("total_emails"))
        .orderBy(F.desc("total_emails"), "id")
        .limit(n)
    )
    order = [F.desc("total_emails"), F.col("id"), F.asc_nulls_last("name"), F.col("company_domain")]
    top = companies.join(F.broadcast(ids), "id").orderBy(*order).limit(n)  # n rows
    return ids, top


def _evaluated(joined: DataFrame) -> DataFrame:
    """The verdict and the number of copies of each company row and address that stand beside each other."""
    return joined.select(*_ROW, "email", fits().alias("fits"), (F.col("copies") * F.col("written")).alias("rows"))


def domain_match_review_addresses(hub: DataFrame, emails: DataFrame, n: int | None = 20) -> DataFrame:
    """The review in long form: one row per company row and distinct address, with its number of copies.

    `n=None` lists all company rows; companies with very many addresses are joined in splits.
    """
    companies, addresses = usable_companies(hub, False, "name"), _addresses(emails)
    if n is None:
        hot = hot_keys(key_counts(emails.select("id"), "id"), "id")
        joined = salted_join(addresses, companies, "id", hot, [F.col("email")])
        listed = _evaluated(joined)
    else:
        listed = _evaluated(addresses.join(F.broadcast(_largest(companies, addresses, n)[1]), "id"))  # n rows
    return listed.groupBy(*_ROW, "email", F.col("fits").alias("is_valid_email")).agg(F.sum("rows").alias("copies"))


def _range_marks(rows: DataFrame, marks: int) -> DataFrame:
    """(list, marks): some addresses of each list in order, which divide it into ranges of about equal size.

    Whether an address is a mark follows from its hash and the length of the list, so that every evaluation finds the
    same ones. A list with fewer addresses than `marks` has each of them as a mark.
    """
    sizes = rows.groupBy(*_LIST).agg(row_count().alias("size"))
    each = F.greatest(F.call_function("div", F.col("size"), F.lit(marks)), F.lit(1).cast("bigint"))
    sampled = null_safe_join(rows, F.broadcast(sizes), _LIST).where(F.pmod(F.xxhash64("email"), each) == 0)  # 2n rows
    return sampled.groupBy(*_LIST).agg(F.array_sort(F.collect_list("email")).alias("marks"))


def _range_number(marks: int) -> Column:
    """How many of the column `marks` are not above `email`: first among every step-th of them, then within one step."""
    step = max(1, isqrt(marks))
    coarse = F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.size("marks") - 1, F.lit(step)).cast("int")),
        lambda i: F.element_at("marks", i * step + 1),
    )
    before = F.greatest(F.size(F.filter(coarse, lambda m: m <= F.col("email"))) - 1, F.lit(0)) * step
    within = F.size(F.filter(F.slice("marks", before + 1, F.lit(step)), lambda m: m <= F.col("email")))
    return F.when(F.size("marks") > 0, before + within).otherwise(0)


def _parts(rows: DataFrame, list_chars: int, block: int, ranges: int = 64) -> DataFrame:
    """(list, list_part, text): sorted lists, cut where the text before an address fills a multiple of `list_chars`.

    What lies before an address follows from the order of the addresses alone: the characters of all lower ranges of
    its list, plus those before it within its own range. Ranges end at sampled addresses, `ranges` of them for each
    partition, so no task walks a whole list, however alike its addresses begin, and the cuts are the same however the
    rows are partitioned.
    """
    marks = ranges * shuffle_partitions(rows)
    marked = null_safe_join(rows, F.broadcast(_range_marks(rows, marks)), _LIST, "left")  # 2n rows of so many addresses
    marked = marked.withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))
    ranged = marked.withColumn("range", _range_number(marks)).drop("marks")
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(block).cast("bigint")))
    blocks = ranged.withColumn("first", first).withColumn("times", F.least(F.lit(block), F.col("rows") - F.col("first")))
    size = (F.length("email") + 2) * F.col("times")

    lower = Window.partitionBy(*_LIST).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*_LIST, "range").agg(F.sum(size).alias("chars"))
    offsets = sums.select(*_LIST, "range", F.coalesce(F.sum("chars").over(lower), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*_LIST, "range").orderBy("email", "first").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    placed = null_safe_join(blocks, offsets, [*_LIST, "range"])
    placed = placed.withColumn("list_part", F.call_function("div", before, F.lit(list_chars)))

    text = F.array_join(F.array_repeat("email", F.col("times").cast("int")), ", ")
    sorted_text = F.array_sort(F.collect_list(F.struct("email", "first", text.alias("text"))))
    return placed.groupBy(*_LIST, "list_part").agg(F.array_join(sorted_text["text"], ", ").alias("text"))


def domain_match_company_review(
    hub: DataFrame, emails: DataFrame, n: int = 20, list_chars: int = 100_000_000, block: int = 10_000
) -> DataFrame:
    """The n largest companies with counts and sorted lists of fitting and other addresses.

    Fitting pairs are counted from equal tokens of spellings and addresses; only the n listed rows stand beside
    addresses. A list goes on in a further row, with the next `list_part`, at each multiple of `list_chars`
    characters (give or take a block of copies), so that no cell outgrows a task and no address is left out.
    """
    companies, addresses = usable_companies(hub, False, "name"), _addresses(emails)
    ids, top = _largest(companies, addresses, n)
    few = F.broadcast(ids.select("id"))  # n rows
    fitting = fitting_pairs(companies.join(few, "id", "left_semi"), addresses.join(few, "id", "left_semi"))
    counted = (
        ids.join(fitting, "id", "left")
        .withColumn("valid_emails", F.coalesce("fitting", F.lit(0).cast("bigint")))
        .select("id", "total_emails", "valid_emails", (F.col("total_emails") - F.col("valid_emails")).alias("invalid_emails"))
    )

    listed = _evaluated(addresses.join(F.broadcast(top), "id"))
    listed = listed.groupBy(*_LIST, "email").agg(F.sum("rows").alias("rows"))
    parts = _parts(listed, list_chars, block).groupBy(*_ROW, "list_part").agg(
        F.max(F.when(F.col("fits"), F.col("text"))).alias("valid_emails_list"),
        F.max(F.when(~F.col("fits"), F.col("text"))).alias("invalid_emails_list"),
    )
    return (
        parts.join(F.broadcast(counted), "id")
        .select(
            *_ROW,
            "total_emails",
            "valid_emails",
            "invalid_emails",
            "valid_emails_list",
            "invalid_emails_list",
            F.when(F.col("valid_emails") > 0, "VALID").otherwise("INVALID").alias("company_email_status"),
            "list_part",
        )
        .orderBy(F.desc("total_emails"), "id", F.asc_nulls_last("name"), "company_domain", "list_part")
    )
