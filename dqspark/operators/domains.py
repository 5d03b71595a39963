"""Reachability of company domains by HTTP status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pct, row_count
from ..schemas import require
from .formats import labelled_counts


def domain_status_distribution(domains: DataFrame) -> DataFrame:
    """Domains answering 200, something else, or without a status; always three rows, one pass."""
    require(domains, ["status_code"], "domains")
    code = F.col("status_code")
    cases = [
        ("Status Code 200", code == 200),
        ("Status Code not 200", code != 200),
        ("Missing Status Code", code.isNull()),
    ]
    return labelled_counts(domains, "status", "domain_count", cases, keep_empty=True)


def domain_status_summary(domains: DataFrame) -> DataFrame:
    """The same in one row; a missing status counts as not 200."""
    require(domains, ["status_code"], "domains")
    total, reached = row_count(), F.count_if(F.col("status_code") == 200)
    return domains.agg(
        total.alias("total_domains"),
        reached.alias("status_200"),
        pct(reached, total).alias("pct_200"),
        (total - reached).alias("non_200"),
        pct(total - reached, total).alias("pct_non_200"),
    )
