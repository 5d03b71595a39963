"""Input tables and the check that a frame carries the columns an operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


COMPANY_HUB = _struct(
    ("id", T.LongType()),
    ("name", T.StringType()),
    ("source", T.StringType()),
    ("fqdn", T.StringType()),
)

COMPANY_EMAILS = _struct(
    ("id", T.LongType()),
    ("country", T.StringType()),
    ("email", T.StringType()),
    ("verification_status", T.StringType()),
)

COMPANY_DOMAINS = _struct(
    ("id", T.LongType()),
    ("fqdn", T.StringType()),
    ("website", T.StringType()),
    ("country", T.StringType()),
    ("status_code", T.IntegerType()),
)

SOURCE_PERSONA = _struct(
    ("id", T.LongType()),
    ("slug", T.StringType()),
    ("source", T.StringType()),
    ("status", T.StringType()),
)

SOURCE_EMAILS = _struct(("slug", T.StringType()), ("email", T.StringType()))

RUN_LOG = _struct(
    ("run_id", T.StringType()),
    ("run_ts", T.TimestampType()),
    ("release_label", T.StringType()),
    ("created_by", T.StringType()),
    ("notes", T.StringType()),
)

METRIC_LOG = _struct(
    ("run_id", T.StringType()),
    ("metric_key", T.StringType()),
    ("metric_label", T.StringType()),
    ("value_num", T.DoubleType()),
    ("value_pct", T.DoubleType()),
    ("severity", T.StringType()),
    ("details_json", T.StringType()),
)


class MissingColumns(ValueError):
    """Raised at plan time when an input lacks columns."""


def require(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Return `df`, or fail naming the columns that `table` lacks."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing:
        raise MissingColumns(f"{table} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df
