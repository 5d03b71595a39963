"""Read the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import require


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table stored as files; its columns are checked, and extra ones are left to column pruning."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return require(reader.load(path), schema.fieldNames(), path)


def jdbc_options(
    url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options for a read split into ranges of a numeric column, so that no single task pulls the table."""
    if upper <= lower or partitions < 1:
        raise ValueError("need lower < upper and at least one partition")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_jdbc(spark: SparkSession, schema: T.StructType, credentials: dict[str, str], **options) -> DataFrame:
    """A table of a relational database. Filters and column pruning reach the database."""
    described = jdbc_options(**options)
    frame = spark.read.format("jdbc").options(**described, **credentials).load()
    return require(frame, schema.fieldNames(), described["dbtable"])
