"""The tables of counts of each release, kept as parquet.

A release is a folder of its own. Its tables are written from the release before and the change, so a write that fails
leaves all stored releases as they were; the marker, written last, says that a release is whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.carried import TABLES, Counts, merge_counts

COUNTS, MARKER = "email_dq_counts", "whole"
# Types of the keys; counters are bigint.
_KEY_TYPES = {"id": T.LongType(), "blocked": T.BooleanType()}


def _schema(name: str) -> T.StructType:
    keys, counters = TABLES[name]
    fields = [T.StructField(k, _KEY_TYPES.get(k, T.StringType())) for k in keys]
    return T.StructType(fields + [T.StructField(c, T.LongType()) for c in counters])


def _path(root: str, release: str, name: str) -> str:
    return f"{root}/{COUNTS}/{release}/{name}"


def _whole(spark: SparkSession, root: str, release: str) -> list[str] | None:
    """The tables of a whole release; None where there is no such release."""
    try:
        return [r["name"] for r in spark.read.schema("name string").parquet(_path(root, release, MARKER)).collect()]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_counts(counts: Counts, root: str, release: str) -> None:
    """Store the counts of a new release. An unfinished earlier attempt at it is replaced, a whole release never."""
    spark = next(iter(counts.values())).sparkSession
    if _whole(spark, root, release) is not None:
        raise ValueError(f"release {release} is stored already")
    for name, table in counts.items():
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema(name).fields]
        table.select(*columns).write.mode("overwrite").parquet(_path(root, release, name))
    named = spark.createDataFrame([(name,) for name in counts], "name string")
    named.coalesce(1).write.mode("overwrite").parquet(_path(root, release, MARKER))


def read_counts(spark: SparkSession, root: str, release: str) -> Counts:
    """The stored counts of a whole release."""
    names = _whole(spark, root, release)
    if names is None:
        raise ValueError(f"no whole release {release} is stored")
    return {n: spark.read.schema(_schema(n)).parquet(_path(root, release, n)) for n in TABLES if n in names}


def carry_counts(change: Counts, root: str, before: str, release: str) -> Counts:
    """Store the counts of `release`: those of the release `before` and the signed counts of what has changed since."""
    if before == release:
        raise ValueError("a release cannot follow itself")
    spark = next(iter(change.values())).sparkSession
    write_counts(merge_counts(read_counts(spark, root, before), change), root, release)
    return read_counts(spark, root, release)

