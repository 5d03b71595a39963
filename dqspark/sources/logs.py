"""The run log and the metric log, kept as parquet.

Runs are appended. Metrics are partitioned by run_id: an upsert rewrites the partitions of the runs it
touches and no others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import upsert_metrics
from ..schemas import METRIC_LOG, RUN_LOG, require

RUNS, METRICS = "email_dq_runs", "email_dq_metrics"


def _aligned(df: DataFrame, schema) -> DataFrame:
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, f"{root}/{RUNS}", RUN_LOG)


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, f"{root}/{METRICS}", METRIC_LOG)


def new_run(spark: SparkSession, release_label: str | None, created_by: str | None, notes: str | None) -> DataFrame:
    """One run row with a fresh id, stamped now."""
    run = spark.range(1).select(
        F.expr("uuid()").alias("run_id"),
        F.current_timestamp().alias("run_ts"),
        F.lit(release_label).alias("release_label"),
        F.lit(created_by).alias("created_by"),
        F.lit(notes).alias("notes"),
    )
    return _aligned(run, RUN_LOG)


def append_runs(runs: DataFrame, root: str) -> None:
    require(runs, ["run_id", "run_ts"], "runs")
    _aligned(runs, RUN_LOG).write.mode("append").parquet(f"{root}/{RUNS}")


def save_metrics(metrics: DataFrame, root: str, run_ids: Iterable[str] | None = None) -> None:
    """Insert or replace metric rows by (run_id, metric_key).

    Only the partitions of run_ids are read and written; rows of other runs in `metrics` are not saved. Without run_ids
    they are those in `metrics`, which are then computed once more. Stored files are replaced after all reads, when the
    write commits. Of two writers to one run the last wins.
    """
    spark = metrics.sparkSession
    if "details" in metrics.columns:
        metrics = metrics.withColumn("details_json", F.to_json("details"))
    new = _aligned(metrics, METRIC_LOG)
    runs = [r["run_id"] for r in new.select("run_id").distinct().collect()] if run_ids is None else list(run_ids)
    of_runs = F.col("run_id").isin(runs)
    (
        upsert_metrics(read_metrics(spark, root).where(of_runs), new.where(of_runs))
        .repartition("run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(f"{root}/{METRICS}")
    )
