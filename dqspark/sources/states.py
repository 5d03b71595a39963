"""The state of each run, kept as parquet by run_id, so that a release reads the run before it and no others.

A state has one row per metric known so far. Saving a run reads its metrics and the state of the run before. A late run,
older than some that are stored, also renews the states after it, up to the first one that stays as it was.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import STATE, release_state
from .logs import read_metrics, read_runs

STATES = "email_dq_states"
_SCHEMA = T.StructType(
    [
        T.StructField("metric_key", T.StringType()),
        T.StructField("has_value", T.BooleanType()),
        *[T.StructField(c, T.DoubleType()) for c in ("value_pct", "prev_pct", "last_pct")],
        T.StructField("run_id", T.StringType()),
    ]
)


def read_states(spark: SparkSession, root: str, run_ids: Iterable[str] | None = None) -> DataFrame:
    """The states of these runs, or of all; other partitions are not read."""
    try:
        stored = spark.read.schema(_SCHEMA).parquet(f"{root}/{STATES}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], _SCHEMA)
    return stored if run_ids is None else stored.where(F.col("run_id").isin(list(run_ids)))


def _write(state: DataFrame, root: str, run_id: str) -> None:
    (
        state.withColumn("run_id", F.lit(run_id))
        .coalesce(1)  # a row per metric
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(f"{root}/{STATES}")
    )


def _differs(a: DataFrame, b: DataFrame) -> bool:
    return not a.select(*STATE).exceptAll(b.select(*STATE)).isEmpty() or not b.select(*STATE).exceptAll(a.select(*STATE)).isEmpty()


def save_state(spark: SparkSession, root: str, run_id: str) -> list[str]:
    """Store the state of a logged run whose metrics are saved; the ids of the runs that were written.

    The run log has one row per run and says their order, by time, then id. Runs without a stored state are passed
    over: they take part once they are saved, in whatever order. Saving a run again renews it and what follows from it.
    """
    ordered = [r["run_id"] for r in read_runs(spark, root).select("run_ts", "run_id").orderBy("run_ts", "run_id").collect()]
    if run_id not in ordered:
        raise ValueError(f"run {run_id} is not in the run log")
    stored = {r["run_id"] for r in read_states(spark, root).select("run_id").distinct().collect()}
    at = ordered.index(run_id)
    before = next((r for r in reversed(ordered[:at]) if r in stored), None)

    def of_run(run: str) -> DataFrame:
        return read_metrics(spark, root).where(F.col("run_id") == run)

    state = release_state(read_states(spark, root, [before] if before else []), of_run(run_id))
    _write(state, root, run_id)
    written, last = [run_id], run_id
    for run in (r for r in ordered[at + 1 :] if r in stored):
        old = read_states(spark, root, [run])
        new = release_state(read_states(spark, root, [last]), old.where("has_value"))
        if not _differs(new, old):
            break
        rows = new.collect()  # a row per metric, from before its files are replaced
        _write(spark.createDataFrame(rows, new.schema), root, run)
        written.append(run)
        last = run
    return written
