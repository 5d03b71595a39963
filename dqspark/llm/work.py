"""What the operators share: tables, written intermediate results, columns computed in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="dqspark-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder, so that later stages neither repeat its work nor lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/dqspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sliced(stream: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in smaller ones, so that Python objects of few texts are alive at a time."""
    for batch in stream:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, T.DataType]],
    compute: Callable[..., list[pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df with further columns, computed for each Arrow batch from the columns named in inputs. Those in drop go."""
    keep = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(keep + [T.StructField(name, kind) for name, kind in fields])
    names, kept = schema.fieldNames(), [f.name for f in keep]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(stream):
            made = compute(*[batch.column(c) for c in inputs])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=names)

    return df.mapInArrow(batches, schema)


def replace_columns(df: DataFrame, source: DataFrame, changed: dict) -> DataFrame:
    """The columns of source in their order, from df, with some replaced by expressions."""
    return df.select(*[changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else df[f"`{f.name}`"] for f in source.schema.fields])
