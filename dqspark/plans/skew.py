"""Joins that stay balanced when a few keys hold a large share of the rows.

A key is hot when it holds more rows than an average shuffle partition. With P partitions there are
fewer than P hot keys, so the frame of hot keys is small enough to broadcast whatever the data size.
Each hot key is cut into as many splits as it fills average partitions, and the other side repeats its
rows for that key once per split: at most 2P further rows when the key is unique there. Choose
`spark.sql.shuffle.partitions` with the data: with 200 partitions for 100 TB, a key is hot above 500 GB only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLITS, _SALT = "_splits", "_salt"


def shuffle_partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def hot_keys(counts: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """(key, _splits) for the hot keys of a frame with one (key, rows) row per key."""
    parts = shuffle_partitions(counts)
    total = counts.agg(F.sum(rows)).scalar()
    share = F.col(rows) * parts / total
    hot = counts.where(F.col(key).isNotNull() & (share > 1)).select(F.struct(key, F.ceil(share).cast("int")).alias("entry"))
    return _unfolded(hot.agg(F.map_from_entries(F.collect_list("entry"))), key)


def hot_keys_of(df: DataFrame, key: str) -> DataFrame:
    """(key, _splits) for the hot keys of rows that are read once for it: keys and total come from one rollup."""
    parts = shuffle_partitions(df)
    counts = df.rollup(key).agg(F.grouping(key).alias("whole"), F.count(F.lit(1)).alias("rows"))
    # The total, a NULL key, and fewer than `parts` hot keys.
    few = counts.orderBy(F.desc("whole"), F.desc("rows"), key).limit(parts + 1)
    found = few.agg(
        F.max(F.when(F.col("whole") == 1, F.col("rows"))).alias("total"),
        F.collect_list(F.when((F.col("whole") == 0) & F.col(key).isNotNull(), F.struct(key, "rows"))).alias("found"),
    )
    hot = F.filter("found", lambda x: x["rows"] * parts > F.col("total"))
    entries = F.transform(hot, lambda x: F.struct(x[key], F.ceil(x["rows"] * parts / F.col("total")).cast("int")))
    return _unfolded(found.select(F.map_from_entries(entries)), key)


def _unfolded(one_map: DataFrame, key: str) -> DataFrame:
    """The entries of a single map as rows. It is a scalar subquery, which Spark runs once for all its uses."""
    one = one_map.sparkSession.range(0, 1, 1, 1)
    return one.select(F.explode(one_map.scalar()).alias(key, _SPLITS))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def salted_join(
    big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: list[Column], how: str = "inner", also: tuple[str, ...] | list[str] = ()
) -> DataFrame:
    """`big` joined to `small` on `key`, with the hot keys of `big` cut into splits. `also` names further join columns.

    `spread` decides the split of a row. The number of the input partition is mixed in, so equal copies
    of one row also spread; both are fixed for a task, so a retried task repeats its choice. NULL keys
    find no partner and spread over all partitions.
    """
    no_partner = F.when(F.col(key).isNull(), shuffle_partitions(big))
    big_splits = F.coalesce(no_partner, F.col(_SPLITS), F.lit(1))
    salt = F.pmod(F.xxhash64(*spread, F.spark_partition_id()), big_splits).cast("int")
    left = big.join(F.broadcast(hot), key, "left").withColumn(_SALT, salt).drop(_SPLITS)
    last = F.coalesce(F.col(_SPLITS), F.lit(1)) - 1
    right = (
        small.join(F.broadcast(hot), key, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), last)))
        .drop(_SPLITS)
    )
    return left.join(right, [key, *also, _SALT], how).drop(_SALT)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where NULL equals NULL; the keys of `left` are kept."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{c}" for c in keys])
