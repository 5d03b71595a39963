"""Approximate nearest neighbours by cross-polytope hashing.

A rotation is three rounds of random signs and a fast Hadamard transform; it assigns a unit vector to the nearest signed
axis. The key of a table is a pair of axes, from two rotations. A query probes, in each table, the keys that its own
rotations lie nearest to. Rows and queries are dealt to the first axis of their keys and meet by the second one inside
a task; the rows of the probed keys are candidates, ranked by exact cosine on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import sliced, written

_FOUND = "query_id long, vec_id long, score double"
_CELL = ["length", "table", "cell"]
_SPLIT = [*_CELL, "row_split", "query_split"]


class Tables:
    """tables independent hashes of vectors of one length, each a pair of axes."""

    def __init__(self, length: int, tables: int, seed: int):
        self.width = max(2, 1 << (length - 1).bit_length())
        random = np.random.default_rng([seed, length])
        self.signs = random.choice(np.array([-1.0, 1.0], np.float32), (2 * tables, 3, self.width))

    def rotated(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """Each table's rotation of these rows."""
        padded = np.zeros((len(vectors), self.width), np.float32)
        padded[:, : vectors.shape[1]] = vectors
        for rounds in self.signs:
            x = padded
            for signs in rounds:
                x, half = x * signs, 1
                while half < self.width:
                    pairs = x.reshape(len(x), -1, 2, half)
                    x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
                    half *= 2
            yield x

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """For each row its key in each table: the first axis times twice the width, plus the second."""
        axes = []
        for x in self.rotated(vectors):
            axis = np.abs(x).argmax(axis=1)
            axes.append(np.where(x[np.arange(len(x)), axis] < 0, axis + self.width, axis))
        return np.stack([first * 2 * self.width + second for first, second in zip(axes[::2], axes[1::2], strict=True)], axis=1)

    def probes(self, vectors: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """For each table the n keys whose axes each row lies nearest to, by the squared shortfalls behind its own two."""
        ranked = []
        for x in self.rotated(vectors):
            nearness = np.concatenate([x, -x], axis=1)
            axes = np.argsort(-nearness, axis=1, kind="stable")[:, :n]
            nearness = np.take_along_axis(nearness, axes, axis=1)
            ranked.append((axes, (nearness[:, :1] - nearness) ** 2))
        for (first, behind), (second, behind2) in zip(ranked[::2], ranked[1::2], strict=True):
            # A pair of places i and j from 1 on has i * j pairs at least as near, so only those up to n can be among the n.
            i, j = np.nonzero(np.outer(np.arange(1, first.shape[1] + 1), np.arange(1, second.shape[1] + 1)) <= n)
            best = np.argsort(behind[:, i] + behind2[:, j], axis=1, kind="stable")[:, :n]
            a, b = i[best], j[best]
            yield np.take_along_axis(first, a, axis=1) * 2 * self.width + np.take_along_axis(second, b, axis=1)


def usable(vector: str) -> Column:
    """Whether a vector has a direction: neither null nor empty nor zero, all of its components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(float), starts[:-1], np.diff(starts)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch with columns id and vector, by length: which rows, and their unit vectors."""
    values, starts, lengths = _lists(batch.column("vector"))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        vectors = values[starts[rows][:, None] + np.arange(length)]
        yield rows, vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _compared(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns query_id, vec_id, score of the k rows nearest to each query, ties included, and perhaps some more."""
    norms, own = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    rough = (queries / own[:, None]) @ (vectors / norms[:, None]).T
    near = np.ones(rough.shape, bool)
    order = np.argsort(ids, kind="stable")
    firsts = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] - 1))
    if len(firsts) > k:
        once = rough if len(firsts) == len(ids) else np.maximum.reduceat(rough[:, order], firsts, axis=1)
        near = rough >= np.partition(once, -k, axis=1)[:, -k, None] - 1e-9
    q, x = np.nonzero(near)
    return [query_ids[q], ids[x], (queries[q] * vectors[x]).sum(axis=1) / (own[q] * norms[x])]


def _best(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best rows of each query; of rows that repeat an id, the best one counts."""
    order = np.lexsort((-columns[2], columns[1], columns[0]))
    query, rows, score = (c[order] for c in columns)
    again = np.append(False, (query[1:] == query[:-1]) & (rows[1:] == rows[:-1]))[: len(query)]
    columns = [c[~again] for c in (query, rows, score)]
    order = np.lexsort((columns[1], -columns[2], columns[0]))
    query, rows, score = (c[order] for c in columns)
    first = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return [c[place < k] for c in (query, rows, score)]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, tables: int = 20, probes: int = 130, block: int = 8192, seed: int = 7) -> DataFrame:
    """For each row whose vec_id is divisible by every: its k nearest among all other rows, as far as they are candidates.
    A query with fewer than k candidates is compared with all rows instead.

    Rows without a vec_id or a usable vector take no part; vectors of another length are no candidates of a query. Ties
    go to the smaller vec_id; repeated rows of an id count once, and of a query's the least vector is its own. Of equal
    vectors the k + 1 smallest ids are searched, which suffice, and equal queries are searched once, so groups of copies
    make no crowded keys. Other crowded cells are cut into blocks of about block rows and queries, which bounds what a
    task holds; candidates are never rows of a table, only the best of each query and cell are. An empty table gives
    no rows.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    exact = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    usable_rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    rows = usable_rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(exact).alias("vector"))
    queries = written(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")), "neighbour-queries")
    heads = written(queries.groupBy("vector").agg(F.min("id").alias("id")), "neighbour-heads")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    rows = rows.dropDuplicates(["id", "vector"]).withColumn("place", place).where(F.col("place") <= k + 1).select("id", "vector")
    keyed = written(_keyed(rows, tables, seed), "neighbour-keys")
    length = F.size("vector").alias("length")
    width = F.expr("2 * shiftleft(1L, greatest(1, cast(ceil(log2(length)) AS int)))")
    dealt = keyed.select("id", "vector", length, F.posexplode("keys").alias("table", "key"))
    dealt = dealt.select(*_CELL[:2], F.expr("key").alias("key"), "id", "vector", width.alias("width"))
    dealt = dealt.select(*_CELL[:2], F.expr("cast(key div width AS int) AS cell"), F.expr("cast(key % width AS int) AS sub"), "id", "vector")
    found = written(_ranked(_met(dealt, _asked(heads, tables, probes, seed), k + 1, block), queries, heads, k), "neighbours")
    short = queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if short.isEmpty():
        return found
    short = written(short, "neighbour-rest")
    short_heads = written(short.groupBy("vector").agg(F.min("id").alias("id")), "neighbour-rest-heads")
    anywhere = [length, F.lit(0).alias("table"), F.lit(0).alias("cell")]
    every_row = keyed.select(*anywhere, F.lit(0).alias("sub"), "id", "vector")
    whole = _met(every_row, short_heads.select(*anywhere, F.array(F.lit(0)).alias("subs"), "id", "vector"), k + 1, block)
    full = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return full.unionByName(_ranked(whole, short, short_heads, k))


def _keyed(rows: DataFrame, tables: int, seed: int) -> DataFrame:
    """id, vector and the vector's key in each table."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(stream, 2000):
            keys: list = [None] * len(batch)
            for chosen, unit in _by_length(batch):
                for row, own in zip(chosen, Tables(unit.shape[1], tables, seed).keys(unit), strict=True):
                    keys[row] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["id", "vector", "keys"])

    return rows.mapInArrow(batches, T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


def _asked(queries: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """Each query once per cell that it probes, with the second axes of its probes there."""
    schema = T.StructType([*[T.StructField(c, T.IntegerType()) for c in _CELL], T.StructField("subs", T.ArrayType(T.IntegerType())), *queries.select("id", "vector").schema.fields])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(stream):
            for chosen, unit in _by_length(batch):
                hashes = Tables(unit.shape[1], tables, seed)
                for n, keys in enumerate(hashes.probes(unit, probes)):
                    keys = np.sort(keys, axis=1)
                    cell, sub = np.divmod(keys.ravel(), 2 * hashes.width)
                    row = np.repeat(chosen, keys.shape[1])
                    starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                    subs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(sub, pa.int32()))
                    where = pa.array(row[starts])
                    constant = [pa.array(np.full(len(starts), v, np.int32)) for v in (unit.shape[1], n)]
                    columns = [*constant, pa.array(cell[starts], pa.int32()), subs, batch.column("id").take(where), batch.column("vector").take(where)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return queries.select("id", "vector").mapInArrow(batches, schema)


def _met(dealt: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: of each query and block of a cell the k nearest rows whose second axis it probes."""

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    sizes = written(blocks(dealt, "row_splits").join(blocks(asked, "query_splits"), _CELL), "neighbour-cells")

    def split(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "table"), F.col(f"{own}s")).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        return side.join(sizes, _CELL).select("*", mine, each).drop("row_splits", "query_splits")

    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]]
        if len(rows) and len(queries):
            own, length = rows.combine_chunks(), rows.column("length")[0].as_py()
            ids, subs = (own.column(c).to_numpy() for c in ("id", "sub"))
            vectors = _matrix(own, length)
            queries = queries.combine_chunks()
            query_ids, asking = queries.column("id").to_numpy(), _matrix(queries, length)
            probed, _, count = _lists(_one_chunk(queries.column("subs")))
            asker = np.repeat(np.arange(len(queries)), count)
            by_row, by_probe = np.argsort(subs, kind="stable"), np.argsort(probed, kind="stable")
            sorted_rows, sorted_probes, asker = subs[by_row], probed[by_probe], asker[by_probe]
            for sub in np.unique(subs):
                r = by_row[slice(*np.searchsorted(sorted_rows, [sub, sub + 1]))]
                q = asker[slice(*np.searchsorted(sorted_probes, [sub, sub + 1]))]
                if len(q):
                    parts.append(_best(_compared(query_ids[q], asking[q], ids[r], vectors[r], k), k))
        best = _best([np.concatenate(c) for c in zip(*parts, strict=True)], k)
        return pa.table([pa.array(c) for c in best], names=["query_id", "vec_id", "score"])

    left, right = split(dealt, "row_split", "query_split"), split(asked, "query_split", "row_split")
    return left.groupBy(*_SPLIT).cogroup(right.groupBy(*_SPLIT)).applyInArrow(compare, _FOUND)


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _matrix(rows: pa.Table, length: int) -> np.ndarray:
    values, starts, _ = _lists(_one_chunk(rows.column("vector")))
    return values[starts[:, None] + np.arange(length)]


def _ranked(met: DataFrame, queries: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; met tells k + 1 of each head, which stands
    for all queries with its vector."""
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", place).where(F.col("place") <= k + 1)
    told = best.groupBy("query_id").agg(F.collect_list(F.struct("score", "vec_id")).alias("told"))  # k + 1 at most
    own = queries.select("vector", F.col("id").alias("asking")).join(heads.withColumnRenamed("id", "query_id"), "vector")
    others = own.join(told, "query_id").select(F.col("asking").alias("query_id"), F.inline("told")).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
