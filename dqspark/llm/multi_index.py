"""Hard-negative mining by an inverted multi-index.

Rows are dealt to shards. In a shard, the two halves of the vectors each have a codebook; a row's two codewords name its
cell. For a query, a half's codeword bounds the score of that half: its inner product plus the query's norm times the
codeword's radius, rounded up. A heap walks the pairs of codewords by falling sum of bounds; rows of a cell are scored
exactly, in integers. A walk ends once no cell left can change what is asked for: the best k, or the best k within a
window of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import written

#: Components become floor(256 * x), the label of each seventh row the next of ten, positives weigh 80 to 100 hundredths.
SCALE, NOISY, LABELS, ANCHORS, LOW, HIGH = 256, 7, 10, 100, 80, 100
#: Scaled components up to this size: inner products of 2^20 dimensions then fit in 63 bits.
LARGEST = 1 << 21
_FOUND = "anchor_id long, anchor_key long, slot int, row_id long, row_key long, score long"


class Codebook:
    """Codewords of a half of the vectors of a shard, the radius around each, and each row's codeword."""

    def __init__(self, rows: np.ndarray, size: int, rounds: int = 6, sample: int = 4096):
        own = rows.astype(float)
        chosen = own[np.linspace(0, len(own) - 1, min(sample, len(own))).astype(int)]
        centres = chosen[np.linspace(0, len(chosen) - 1, min(size, len(chosen))).astype(int)]
        for _ in range(rounds):
            nearest = self._nearest(chosen, centres)
            counts = np.bincount(nearest, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, chosen)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        self.centres = np.floor(centres).astype(np.int64)
        self.code = self._nearest(own, self.centres.astype(float))
        apart = ((rows - self.centres[self.code]) ** 2).sum(axis=1)  # exact
        squares = np.zeros(len(self.centres), np.int64)
        np.maximum.at(squares, self.code, apart)
        self.radii = _roots(squares)

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """What the inner product of the query with a row of each codeword does not exceed."""
        norm = isqrt(int((query * query).sum()))
        return self.centres @ query + (norm + 1) * self.radii


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded up."""
    return np.array([isqrt(s - 1) + 1 if s else 0 for s in squares.tolist()], np.int64)


class Index:
    """The inverted multi-index of a shard's vectors of one length."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codewords: int = 32):
        half = vectors.shape[1] // 2
        size = min(codewords, isqrt(len(ids) // 32) + 1)  # cells of some 32 rows
        self.halves = [Codebook(part, size) for part in (vectors[:, :half], vectors[:, half:])]
        first, second = (h.code for h in self.halves)
        self.shape = tuple(len(h.centres) for h in self.halves)
        cell = first * self.shape[1] + second
        order = np.lexsort((keys, ids, cell))
        self.ids, self.keys, self.labels, self.vectors = ids[order], keys[order], labels[order], vectors[order]
        self.starts = np.searchsorted(cell[order], np.arange(self.shape[0] * self.shape[1] + 1))

    def cells(self, query: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bound, first row, last row) of the cells that hold rows, by falling bound: a multi-sequence walk."""
        half = self.halves[0].centres.shape[1]
        sides = [h.bounds(q) for h, q in zip(self.halves, (query[:half], query[half:]), strict=True)]
        orders = [np.argsort(-s, kind="stable").tolist() for s in sides]
        falling = [s[o].tolist() for s, o in zip(sides, orders, strict=True)]
        heap = [(-falling[0][0] - falling[1][0], 0, 0)]
        while heap:
            bound, i, j = heappop(heap)
            cell = orders[0][i] * self.shape[1] + orders[1][j]
            a, b = self.starts[cell], self.starts[cell + 1]
            if a < b:
                yield -bound, int(a), int(b)
            # Each row i goes on to the right by one; the next row opens with the first of this one.
            if j + 1 < len(orders[1]):
                heappush(heap, (-falling[0][i] - falling[1][j + 1], i, j + 1))
            if j == 0 and i + 1 < len(orders[0]):
                heappush(heap, (-falling[0][i + 1] - falling[1][0], i + 1, 0))

    def search(self, query: np.ndarray, own: tuple[int, int], label: int, same: bool, windows: list[tuple[int, int]], k: int) -> tuple[list[list[tuple[int, int, int]]], int]:
        """For each window (low, high) of scores, the k best rows within it as (-score, id, key), ties by id; and how many
        rows were scored. same says whether rows of the label are wanted or the others. own, (id, key), is left out."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        going, scored = {w for w, (low, high) in enumerate(windows) if low <= high}, 0
        for bound, rows in self._together(query):
            # Certified: below its low end, or with k rows of which none can be beaten or tied any more.
            going = {w for w in going if bound >= windows[w][0] and not (len(found[w]) == k and bound < -found[w][-1][0])}
            if not going:
                break
            wanted = rows[(self.labels[rows] == label) == same]
            scores = self.vectors[wanted] @ query
            scored += len(rows)
            for w in going:
                low = max(windows[w][0], -found[w][-1][0]) if len(found[w]) == k else windows[w][0]
                hits = np.flatnonzero((scores >= low) & (scores <= windows[w][1]))
                if len(hits) > k + 1:  # own may be among them
                    least = np.partition(scores[hits], -k - 1)[-k - 1]
                    hits = hits[scores[hits] >= least]
                if len(hits):
                    at = wanted[hits]
                    fresh = zip((-scores[hits]).tolist(), self.ids[at].tolist(), self.keys[at].tolist(), strict=True)
                    found[w] = sorted([*found[w], *(x for x in fresh if x[1:] != own)])[:k]
        return found, scored

    def _together(self, query: np.ndarray, least: int = 128, most: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
        """(bound, rows): the rows of a few cells at a time, by falling bound, and the bound of the first of these cells.
        The further the walk, the more cells are scored together."""
        waiting, size, first = [], 0, 0
        for bound, a, b in self.cells(query):
            first = first if waiting else bound
            waiting.append(np.arange(a, b))
            size += b - a
            if size >= least:
                yield first, np.concatenate(waiting)
                waiting, size, least = [], 0, min(2 * least, most)
        if waiting:
            yield first, np.concatenate(waiting)


# --- rows, shards and walks -------------------------------------------------------------------------


def prepared(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, key, label, vector): the different rows that take part, with noisy labels and integer components.

    Rows without an id or a label, without a vector, or with a null or non-finite component take no part, nor do those
    whose scaled components exceed 2^21, whose products 63 bits might not hold. key tells rows of one id apart.
    """
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST // SCALE))
    usable = vectors.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.coalesce(whole, F.lit(False)))
    noisy = F.when(F.col(id_column) % NOISY == 0, (F.col(label) + 1) % LABELS).otherwise(F.col(label))
    rows = usable.select(F.col(id_column).cast("long").alias("id"), noisy.cast("long").alias("label"), ints.cast("array<long>").alias("vector")).distinct()
    return rows.select("id", F.xxhash64("id", "label", "vector").alias("key"), "label", "vector")


def _walks(rows: DataFrame, queries: DataFrame, shards: int, codewords: int, k: int, same: bool) -> DataFrame:
    """anchor_id, anchor_key, slot, row_id, row_key, score: what each shard finds for each window of each query.

    A shard's rows come first and make its index; the queries, sent to all shards, then walk it one by one.
    """
    dealt = F.pmod(F.xxhash64("id", "key"), F.lit(shards)).cast("int").alias("shard")
    own = rows.select(dealt, F.lit(0).alias("kind"), "id", "key", "label", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = queries.select(every, F.lit(1).alias("kind"), "id", "key", "label", "vector", "lows", "highs")
    both = own.unionByName(asked, allowMissingColumns=True).repartitionById(shards, F.col("shard"))
    both = both.sortWithinPartitions("shard", "kind", "id", "key")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, indexes = None, [], None
        for batch in stream:
            columns = {n: batch.column(n) for n in batch.schema.names}
            shards_, kinds = (columns[c].to_numpy() for c in ("shard", "kind"))
            edges = np.flatnonzero((np.diff(shards_) != 0) | (np.diff(kinds) != 0)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if shards_[a] != shard:
                    shard, waiting, indexes = shards_[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    waiting.append(_numbers(part))
                    continue
                if indexes is None:
                    indexes, waiting = _indexes(waiting, codewords), []
                ids, keys, labels, lengths, values = _numbers(part)
                starts = np.cumsum(lengths) - lengths
                lows, highs = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("lows", "highs"))
                for n in range(len(ids)):
                    if (index := indexes.get(int(lengths[n]))) is None:
                        continue
                    query, anchor = values[starts[n] : starts[n] + lengths[n]], (int(ids[n]), int(keys[n]))
                    found, _ = index.search(query, anchor, int(labels[n]), same, list(zip(lows[n], highs[n], strict=True)), k)
                    out += [(*anchor, slot, row, key, -score) for slot, best in enumerate(found) for score, row, key in best]
                    if len(out) >= 50_000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return both.mapInArrow(batches, _FOUND)


def _numbers(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Ids, keys, labels, lengths and values of these rows."""
    column = {n: part.column(k) for k, n in enumerate(part.schema.names)}
    lists = column["vector"]
    return *(column[c].to_numpy() for c in ("id", "key", "label")), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _indexes(parts: list[tuple[np.ndarray, ...]], codewords: int) -> dict[int, Index]:
    """An index for each length of vectors."""
    if not parts:
        return {}
    ids, keys, labels, lengths, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts, out = np.cumsum(lengths) - lengths, {}
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        out[length] = Index(ids[own], keys[own], labels[own], values[starts[own][:, None] + np.arange(length)], codewords)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _first(found: DataFrame, per: list[str], k: int) -> DataFrame:
    """The k best rows of all shards, with their rank. Each shard has given at most k, and the cut also runs before the
    shuffle."""
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("score"), "row_id", "row_key"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _window_low(score: Column) -> Column:
    """The least score s with LOW * score <= HIGH * s; above the score itself if that is negative."""
    return F.call_function("div", score * LOW + (HIGH - 1), F.lit(HIGH))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, anchors: int = ANCHORS, shard_rows: int = 100_000, codewords: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `anchors`. Their positives are the first other rows of their label,
    by falling integer inner product, then vec_id; the negatives of a positive the first rows of other labels that score
    from 80 to 100 hundredths of it. A positive with a negative score has no such window. Which rows take part is stated
    in prepared; vectors of another length are no partners; equal rows count once; different rows under one vec_id are
    rows of their own, each an anchor if its id is one. Empty tables give no rows.

    Rows are shuffled to shards of about shard_rows (but no fewer shards than the cluster runs tasks at a time), anchors
    to every shard, twice: for the positives and for the windows that these set. A task holds one shard and its index.
    """
    rows = written(prepared(vectors), "mining-rows")
    shards = max(1, -(-rows.count() // shard_rows), vectors.sparkSession.sparkContext.defaultParallelism)
    asking = rows.where(F.col("id") % anchors == 0)
    least, most = (F.array(F.lit(x).cast("long")) for x in (-(1 << 62), 1 << 62))
    near = _walks(rows, asking.withColumns({"lows": least, "highs": most}), shards, codewords, positives, True)
    anchor = ["anchor_id", "anchor_key"]
    chosen = written(_first(near, anchor, positives).withColumn("slot", F.col("rank") - 1), "mining-positives")
    windows = chosen.groupBy(*anchor).agg(F.array_sort(F.collect_list(F.struct("slot", _window_low(F.col("score")).alias("low"), "score"))).alias("w"))
    with_windows = asking.join(windows, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")))
    with_windows = with_windows.select("id", "key", "label", "vector", F.col("w.low").alias("lows"), F.col("w.score").alias("highs"))
    far = _walks(rows, with_windows, shards, codewords, negatives, False)
    hard = _first(far, [*anchor, "slot"], negatives).withColumnsRenamed({"row_id": "negative_id", "score": "negative_score"}).drop("row_key")
    of = chosen.select(*anchor, "slot", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(of, [*anchor, "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
