"""Ranked lexical search: exact inner products by ball trees over sparse vectors.

Documents are dealt to groups. In each group, and for each block of items, the documents become integer vectors over the
terms of that block, and the vectors a tree of balls: a node has an integer centroid and, for each band of terms, the
radius around it, rounded up. No score below a node exceeds the centroid's inner product plus, per band, the item's norm
times the radius. An item visits the nodes of a group best bound first, adds exact integer scores at the leaves, and
stops when no bound left reaches its k-th best score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import sliced, written
from .words import split

#: A document's weight of a term is SCALE * tf div (1000 * tf + 12 * m), m = 75 + 25 * n * N div L. Fixed values.
SCALE, TF, LENGTH, LEAST, SHARE = 1_000_000_000, 1000, 12, 75, 25
_CHUNK = "chunk long, n_docs long, n_terms long, ids binary, named binary, sizes binary, heads binary, places binary, counts binary, terms binary, dfs binary"
_FOUND = "item_key long, item_id long, doc_id long, score long"


# --- documents as chunks of term counts -------------------------------------------------------------


def _chunk(number: int, ids: list, sizes: list[int], rows: list[Counter]) -> dict:
    """One row for these documents: ids, numbers of terms, and their distinct terms as places in a list of the chunk."""
    vocabulary: dict[bytes, int] = {}
    places = np.array([vocabulary.setdefault(t, len(vocabulary)) for r in rows for t in r], np.int32)
    counts = np.array([n for r in rows for n in r.values()], np.int32)
    heads = np.cumsum([0, *map(len, rows)])
    dfs = np.bincount(places, minlength=len(vocabulary)).astype(np.int32)
    arrays = {"ids": np.array([i or 0 for i in ids], np.int64), "named": np.array([i is not None for i in ids]), "sizes": np.array(sizes, np.int64), "heads": heads, "places": places, "counts": counts, "dfs": dfs}
    packed = {k: v.tobytes() for k, v in arrays.items()}
    return {"chunk": number, "n_docs": len(ids), "n_terms": sum(sizes), **packed, "terms": b" ".join(vocabulary)}


def chunks(docs: DataFrame, most_docs: int = 1000, most_terms: int = 400_000) -> DataFrame:
    """The documents that have a term, some hundred or a thousand a row."""
    names = [x.split()[0] for x in _CHUNK.split(", ")]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 32, 0
        ids, sizes, rows = [], [], []

        def made() -> pa.RecordBatch:
            one = pa.Table.from_pylist([_chunk(number, ids, sizes, rows)], schema=schema).to_batches()[0]
            for x in (ids, sizes, rows):
                x.clear()
            return one

        for batch in sliced(stream):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if terms := split(text):
                    counted = Counter(terms)
                    ids.append(doc)
                    sizes.append(len(terms))
                    rows.append(counted)
                    total += len(counted)
                    if len(ids) >= most_docs or total >= most_terms:
                        yield made()
                        number, total = number + 1, 0
        if ids:
            yield made()

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, _CHUNK.split(", "), strict=True)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, _CHUNK)


def document_frequencies(chunked: DataFrame) -> DataFrame:
    """(term, df): how many documents hold a term. Each chunk brings its own counts, one row per distinct term."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for terms, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(terms.split(b" "), pa.binary()), pa.array(np.frombuffer(dfs, np.int32).astype(np.int64))], names=["term", "df"])

    return chunked.select("terms", "dfs").mapInArrow(batches, "term binary, df long")


# --- items as weighted terms ------------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """(item_key, item_id, term, times): the distinct terms of each different item row. item_key tells rows that repeat
    an item_id with another text apart; equal rows are one."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(stream, 100):
            keys, ids, terms, times = [], [], [], []
            for key, item, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                counted = Counter(split(text))
                keys += [key] * len(counted)
                ids += [item] * len(counted)
                terms += counted.keys()
                times += counted.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], names=["item_key", "item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text").mapInArrow(batches, "item_key long, item_id long, term binary, times long")


def term_weight(df: Column, documents: int) -> Column:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))), in doubles."""
    return F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * df + 1))).cast("long")


def weighted_items(items: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """(item_key, item_id, terms): an item's terms that some document holds, each with its weight times its repeats."""
    wanted = written(item_terms(items), "search-items")
    # The items' terms are broadcast only if Spark finds them small; then most counts never leave their task.
    known = frequencies.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighted = wanted.join(known, "term").withColumn("weight", F.col("times") * term_weight(F.col("df"), documents))
    pairs = F.array_sort(F.collect_list(F.struct("term", "weight")))
    return weighted.where("weight > 0").groupBy("item_key", "item_id").agg(pairs.alias("terms"))


# --- the tree ---------------------------------------------------------------------------------------


class Vectors:
    """Documents of a group as sparse integer vectors over some terms, document by document."""

    def __init__(self, heads: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int):
        self.heads, self.terms, self.values, self.width = heads, terms, values, width
        self.rows = np.repeat(np.arange(len(heads) - 1), np.diff(heads))

    def __len__(self) -> int:
        return len(self.heads) - 1


class Tree:
    """A binary tree of balls. Documents are reordered so that every node has a run of them."""

    def __init__(self, vectors: Vectors, weight: np.ndarray, leaf: int = 16, bands: int = 4096, seed: int = 3):
        n = len(vectors)
        self.order = np.arange(n)
        self.first, self.last, self.children = [0], [n], [None]
        sketch = self._sketch(vectors, weight, seed)
        level = [0]
        while level:
            below = []
            for node in level:
                a, b = self.first[node], self.last[node]
                if b - a > leaf:
                    own = self.order[a:b]
                    self.order[a:b] = own[self._halves(sketch[own])]
                    middle = (a + b) // 2
                    self.children[node] = (len(self.first), len(self.first) + 1)
                    for x, y in ((a, middle), (middle, b)):
                        below.append(len(self.first))
                        self.first.append(x)
                        self.last.append(y)
                        self.children.append(None)
            level = below
        self._measure(vectors, min(bands, vectors.width))
        heads = np.diff(vectors.heads)[self.order]
        self.heads = np.append(0, np.cumsum(heads))
        taken = np.repeat(vectors.heads[self.order] - self.heads[:-1], heads) + np.arange(self.heads[-1])
        self.terms, self.values = vectors.terms[taken], vectors.values[taken]

    @staticmethod
    def _sketch(vectors: Vectors, weight: np.ndarray, seed: int, width: int = 24) -> np.ndarray:
        """A few random sums of a document's weighted entries. They decide who stands together, not what is found."""
        signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (vectors.width, width)) * weight[:, None]
        out = np.zeros((len(vectors), width))
        filled = np.flatnonzero(np.diff(vectors.heads))
        if len(filled):
            for column in range(width):
                out[filled, column] = np.add.reduceat(signs[vectors.terms, column] * vectors.values, vectors.heads[filled])
        return out

    @staticmethod
    def _halves(sketch: np.ndarray) -> np.ndarray:
        """An order by nearness to one of two far documents rather than the other."""
        far = ((sketch - sketch.mean(axis=0)) ** 2).sum(axis=1).argmax()
        other = ((sketch - sketch[far]) ** 2).sum(axis=1).argmax()
        return np.argsort(sketch @ (sketch[far] - sketch[other]), kind="stable")

    def _measure(self, vectors: Vectors, bands: int) -> None:
        """Centroids and radii. Both are exact in integers: entries stay below 2^20, a band has few terms; roots go up."""
        nodes, width = len(self.first), vectors.width
        place = np.empty(len(vectors), np.int64)
        place[self.order] = np.arange(len(vectors))
        band = np.arange(width) % bands
        self.band, self.bands = band, bands
        self.centroids, self.radii = np.zeros((nodes, width), np.float32), np.zeros((nodes, bands), np.float32)
        of = place[vectors.rows]
        sorted_by = np.argsort(of, kind="stable")
        of, terms, values = of[sorted_by], vectors.terms[sorted_by], vectors.values[sorted_by]
        for node in range(nodes):
            a, b = self.first[node], self.last[node]
            lo, hi = np.searchsorted(of, (a, b))
            t, x, row = terms[lo:hi], values[lo:hi], of[lo:hi] - a
            centre = np.bincount(t, x, width).astype(np.int64) // max(1, b - a)
            centre = centre.astype(np.float32).astype(np.int64)  # below 2^20: exact
            # Squares of the distance in a band: that of an absent entry, changed where there is one.
            absent = np.bincount(band, centre.astype(float) ** 2, bands)
            key = row * bands + band[t]
            order = np.argsort(key, kind="stable")
            changes = (x * (x - 2 * centre[t])).astype(float)[order]
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            squares = absent.copy()
            if len(starts):
                in_band = key[order][starts] % bands
                np.maximum.at(squares, in_band, absent[in_band] + np.add.reduceat(changes, starts))
                # Where every document has an entry in the band, the absent one is no distance of any.
                full = np.bincount(in_band, minlength=bands) == b - a
                if full.any():
                    most = np.zeros(bands)
                    np.maximum.at(most, in_band, absent[in_band] + np.add.reduceat(changes, starts))
                    squares[full] = most[full]
            self.centroids[node] = centre
            self.radii[node] = np.nextafter(np.sqrt(np.maximum(squares, 0)).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))
            self.radii[node][squares <= 0] = 0

    def bounds(self, items: np.ndarray) -> np.ndarray:
        """Per node and item (a row of term weights) a number that no score below the node exceeds."""
        norms = np.zeros((len(items), self.bands))
        np.add.at(norms.T, self.band, (items.T.astype(float)) ** 2)
        norms = np.sqrt(norms) * (1 + 1e-12)
        # All terms are positive, so the relative error of a sum of some thousand of them is far below 1e-9.
        of_items, parts = items.T.astype(float), range(0, len(self.centroids), 256)
        bound = [self.centroids[a : a + 256].astype(float) @ of_items + self.radii[a : a + 256].astype(float) @ norms.T for a in parts]
        return np.ceil(np.concatenate(bound) * (1 + 1e-9))

    def best(self, item: np.ndarray, bounds: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """(score, row) of the k best documents, equal scores by ascending id, and how many leaves were looked at.

        ids orders the documents; scores are above 0.
        """
        found: list[tuple[int, int, int]] = []
        open_nodes, looked = [(-bounds[0], 0)], 0
        while open_nodes:
            bound, node = heappop(open_nodes)
            if -bound < (found[0][0] if len(found) == k else 1):
                break
            if self.children[node]:
                for child in self.children[node]:
                    heappush(open_nodes, (-bounds[child], child))
                continue
            looked += 1
            a, b = self.first[node], self.last[node]
            lo, hi = self.heads[a], self.heads[b]
            sums = np.append(0, np.cumsum(item[self.terms[lo:hi]] * self.values[lo:hi]))
            scores = sums[self.heads[a + 1 : b + 1] - lo] - sums[self.heads[a:b] - lo]
            least = found[0][0] if len(found) == k else 1
            for at in np.flatnonzero(scores >= least).tolist():
                row = int(self.order[a + at])
                entry = (int(scores[at]), -int(ids[row]), row)
                if len(found) < k:
                    heappush(found, entry)
                elif entry > found[0]:
                    heappushpop(found, entry)
        return [(score, row) for score, _, row in sorted(found, reverse=True)], looked


class Group:
    """The documents of a group, from its chunks."""

    def __init__(self, rows: list[dict], documents: int, all_terms: int):
        arrays = {c: [np.frombuffer(r[c], kind) for r in rows] for c, kind in (("ids", np.int64), ("named", bool), ("sizes", np.int64), ("places", np.int32), ("counts", np.int32))}
        self.ids, self.named, sizes = (np.concatenate(arrays[c]) for c in ("ids", "named", "sizes"))
        self.vocabulary: dict[bytes, int] = {}
        self.places = np.concatenate([np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in r["terms"].split(b" ")], np.int32)[p] for r, p in zip(rows, arrays["places"], strict=True)])
        distinct = np.concatenate([np.diff(np.frombuffer(r["heads"], np.int64)) for r in rows])
        self.heads = np.append(0, np.cumsum(distinct))
        m = LEAST + SHARE * sizes * documents // all_terms
        tf = np.concatenate(arrays["counts"]).astype(np.int64)
        self.values = SCALE * tf // (TF * tf + LENGTH * np.repeat(m, distinct))
        # Equal scores go by id, rows without one last.
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.lexsort((self.ids, ~self.named))] = np.arange(len(self.ids))

    def vectors(self, block_terms: dict[bytes, int]) -> Vectors:
        """The documents over the terms of a block."""
        place = np.full(len(self.vocabulary), -1, np.int64)
        for term, number in block_terms.items():
            if (at := self.vocabulary.get(term)) is not None:
                place[at] = number
        terms = place[self.places]
        kept = np.flatnonzero(terms >= 0)
        heads = np.searchsorted(kept, self.heads)
        return Vectors(heads, terms[kept], self.values[kept], len(block_terms))

    def search(self, items: list[tuple[int, int, list[bytes], np.ndarray]], k: int, leaf: int) -> tuple[pa.RecordBatch, int, int]:
        """The k best documents of the group for each item, how many leaves were looked at, and of how many."""
        block_terms: dict[bytes, int] = {}
        for _, _, terms, _ in items:
            for t in terms:
                block_terms.setdefault(t, len(block_terms))
        weights = np.zeros((len(items), len(block_terms)), np.int64)
        for row, (_, _, terms, own) in enumerate(items):
            weights[row, [block_terms[t] for t in terms]] = own
        tree = Tree(self.vectors(block_terms), weights.max(axis=0).astype(float), leaf)
        bounds, looked = tree.bounds(weights), 0
        columns: list[list] = [[], [], [], []]
        for n, (key, item, _, _) in enumerate(items):
            found, visits = tree.best(weights[n], bounds[:, n], self.rank, k)
            looked += visits
            for score, row in found:
                for column, value in zip(columns, (key, item, int(self.ids[row]) if self.named[row] else None, score), strict=True):
                    column.append(value)
        leaves = sum(c is None for c in tree.children) * len(items)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_key", "item_id", "doc_id", "score"]), looked, leaves


# --- the search -------------------------------------------------------------------------------------


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20, group_docs: int = 8000, leaf: int = 16, block_items: int = 256, block_terms: int = 8192) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item; see the module.

    Each row of docs with a term is a document, also where rows repeat; equal scores go by ascending doc_id, rows without
    one last. Rows of items that are equal are one item; an item_id repeated with other texts has a ranking for each.
    Items without a term, with a null text, or without a document that scores have no rows; empty tables give none.

    Documents are shuffled once, as counted terms, into groups of about group_docs; every group gets all items, reads
    them in blocks of at most block_items items and about block_terms terms, and returns k documents an item. So no task
    holds more than a group and a block, and only the numbers of documents and terms reach the driver.
    """
    chunked = written(chunks(docs), "search-chunks")
    totals = chunked.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    documents, all_terms = totals["docs"] or 0, totals["terms"] or 0
    groups = max(1, -(-documents // group_docs))
    weighted = written(weighted_items(items, document_frequencies(chunked), documents), "search-weights")

    dealt = F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("group")
    of_docs = chunked.select(dealt, F.lit(0).alias("kind"), F.col("chunk").alias("key"), *[F.col(c) for c in _DOC_COLUMNS])
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    of_items = weighted.select(every, F.lit(1).alias("kind"), F.col("item_key").alias("key"), "item_id", F.col("terms.term").alias("item_terms"), F.col("terms.weight").alias("item_weights"))
    both = of_docs.unionByName(of_items, allowMissingColumns=True).repartitionById(groups, F.col("group"))
    both = both.sortWithinPartitions("group", "kind", "key")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        number, group, waiting, size = None, None, [], 0
        for batch in stream:
            names = batch.schema.names
            for at in range(len(batch)):
                row = {c: batch.column(n)[at].as_py() for n, c in enumerate(names) if batch.column(n)[at].is_valid}
                if row["group"] != number:  # the next group begins
                    if waiting:
                        yield group.search(waiting, k, leaf)[0]
                    number, group, waiting, size, rows = row["group"], None, [], 0, []
                if row["kind"] == 0:
                    rows.append(row)
                    continue
                if group is None:
                    if not rows:
                        continue  # a group without documents
                    group, rows = Group(rows, documents, all_terms), []
                waiting.append((row["key"], row.get("item_id"), row["item_terms"], np.array(row["item_weights"], np.int64)))
                size += len(row["item_terms"])
                if len(waiting) >= block_items or size >= block_terms:
                    yield group.search(waiting, k, leaf)[0]
                    waiting, size = [], 0
        if waiting:
            yield group.search(waiting, k, leaf)[0]

    found = both.mapInArrow(batches, _FOUND)
    place = F.row_number().over(Window.partitionBy("item_key", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_DOC_COLUMNS = ("ids", "named", "sizes", "heads", "places", "counts", "terms")
