"""Exact searches by ball trees and by the inverted multi-index, against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.llm import ball_tree, multi_index
from dqspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_hard_negatives"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    out = QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.execute(f"select {', '.join(out.columns)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and want


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(docs, items, k):
    """(item_id, doc_id, score) lists per different item, in order."""
    counted = [(doc, Counter(terms(text)), len(terms(text))) for doc, text in docs if terms(text)]
    documents, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c, n in counted:
            m = 75 + 25 * n * documents // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(out, key=repr)


def random_tables(seed, documents=300):
    chance = random.Random(seed)
    words = [f"W{k}" for k in range(40)] + [f"rare{k}" for k in range(400)] + ["é", "日本"]
    text = lambda n: " ".join(chance.choices(words, [400 // (k + 1) + 1 for k in range(len(words))], k=n))
    docs = [(k, text(chance.randrange(1, 60))) for k in range(documents)]
    same = text(30)
    docs += [(1000 + k, same) for k in range(150)] + [(5, text(9)), (5, docs[5][1]), (None, same), (None, None), (7, ""), (8, "?!"), (9, text(20_000))]
    items = [(k, text(chance.randrange(1, 40))) for k in range(30)] + [(40, same), (40, text(5)), (1, None), (2, ""), (41, same), (41, same), (None, "w1 W1 rare3"), (50, "unheard")]
    return docs, items


@pytest.mark.parametrize("group_docs, leaf, block_items", [(8000, 16, 256), (60, 3, 7)])
def test_ranking(spark, group_docs, leaf, block_items):
    docs, items = random_tables(1)
    own = spark.createDataFrame(docs, DOCS).select("*", F.lit(1).alias("score"), F.lit(2).alias("Terms")).repartition(5)
    out = ball_tree.best_documents(own, spark.createDataFrame(items, ITEMS), group_docs=group_docs, leaf=leaf, block_items=block_items)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_ranking(docs, items, 20)


def test_ranking_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], s) for s in (DOCS, ITEMS))
    one = spark.createDataFrame([(1, "some words")], DOCS)
    asked = spark.createDataFrame([(1, "some words")], ITEMS)
    for d, i in ((docs, items), (docs, asked), (one, items), (spark.createDataFrame([(1, None)], DOCS), asked)):
        assert ball_tree.best_documents(d, i).collect() == []


def tree_of(seed, n=2000, width=400, leaf=8):
    chance = np.random.default_rng(seed)
    rows = [np.sort(chance.choice(width, chance.integers(0, 25), replace=False, p=(w := 1 / np.arange(1, width + 1)) / w.sum())) for _ in range(n)]
    heads = np.append(0, np.cumsum([len(r) for r in rows]))
    vectors = ball_tree.Vectors(heads, np.concatenate(rows), chance.integers(1, 1_000_000, heads[-1]), width)
    return vectors, ball_tree.Tree(vectors, np.ones(width), leaf, bands=150)


def test_no_score_exceeds_its_bound_and_most_leaves_are_left_out():
    vectors, tree = tree_of(1)
    dense = np.zeros((len(vectors), vectors.width), np.int64)
    dense[vectors.rows, vectors.terms] = vectors.values
    items = np.zeros((40, vectors.width), np.int64)
    chance = np.random.default_rng(2)
    for item in items:
        item[chance.choice(vectors.width, 8, replace=False)] = chance.integers(1, 13_000, 8)
    scores, bounds = dense @ items.T, tree.bounds(items)
    for node in range(len(tree.first)):
        assert (scores[tree.order[tree.first[node] : tree.last[node]]] <= bounds[node]).all()
    looked = 0
    for n in range(len(items)):
        found, leaves = tree.best(items[n], bounds[:, n], np.arange(len(vectors)), 5)
        best = sorted((-s, k) for k, s in enumerate(scores[:, n].tolist()) if s > 0)[:5]
        assert found == [(-s, k) for s, k in best]
        looked += leaves
    assert looked < 0.5 * len(items) * sum(c is None for c in tree.children)


# --- hard negatives -----------------------------------------------------------------------------------


def brute_negatives(rows, anchors=100):
    kept = []
    for k, vector, label in dict.fromkeys((k, None if v is None else tuple(v), label) for k, v, label in rows):
        if k is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((k, (label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for a in kept:
        if a[0] % anchors == 0:
            scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in kept if r is not a and len(r[2]) == len(a[2]))
            for s, positive, _ in [x for x in scored if x[2] == a[1]][:5]:
                hard = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
                out += [(a[0], positive, n + 1, x[1], -s, -x[0]) for n, x in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, codewords", [(100_000, 32), (40, 3)])
def test_hard_negatives(spark, shard_rows, codewords):
    chance = np.random.default_rng(4)
    centres = chance.standard_normal((6, 16))
    rows = [(k, (centres[k % 6] + 0.5 * chance.standard_normal(16)).round(2).tolist(), int(chance.integers(0, 4))) for k in range(700)]
    rows += [(2000 + k, rows[3][1], 1 + k % 2) for k in range(200)]  # many copies, ties
    rows += [(900, None, 1), (3000, [1.0] * 15 + [float("nan")], 1), (3100, [1.0] * 15 + [None], 1), (3200, [1.0] * 16, None), (None, [1.0] * 16, 1), (3300, [float("inf")] * 16, 1)]
    rows += [(3400, [0.5, 0.25, 1.0], 1), (3401, [0.5, 0.5, 1.0], 1), (3402, [0.5, 0.5, 0.9], 2), (3500, [], 1), (3501, [], 1), (3502, [], 2), (3600, [0.0] * 16, 2)]
    rows += [rows[100], (300, [1.0] * 16, 3)]  # an equal row, another row of an anchor's id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(1).alias(c) for c in ("id", "score", "Key", "shard")])
    got = multi_index.hard_negatives(df, shard_rows=shard_rows, codewords=codewords).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)
    assert multi_index.hard_negatives(df.limit(0)).collect() == []


def test_walk_stops_early():
    chance = np.random.default_rng(5)
    centres = chance.integers(-200, 200, (12, 8))
    vectors = centres[np.arange(4000) % 12] + chance.integers(-9, 9, (4000, 8))
    ids = np.arange(4000)
    index = multi_index.Index(ids, ids, ids % 10, vectors, 32)
    share = 0
    for q in range(0, 4000, 100):
        best = sorted((-int(s), k, k) for k, s in enumerate((vectors @ vectors[q]).tolist()) if k % 10 == q % 10 and k != q)[:5]
        found, scored = index.search(vectors[q], (q, q), q % 10, True, [(-(1 << 62), 1 << 62)], 5)
        assert found == [best]
        share += scored / 4000 / 40
    assert share < 0.3


def test_bounds_hold_and_cells_fall():
    chance = np.random.default_rng(6)
    vectors = chance.integers(-300, 300, (900, 10))
    index = multi_index.Index(np.arange(900), np.arange(900), np.zeros(900, int), vectors, 16)
    for query in chance.integers(-300, 300, (30, 10)):
        cells = list(index.cells(query))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        assert sorted(k for _, a, b in cells for k in range(a, b)) == list(range(900))
        assert all((index.vectors[a:b] @ query <= bound).all() for bound, a, b in cells)
