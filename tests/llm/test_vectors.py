import math
import random

import numpy as np
import pytest

from martloom.llm import ann, topk
from tests.llm import brute

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score double"


def vectors(rnd, n, d=12):
    centers = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [[float(np.float32(c + rnd.gauss(0, 0.4))) for c in centers[rnd.randrange(5)]] for _ in range(n)]


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(1)
    v = vectors(rnd, 600)
    v[100:200] = [v[100]] * 100
    v[300] = [0.0] * 12
    odd = [(1000, None), (1001, [None] * 12), (1002, [math.nan] * 12), (1003, [math.inf] * 12), (1004, [1.0, 2.0]), (1005, []), (None, v[0])]
    frame = spark.createDataFrame([(i, x, 1, 0.5) for i, x in [*enumerate(v), *odd]], SCHEMA)
    return v, frame


def test_top_k_equals_brute_force(spark, sample, monkeypatch):
    v, frame = sample
    monkeypatch.setattr(topk, "PIVOTS", 9)
    monkeypatch.setattr(topk, "PART_ROWS", 40)
    whole = [[math.floor(256 * x) for x in row] for row in v]
    got = {}
    for r in topk.top_k(frame, lambda c: c % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(600) if i % 50 == 0}
    for q, rows in got.items():
        assert [x[1:] for x in sorted(rows)] == [(i, int(s)) for i, s in brute.top_products(list(range(600)), whole, q, 5)]
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0), (7, [0.5, 0.5], 1, 0.0)], SCHEMA)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(few, lambda c: c % 50 == 0, 5).collect()] == [(0, 7, 128 * 256)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA), lambda c: c % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("pivots", [1, 4, 30])
def test_ties_over_cells_with_negative_scores(spark, monkeypatch, pivots):
    """All products are negative and many are equal; cells of equal vectors have radius 0."""
    monkeypatch.setattr(topk, "PIVOTS", pivots)
    v = [[-1.0 - (i % 3), 2.0 - (i % 2), 0.25 * (i % 5 - 2)] for i in range(260)]
    v[0:260:50] = [[1.0, 0.0, 0.0]] * 6
    v[92] = [-0.5, 1.0, 0.0]
    frame = spark.createDataFrame([(i, x, 1, 0.0) for i, x in enumerate(v)], SCHEMA)
    got = {}
    for r in topk.top_k(frame, lambda c: (c % 50 == 0) | (c == 7), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [[math.floor(256 * x) for x in row] for row in v]
    for q, rows in got.items():
        assert [x[1:] for x in sorted(rows)] == [(i, int(s)) for i, s in brute.top_products(list(range(260)), whole, q, 5)]


def test_graph_recall_and_exact_scores(spark, sample, monkeypatch):
    v, frame = sample
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    got = {}
    for r in ann.nearest(frame, lambda c: c % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = [i for i in range(600) if any(v[i])]
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, rows in got.items():
        rows = sorted(rows)
        assert [r[0] for r in rows] == list(range(1, 21)) and all(r[1] != q for r in rows)
        assert all(abs(s - np.dot(v[q], v[i])) < 1e-9 for _, i, s in rows)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        hits += len({r[1] for r in rows} & {i for i, _ in brute.top_products(ids, [v[i] for i in ids], q, 20)})
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(spark.createDataFrame([], SCHEMA), lambda c: c % 20 == 0, 20).count() == 0


def test_flat_arrays_hold_the_graph():
    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    graph = ann.Graph(x)
    again = ann.Graph.of_flat(x, graph.flat())
    assert all(graph.search(q, 30) == again.search(q, 30) for q in x[:20])


def test_a_shard_crosses_once_for_many_queries(spark, monkeypatch):
    """However many packets of queries there are, a shard's vectors and graph come once for QUERIES of them; small batches change nothing."""
    rnd = random.Random(3)
    v = vectors(rnd, 900, 6)
    frame = spark.createDataFrame([(i, x, 1, 0.0) for i, x in enumerate(v)], SCHEMA)
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    monkeypatch.setattr(ann, "PACKET", 8)
    rows = frame.select("vec_id", frame.embedding.cast("array<double>").alias("v"))
    index = ann.build_index(rows, 5).cache()
    inputs, run = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, *a, **b: inputs.append(self) or run(self, *a, **b))
    want = sorted(map(tuple, ann.search_index(index, rows, 5).collect()))
    assert len(want) == 5 * 900
    assert inputs[-1].where("vectors IS NOT NULL").count() == index.count() == 3
    for name, value in (("QUERIES", 50), ("PACKET", 256)):
        monkeypatch.setattr(ann, name, value, raising=False)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(tuple, ann.search_index(index, rows, 5).collect())) == want
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
