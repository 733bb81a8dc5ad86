"""Exact vector search over blocks of queries and slabs of the corpus."""

import numpy as np

from docgraph.operators import vectors as V


def expected(corpus, queries, k):
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    out = set()
    for q, a in queries:
        scored = sorted((-round(max(0.0, float(unit(np.array(a)) @ unit(np.array(b)))), 6) if len(a) == len(b) else 0.0, i) for i, b in corpus)
        out |= {(q, i) for _, i in scored[:k]}
    return out


def test_many_queries_ties_and_scores_below_zero(spark):
    rng = np.random.default_rng(3)
    corpus = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)] + [(1_000 + i, [1.0, 2.0]) for i in range(5)]
    queries = [(f"q{i}", [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(5_000)]
    table = spark.createDataFrame(corpus, "chunk_id long, vector array<double>")
    asked = spark.createDataFrame(queries, "query_id string, vector array<double>")
    found = V.top_k(table, asked, 3, block=512, slab=100)
    assert found.count() == 15_000
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == expected(corpus, queries, 3)
    below = spark.createDataFrame([(i, [-1.0 - i, 0.0]) for i in range(1_000)], "chunk_id long, vector array<double>")
    one = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [r.chunk_id for r in V.top_k(below, one, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert V.top_k(below, one.limit(0), 3).collect() == [] and V.top_k(below.limit(0), one, 3).collect() == []
