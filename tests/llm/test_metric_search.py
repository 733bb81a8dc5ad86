import math

import numpy as np
from pyspark.sql import functions as F

from docgraph.llm import metric_search as M


def brute(rows, k, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in kept:
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in kept if i != q)[:k]
            out |= {(q, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(scored)}
    return out


def made(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("tree", F.lit(1)).repartition(3)


def test_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 6), 1)]) for i in range(700)]
    rows += [(1_000 + i, rows[40][1]) for i in range(150)]  # ties
    rows += [(2_000, None), (2_020, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (2_040, [float("nan")] * 6), (2_060, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (2_080, [0.0] * 6), (2_100, [-3.0] * 6)]
    found = M.top_inner_products(made(spark, rows), F.col("vec_id") % 20 == 0, k=20, tree_rows=200, block_rows=16)
    assert {tuple(r) for r in found.collect()} == brute(rows, 20)


def test_unequal_lengths_null_ids_and_empty_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i if i % 7 else None, [float(x) for x in np.round(rng.normal(0, 1, rng.integers(0, 6)), 1)]) for i in range(1, 300)]
    rows += [(400, []), (420, [1.0]), (440, [0.0, 0.0, 2.0]), (None, rows[3][1]), (None, [])]
    found = M.top_inner_products(made(spark, rows), F.col("vec_id") % 20 == 0, k=20, tree_rows=80, block_rows=4)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute(rows, 20) and any(r[2] is None for r in got)
    large = [(0, [1e15, 1.0]), (1, [1e15, 0.0]), (2, [-1e15, 0.0])]
    signs = {r["vec_id"]: r["score"] for r in M.top_inner_products(made(spark, large), F.col("vec_id") == 0).collect()}
    assert signs[1] > 2**62 and signs[2] == -(2**63)


def test_small_pages_in_one_tree_find_the_same(monkeypatch):
    monkeypatch.setattr(M, "PAGE", 16)
    rng = np.random.default_rng(9)
    vectors = np.floor(64 * rng.normal(0, 0.2, (900, 8)))
    vectors[100:140] = vectors[7]
    tree = M.Tree(M.tree_of(__import__("pyarrow").table({"id": np.arange(900), "vector": vectors.tolist(), "tree": np.zeros(900, np.int64)})))
    for q in range(0, 900, 37):
        ids, scores = tree.nearest(q, vectors[q], 20)
        want = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q)[:20]
        assert list(zip((-scores).astype(int).tolist(), ids.tolist())) == want


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    found = M.top_inner_products(made(spark, rows), F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in found.collect()} == brute(rows, 20)
    assert M.top_inner_products(made(spark, rows).limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_avoid_pages(monkeypatch):
    monkeypatch.setattr(M, "PAGE", 64)
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 40, (40, 8))
    points = np.round(np.vstack([c + rng.normal(0, 1, (60, 8)) for c in centers]))
    squares = (points**2).sum(1)
    lifted = np.column_stack([points, np.sqrt(squares.max() - squares)])
    pages = M.build_pages(lifted)
    assert sorted(np.concatenate([p["object"] for p in pages if p["leaf"]]).tolist()) == list(range(len(points)))
    for page in pages:
        if not page["leaf"]:
            for at, radius, child in zip(page["object"], page["radius"], page["child"]):
                below = pages[child]["object"]
                assert (np.sqrt(((lifted[below] - lifted[at]) ** 2).sum(1)) <= radius + 1e-9).all()
