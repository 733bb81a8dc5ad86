"""Ordered scans and packing against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docgraph.operators.ordered import carry_last, first_per_key, row_index, running_sum
from docgraph.operators.packing import Packing, pack


def _rows(seed):
    rng = random.Random(seed)
    return [(d, i // 7, i, rng.choice([None, None, i])) for d in ("a", "b") for i in range(rng.randint(1, 60))]


def test_carry_last_forward_and_back(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "d string, seg long, ord long, v long")
    ahead = {(r.d, r.ord): r.x for r in carry_last(df, ["d"], "seg", "ord", {"x": F.col("v")}, inclusive=False).collect()}
    back = {(r.d, r.ord): r.x for r in carry_last(df, ["d"], "seg", "ord", {"x": F.col("v")}, reverse=True).collect()}
    for d, _, o, _ in rows:
        before = [v for k, _, i, v in rows if k == d and i < o and v is not None]
        after = [v for k, _, i, v in rows if k == d and i >= o and v is not None]
        assert ahead[(d, o)] == (before[-1] if before else None)
        assert back[(d, o)] == (after[0] if after else None)


def test_running_sum_and_index(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "d string, seg long, ord long, v long")
    total = {(r.d, r.ord): r.s for r in running_sum(df, ["d"], "seg", "ord", {"s": F.lit(2)}).collect()}
    place = {(r.d, r.ord): r.n for r in row_index(df, ["d"], "seg", "ord", "n").collect()}
    for d, _, o, _ in rows:
        assert total[(d, o)] == 2 * (o + 1) and place[(d, o)] == o


def test_first_per_key(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("j", 2, "b")], "k string, n int, v string")
    assert {(r.k, r.v) for r in first_per_key(df, ["k"], [F.col("n")]).collect()} == {("k", "a"), ("j", "b")}


def loop_pack(weights, rule):
    """The greedy loop, written out plainly."""
    parts, cur = [], []
    for i, w in enumerate(weights):
        if rule.split_oversize and w > rule.cap:
            if cur:
                parts.append((cur[0], cur[-1], False))
            parts.append((i, i, True))
            cur = []
            continue
        full = cur and (sum(weights[j] for j in cur) + w > rule.cap or (rule.max_items and len(cur) >= rule.max_items))
        if full:
            parts.append((cur[0], cur[-1], False))
            kept, total = [], 0
            if rule.overlap is not None:
                for j in reversed(cur):
                    kept.insert(0, j)
                    total += weights[j]
                    if total >= rule.overlap:
                        break
            cur = kept
        cur.append(i)
    if cur:
        parts.append((cur[0], cur[-1], False))
    return parts


@pytest.mark.parametrize("rule", [
    Packing(40, 15, split_oversize=True), Packing(40, 0, split_oversize=True), Packing(30), Packing(50, max_items=4),
    Packing(20, 18, split_oversize=True),
])
def test_pack_equals_the_loop_in_one_piece_and_in_many(spark, rule):
    rng = random.Random(5)
    groups = {g: [rng.choice([1, 3, 7, 12, 25, 55 if rule.split_oversize else 9]) for _ in range(rng.randint(1, 150))] for g in range(12)}
    rows = [(g, 100 + i, w) for g, ws in groups.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g long, pos long, weight long")
    want = {(g, a + 100, b + 100, o) for g, ws in groups.items() for a, b, o in loop_pack(ws, rule)}
    whole = {tuple(r) for r in pack(df, ["g"], rule).collect()}
    pieces = {tuple(r) for r in pack(df, ["g"], rule, piece=16, halo=64).collect()}
    assert whole == want
    assert pieces == want
