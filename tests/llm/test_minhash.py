import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.llm import minhash as M


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x.decode() for x in low.encode().split()]
    return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)} or ({" ".join(w)} if w else set())


def brute(rows, percent=80):
    """(id, n_shingles, component_id, kept) of each (id, text)."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i, (least.get(find(k)) if sets[k] else i) == i) for k, (i, _) in enumerate(rows)]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_densified_bins_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    for size in (5, 40, 400):
        agree = []
        for _ in range(150):
            pool = rng.integers(0, 1 << 63, size + size // 4, dtype=np.uint64) * np.uint64(2)
            a, b = M.signature(pool[:size], 128), M.signature(pool[size // 4 :], 128)
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - (size - size // 4) / (size + size // 4)) < 0.04
    one = M.signature(np.array([77], np.uint64), 128)
    assert set(one.tolist()) == {77}


def test_every_link_of_a_group_of_edited_copies_is_found(spark):
    """Copies with 3 to 9 changed words of 200: some pairs link, others do not, and chains join them."""
    rng = random.Random(4)
    rows, at = [], 100
    for size in (60, 9, 2):
        base = [f"w{rng.randrange(5_000)}" for _ in range(200)]
        for k in range(size):
            rows.append((at + k * 7 % size, edited(rng, base, rng.randint(3, 9))))
        at += 1_000
    chain = [f"c{k}" for k in range(120)]
    for k in range(12):
        rows.append((10_000 + k, " ".join(chain[2 * k : 2 * k + 90])))
    rows += [(20_000 + k, " ".join(f"lone{k}_{j}" for j in range(30))) for k in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter(brute(rows))
    assert len({r[2] for r in want}) > 25
    assert Counter(tuple(r) for r in M.near_duplicates(df).collect()) == want


@pytest.mark.parametrize("stars", [0, 2])
def test_star_pieces_and_a_bucket_of_unlinked_texts(spark, monkeypatch, stars):
    """Bands of one bin put texts of little similarity into common buckets, so that the prefix filter finds most links."""
    monkeypatch.setattr(M, "STAR_PIECE", 3)
    monkeypatch.setattr(M, "STAR_ROUNDS", stars)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, edited(rng, base, 4 if k < 12 else 14)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in M.near_duplicates(df, bands=24, rows_per_band=1).collect()) == Counter(brute(rows))


def test_rows_equal_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in M.near_duplicates(docs).collect()) == Counter(brute(rows))


def test_empty_table(no_docs):
    assert M.near_duplicates(no_docs).collect() == []


def test_blank_texts_link_with_nothing(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c")], "doc_id long, text string").withColumn("class", F.lit(1))
    assert sorted(map(tuple, M.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True)]
