import itertools
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docgraph.llm import simhash as S
from docgraph.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x.decode() for x in low.encode().split()]
    pieces = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if bin(values[i] ^ values[j]).count("1") <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_masks_cover_every_set_of_three_bits():
    masks = S.covering_masks(3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        gone = sum(1 << b for b in bits)
        assert any(m & gone == 0 for m in masks)


def dense(n, seed=1):
    """Fingerprints in tight clusters, with chains of links."""
    rng = random.Random(seed)
    found = set()
    while len(found) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40, 90])):
            found.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return list(found)[:n]


def test_links_join_what_brute_force_joins_also_in_cut_groups(spark):
    values = dense(700)
    table = spark.createDataFrame([(S.signed(v),) for v in values], "fp long").repartition(3)
    want = brute_groups(values)
    for limit in (1_000, 7):
        links = S.near_links(table, 3, limit)
        assert all(bin((x ^ y) & (2**64 - 1)).count("1") <= 3 for x, y in links.collect())
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        got = [roots.get(S.signed(v), S.signed(v)) for v in values]
        pairs = Counter(zip(want, got))
        assert len(pairs) == len(set(want)) == len(set(got))


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(5).permutation(n).tolist()
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1_000, 1_001), (1_002, 1_001), (5_000, 5_000)], "x long, y long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert {roots[i] for i in range(n)} == {0} and roots[1_002] == 1_000


def test_rows_equal_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    groups = brute_groups(prints)
    least = {}
    for r, g in zip(rows, groups):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, groups))
    assert Counter(tuple(r) for r in S.near_duplicates(docs).collect()) == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values()))
    assert ids.count(None) == docs.where(F.col("doc_id").isNull()).count()


def test_empty_table(no_docs):
    assert S.near_duplicates(no_docs).collect() == [] and S.keep_one(no_docs).collect() == []
