from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docgraph.llm import mixing as M


def shared_again(sizes, weights, most):
    """By passes: share, cut at ``most`` times the size, share the excess by weight."""
    targets, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while left > 1e-9 and open_:
        w = sum(weights[i] for i in open_)
        for i in list(open_):
            targets[i] += left * weights[i] / w
        left = 0.0
        for i in list(open_):
            if targets[i] >= most * sizes[i]:
                left += targets[i] - most * sizes[i]
                targets[i] = most * sizes[i]
                open_.discard(i)
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 50, 2_000], [3, 1, 0, 9_000, 10], [7], [0, 0], []])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert M.shared_targets(sizes, weights, 3) == pytest.approx(shared_again(sizes, weights, 3))
    assert sum(M.shared_targets(sizes, weights, 3)) == pytest.approx(sum(sizes))


def test_permutations(spark):
    for n in (1, 2, 3, 5, 7, 50, 257, 3_000):
        image = [r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), 5, F.lit(1), F.lit(2))).collect()]
        assert sorted(image) == list(range(n))
    assert image != list(range(n))


def test_draws_have_the_expected_counts(spark):
    slots = M.draw_slots(spark, [0, 1, 2], [500.0, 300.0, 1_248.0], [400, 300, 500], 128, 3, 1)
    counts = Counter(r["s"] for r in slots.collect())
    assert sum(counts.values()) == 2_048
    assert all(abs(counts[s] - e) < 40 for s, e in enumerate((500, 300, 1_248)))
    by_shard = Counter((r["shard"], r["s"]) for r in slots.collect())
    assert len({by_shard[k, 0] for k in range(16)}) > 1
    takes = Counter((r["s"], r["block"]) for r in slots.collect())
    for s, n in ((0, 400), (1, 300), (2, 500)):
        passes = [takes[s, b] for b in range(n)]
        assert max(passes) - min(passes) <= 1


def test_whole_counts():
    assert M.whole_counts([1.5, 2.25, 0.25], [9, 9, 9]) == [2, 2, 0]
    assert M.whole_counts([2.6, 2.6, 2.8], [3, 2, 3]) == [3, 2, 3]
    assert M.whole_counts([], []) == [] and M.whole_counts([0.0], [0]) == [0]


def test_counts_of_shards_vary_and_totals_do_not(spark):
    """Every shard is full, totals equal the targets, and counts of shards spread like draws do."""
    expected, blocks = [1_024.0, 3_072.0, 4_096.5], [1_000, 1_500, 5_000]
    rows = M.draw_slots(spark, [3, 5, 8], expected, blocks, 128, 3, 9).collect()
    assert Counter(r["s"] for r in rows) == dict(zip((3, 5, 8), M.whole_counts(expected, [3 * b for b in blocks])))
    by_shard = Counter((r["shard"], r["s"]) for r in rows)
    assert {n for n in Counter(r["shard"] for r in rows if r["shard"] < 64).values()} == {128}
    counts = [by_shard[k, 3] for k in range(64)]
    spread = sum((c - 16) ** 2 for c in counts) / 64
    # A binomial count of 128 draws at 1/8 has a variance of 14.
    assert 6 < spread < 28


def test_hot_rows_are_spread_and_counted(spark):
    """A third of equal rows, a third without id: numbered without gaps, in many parts, words tiled exactly."""
    rows = [(7, "same text here", "a")] * 3_000 + [(None, f"no id {i % 5}", "a") for i in range(3_000)] + [(100 + i, f"row {i} of its own", None if i % 2 else "b") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = M.plan_mix(df, block_words=8, shard_slots=64)
    got = mix.rows.collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(t.split())) for i, t, s in rows)
    nth = defaultdict(list)
    for r in got:
        nth[r["id"], r["text_hash"], r["source"]].append(r["nth"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in nth.values())
    key = lambda r: (r["id"], r["text_hash"], r["source"], r["nth"])
    takes = Counter((r["s"], r["block"]) for r in mix.slots.collect())
    covered, taken, filled = defaultdict(list), Counter(), Counter()
    for r in mix.segments.collect():
        covered[key(r)].append((r["first"], r["words"]))
        taken[key(r)] += r["words"] * takes[r["s"], r["block"]]
        filled[r["s"], r["block"]] += r["words"]
    for r in got:
        at = 0
        for first, words in sorted(covered[key(r)]):
            assert first == at
            at += words
        assert at == r["size"] and r["taken"] == taken[key(r)]
    assert max(filled.values()) == 8
    for s in {r["source"] for r in got}:
        of = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 0.02 * of[0]["target"] + 16


def test_copies_are_written_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 100)
    df = spark.range(1_050).select(F.lit(1).cast("long").alias("id"), F.lit(5).cast("long").alias("text_hash"), F.lit("a").alias("source"), F.lit(3).cast("long").alias("size"))
    rows = M.numbered_copies(df)
    assert sorted(r["nth"] for r in rows.collect()) == list(range(1, 1_051))


def test_mix_of_rows(docs):
    mix = M.plan_mix(docs, block_words=16)
    rows = mix.rows.collect()
    given = docs.select("doc_id", "text", "source").collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in given)
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, M.shared_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 64 for s in names)
    again = M.plan_mix(docs.repartition(5), block_words=16).rows
    key = lambda r: (r["id"], r["source"], r["size"], r["taken"])
    assert Counter(map(key, again.collect())) == Counter(map(key, rows))


def test_mixed_documents(docs):
    mixed = M.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"], r["source"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in M.plan_mix(docs, block_words=16).rows.collect():
        want[r["id"], r["source"]] += r["taken"]
    assert words == +want


def test_empty_tables(no_docs, docs):
    assert M.plan_mix(no_docs).rows.collect() == [] and M.mixed_documents(no_docs).collect() == []
    blank = docs.where("text is null")
    assert {r["taken"] for r in M.plan_mix(blank).rows.collect()} == {0}
