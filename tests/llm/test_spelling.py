import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.llm import spelling as S


def brute_words(rows, least_n=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return Counter(out)


def spelt(rng, n_words=60):
    """Rows whose words have variants by each kind of edit, in chains and ties, with doubled letters and one letter code points."""
    rows = []
    for k in range(n_words):
        word = "".join(rng.choices("abcdefgéßÿ×aab", k=rng.randint(6, 11)))
        for times, w in ((rng.choice([8, 60, 900]), word), (rng.choice([5, 20, 60]), word[:2] + word[3:]), (6, word + word[-1]), (60, word + "s"), (5, word + "st"), (5, word[0] + "z" + word[1:]), (5, word[:3] + "q" + word[4:])):
            rows.append((k * 10, f"{w.title() if rng.random() < .2 else w} 1 " * times))
    return rows


def test_words_equal_brute_force(spark):
    rows = spelt(random.Random(6))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 40 and any(r[2] != r[1] for r in want if r[1])
    assert Counter(tuple(r) for r in S.variants(df).collect()) == want


def test_several_passes_give_the_same(spark, monkeypatch):
    rows = spelt(random.Random(8), 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(S, "FILTER_BYTES", 100)
    assert Counter(tuple(r) for r in S.variants(df).collect()) == brute(rows)


def test_rows_of_every_kind(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + spelt(random.Random(1), 5)
    rows += [(1, f"{'y' * 300} {'y' * 299}z {'y' * 301} " * 6), (None, "nullable nullable nullables " * 5), (None, "nullable " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("no", F.lit(1)).repartition(4)
    assert Counter(tuple(r) for r in S.variants(df).collect()) == brute(rows)


def test_filters_lose_no_word_and_pass_few_others(spark):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcdefghij"), 8)) for _ in range(3_000)})
    vocabulary = S.keyed(spark.createDataFrame([(w, 9) for w in words], "word string, n long")).withColumn("shard", F.length("word"))
    keys = np.array([r["key"] for r in vocabulary.collect()]).view(np.uint64)
    filters = S.build_filters(vocabulary, {8: -(-len(words) * S.BITS_PER_WORD // (64 * S.CELLS))}, 0, 1)
    assert len(filters.maybe(8, keys)) == len(keys)
    assert len(filters.maybe(8, S.mixed(np.arange(50_000, dtype=np.uint64)))) < 500
    assert len(filters.maybe(7, keys)) == 0


@pytest.mark.parametrize("word", ["aabbcc", "éßÿxyz", "abcdefgh"])
def test_edit_hashes_are_those_of_the_edited_words(word):
    class All(S.Filters):
        def maybe(self, length, keys):
            return np.arange(len(keys))

    letters = np.frombuffer(word.encode("latin-1"), np.uint8)[None, :]
    everything = All({len(word): None, len(word) - 1: None}, 0, 1)
    found = {}
    for _, at, letter, keys in S.edits(letters, everything):
        for p, c, k in zip(at.tolist(), letter.tolist(), keys.tolist()):
            found[word[:p] + (chr(c) if c else "") + word[p + 1 :]] = k
    want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + chr(c) + word[i + 1 :] for i in range(len(word)) for c in S.LETTERS.tolist() if c > ord(word[i])}
    assert set(found) == want
    for made, key in found.items():
        code = np.frombuffer(made.encode("latin-1"), np.uint8)
        assert int(S.keys_of(np.bitwise_xor.reduce(S.values_of(np.arange(len(made)), code), keepdims=True), len(made))[0]) == key


def test_empty_table(no_docs):
    assert S.variants(no_docs).collect() == []
