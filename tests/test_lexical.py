import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docgraph.operators import lexical as L


def brute(chunks, questions, k):
    """chunks: (chunk_id, document_id, order_index, content); the k best of each question by the definition."""
    tokens = {c[0]: c[3].lower().split() for c in chunks}
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = {}
    for q, text in questions:
        asked = Counter(text.lower().split())
        idf = {t: math.log((1 + len(chunks)) / (1 + df[t])) + 1 for t in asked}
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in asked.items()))
        found = []
        for c, d, o, _ in chunks:
            tf = Counter(tokens[c])
            w = {t: tf[t] * idf[t] for t in asked}
            own = math.sqrt(sum(x * x for x in w.values()))
            if not own:
                continue
            score = sum(asked[t] * idf[t] * w[t] for t in asked) / (norm * own)
            if " ".join(text.lower().split()) in " ".join(tokens[c]):
                score += 0.15
            found.append((-round(score, 9), d, o, c))
        out[q] = [(c, -s) for s, _, _, c in sorted(found)[:k]]
    return out


@pytest.fixture(scope="module")
def corpus():
    """A word is in every chunk, others are rare; many chunks tie."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    chunks = []
    for k in range(900):
        own = rng.choices(words, weights=[1 / (1 + i) for i in range(400)], k=rng.randint(3, 40))
        chunks.append((f"c{k:04}", k // 3, k % 3, " ".join(["the", *own])))
    chunks += [(f"d{k}", 500 + k, 0, "the the only") for k in range(200)]
    questions = [(1, "the"), (2, "the only"), (3, "nothing of this"), (4, "w399 w398"), (5, "the w399"), (6, chunks[7][3]), (7, "w0 w1 the of"), (8, "THE w5 w5 w5")]
    questions += [(10 + k, " ".join(["the", *rng.choices(words, k=rng.randint(1, 25))])) for k in range(40)]
    return chunks, questions


@pytest.mark.parametrize("k, wave, block", [(5, None, 128), (3, 4, 8), (20, 10, 32)])
def test_best_chunks_equal_a_full_scoring(spark, corpus, k, wave, block):
    chunks, questions = corpus
    c = spark.createDataFrame(chunks, "chunk_id string, document_id long, order_index long, content string").repartition(4)
    q = spark.createDataFrame(questions, "question_id long, question string")
    index = L.build_index(c, L.query_tokens(q), block)
    got = {}
    for r in L.search(index, q, k, wave).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], r["score"]))
    want = {i: hits for i, hits in brute(chunks, questions, k).items() if hits}
    assert {i: [h[0] for h in hits] for i, hits in got.items()} == {i: [h[0] for h in hits] for i, hits in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for i in want for a, b in zip(got[i], want[i]))


def test_a_word_of_every_chunk_is_not_followed(spark, corpus):
    chunks, _ = corpus
    c = spark.createDataFrame(chunks, "chunk_id string, document_id long, order_index long, content string")
    q = spark.createDataFrame([(k, f"the w{390 + k}") for k in range(8)], "question_id long, question string")
    index = L.build_index(c)
    terms = L.question_terms(index, q).where("token = 'the'").agg(F.max("bound")).first()[0]
    best = L.search(index, q, 2)
    assert best.where("rank = 2").agg(F.min("score")).first()[0] > terms


def test_filler_and_empty_tables(spark, corpus):
    chunks, _ = corpus
    c = spark.createDataFrame(chunks, "chunk_id string, document_id long, order_index long, content string")
    q = spark.createDataFrame([(1, "unknown words"), (2, "")], "question_id long, question string")
    got = [tuple(r) for r in L.top_k(L.build_index(c), q, 3).select("question_id", "chunk_id", "score").orderBy("rank").collect()]
    assert got == [(1, "c0000", 0.0), (1, "c0001", 0.0), (1, "c0002", 0.0)]
    assert L.top_k(L.build_index(c.limit(0)), q, 3).collect() == [] and L.search(L.build_index(c), q.limit(0), 3).collect() == []


def test_a_frequent_word_is_scored_by_many_tasks(spark, corpus):
    """Pairs of the word that every chunk holds arise where their chunk is dealt; they are not shuffled and no content is."""
    from docgraph.operators import retrieval as Q

    chunks, questions = corpus
    c = spark.createDataFrame(chunks, "chunk_id string, document_id long, order_index long, content string").repartition(4)
    q = spark.createDataFrame(questions, "question_id long, question string")
    found = Q.lexical_scores(c, q)
    got, want = {}, brute(chunks, questions, len(chunks))
    for r in found.collect():
        got.setdefault(r["question_id"], {})[r["chunk_id"]] = r["score"]
    assert {i: set(hits) for i, hits in got.items()} == {i: {h[0] for h in hits} for i, hits in want.items() if hits}
    assert all(abs(got[i][chunk] - score) < 1e-8 for i, hits in want.items() for chunk, score in hits)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    overlaps = Q.keyword_overlaps(c, q)
    assert overlaps.where("question_id = 1").count() == len(chunks)
