import random

from pyspark.sql import functions as F

from docgraph.operators import hybrid as H
from docgraph.operators import vectors as V


def test_no_pair_carries_a_text(spark, monkeypatch):
    """A question of words that every chunk holds is scored whole, and no pair meets the content of its chunk again."""
    rng = random.Random(5)
    words = [f"từ{k}" for k in range(30)]
    chunks = [(k, " ".join(rng.choices(words, k=25))) for k in range(400)]
    texts = [(f"q{k}", " ".join(rng.choices(words, k=12))) for k in range(12)] + [("blank", ""), ("none", "khác")]
    chunks = spark.createDataFrame([*chunks, (400, ""), (401, None)], "chunk_id long, content string")
    texts = spark.createDataFrame(texts, "query_id string, query_text string")
    vectors = [V.hash_vectors(chunks, "chunk_id", "content", "m1", unit=False), V.hash_vectors(texts, "query_id", "query_text", "m1", unit=False)]
    held = chunks.fillna("")
    want = H.top_per_key(H.scored_pairs(texts.crossJoin(held.select("chunk_id")), held, texts, *vectors), ["query_id"], H.best_first(), 9)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "semantic_score", "keyword_score", "score").collect())
    want = rows(want)
    monkeypatch.setattr(H, "scored_pairs", None)
    assert rows(H.hybrid_top_k(chunks, texts, 9, block=5, slab=64)) == want and len(want) == 14 * 9


def test_rounding_is_that_of_spark(spark):
    import numpy as np

    rng = random.Random(6)
    values = [0.7 * round(rng.random(), 6) + 0.3 * rng.randrange(40) / 39 for _ in range(4000)] + [0.0000005, 0.1234565, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 6).alias("r"))
    got = df.collect()
    assert H._round6(np.array([r["v"] for r in got])).tolist() == [r["r"] for r in got]


def test_a_scoped_question_meets_a_chunk_once(spark, monkeypatch):
    """All texts of a question are scored in the row of one pair, without stored vectors, as ``scored_pairs`` scores them."""
    rng = random.Random(8)
    words = [f"từ{k}" for k in range(30)]
    chunks = [(f"c{k}", k // 2, " ".join(rng.choices(words, k=25))) for k in range(60)] + [("blank", 30, "")]
    asked = [(q, " ".join(rng.choices([*words, "deadline", "ngân sách"], k=9)), 1 + q % 2) for q in range(20)] + [(20, "", 1)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, document_id long, content string")
    asked = spark.createDataFrame(asked, "question_id long, question string, document_count int")
    scope = spark.createDataFrame([(q, d) for q in range(21) for d in range(31) if (q + d) % 3], "question_id long, document_id long")
    texts = H.retrieval.build_queries(asked).withColumn("query_id", F.concat_ws("#", "question_id", "nth"))
    vectors = [V.hash_vectors(chunks, "chunk_id", "content", "m1", unit=False), V.hash_vectors(texts, "query_id", "query_text", "m1", unit=False)]
    pairs = texts.join(scope, "question_id").join(chunks, "document_id")
    want = H.scored_pairs(pairs, chunks, texts, *vectors)
    monkeypatch.setattr(H, "hybrid_top_k", None)
    monkeypatch.setattr(H.V, "hash_vectors", None)
    found = H.scoped_hits(chunks, asked, scope).withColumn("query_id", F.concat_ws("#", "question_id", "nth"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "semantic_score", "keyword_score", "score").collect())
    assert rows(found) == rows(want) and found.where("nth > 0").count() > 100
    assert H.retrieve(chunks, asked, scope=scope).count() > 300
