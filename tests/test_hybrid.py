import random

import pytest

from docgraph.operators import hybrid as H
from docgraph.operators import vectors as V


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [f"từ{k}" for k in range(120)]
    chunks = [(f"c{k:03}", k // 2, "the " + " ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(120)], k=rng.randint(2, 40)))) for k in range(300)]
    texts = [(f"q{k}", " ".join(["the", *rng.choices(words, k=rng.randint(1, 12))])) for k in range(25)] + [("all", "the"), ("own", chunks[9][2]), ("none", "nothing here"), ("blank", "")]
    return spark.createDataFrame(chunks, "chunk_id string, document_id long, content string"), spark.createDataFrame(texts, "query_id string, query_text string")


@pytest.mark.parametrize("k, depth", [(5, 5), (10, 12), (20, None), (400, None)])
def test_merged_lists_equal_a_full_scoring(corpus, k, depth):
    chunks, texts = corpus
    vectors = [V.hash_vectors(chunks, "chunk_id", "content", "m1", unit=False), V.hash_vectors(texts, "query_id", "query_text", "m1", unit=False)]
    full = H.scored_pairs(texts.crossJoin(chunks.select("chunk_id")), chunks, texts, *vectors)
    want = H.top_per_key(full, ["query_id"], H.best_first(), k)
    got = H.hybrid_top_k(chunks, texts, k, depth=depth)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect())
    assert rows(got) == rows(want)


def test_a_second_query_text_finds_more(spark):
    """The expansion of a question about a time limit brings in a chunk that shares nothing with its own words."""
    chunks = spark.createDataFrame([("own", 1, "khi nào phải nộp"), ("other", 1, "số ngày thời điểm bắt đầu kết thúc"), *[(f"x{k}", 1, f"khác{k} văn bản") for k in range(60)]], "chunk_id string, document_id long, content string")
    asked = lambda q, n: spark.createDataFrame([(1, q, n)], "question_id long, question string, document_count int")
    with_limit = [r["chunk_id"] for r in H.retrieve(chunks, asked("deadline nộp khi nào", 1)).orderBy("rank").collect()]
    assert with_limit[:2] == ["own", "other"] or with_limit[:2] == ["other", "own"]
    assert len(with_limit) == 20
    assert H.retrieve(chunks, asked("deadline nộp khi nào", 2)).count() == 40
    scope = spark.createDataFrame([(1, 7)], "question_id long, document_id long")
    assert H.retrieve(chunks, asked("nộp", 1), scope=scope).count() == 0
