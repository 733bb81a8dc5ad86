"""Benchmark passages of any length are found wherever a document contains them."""

import random

from docgraph.sources import views
from docgraph.sources.tables import Tables


def hits(spark, folder, texts, quotes):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = sorted((r.item_id, r.doc_id) for r in views.passage_hits(Tables(spark, str(folder))).collect())
    want = [(i, d) for i, q in enumerate(quotes) for d, x in enumerate(texts) if q is not None and x is not None and q in x]
    assert found == sorted(want)
    return want


def test_passages_of_every_length(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abđe", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    texts += [None, "", " ", "one", "  two\t\nwords ", "Điều 1. Thời hạn báo cáo là 30 ngày"]
    quotes = ["thời", "Thời hạn", "Thời hạn báo", "hạn báo cáo là 30 n", "", " ", "two\t\nw", "two w", " words", "o", None]
    for n in range(1, 12):
        for whole in (True, False):
            for _ in range(4):
                w = rng.choice([x.split(" ") for x in texts[:30] if x.count(" ") >= n])
                at = rng.randint(0, len(w) - n)
                passage = " ".join(w[at : at + n])
                quotes.append(passage if whole or len(passage) < 3 else passage[1:-1])
    want = hits(spark, tmp_path, texts, quotes)
    assert {i for i, _ in want} >= set(range(11, len(quotes)))


def test_only_long_passages(spark, tmp_path):
    text = "một hai ba bốn năm sáu bảy tám chín mười"
    assert hits(spark, tmp_path, [text, text[4:], "khác"], [text[1:-1], text[6:-2]]) == [(0, 0), (1, 0), (1, 1)]
