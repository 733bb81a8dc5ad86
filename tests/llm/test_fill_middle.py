import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from docgraph.llm import fill_middle as M

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text):
    text = text or ""
    w = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(w), "plain", None, None, text
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < 80:
        return doc_id, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 6, 17, 300, 5_000):
        widths = rng.integers(1, 9, n)
        nodes = M.SkipList(widths)
        sums = np.concatenate([[0], np.cumsum(widths)])
        ranks = range(n + 1) if n < 1_000 else rng.integers(0, n + 1, 500).tolist()
        assert [nodes.width_before(r) for r in ranks] == [int(sums[r]) for r in ranks]
        assert n < 300 or len(nodes.lanes) > 3


def test_widths_are_those_of_the_tokens(texts):
    for t in texts:
        assert M.token_widths(t or "").tolist() == [len(x) for x in TOKEN.findall(t or "")]


def test_rows_equal_brute_force_and_texts_come_back(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    odd = ["a <P> b c", "x<S>", "<M>", "< P> <", "<P", "S> x <", "ends with blank  ", "  \n", "<S <P <M a b c"]
    extra = [(10_000 + i, odd[i % len(odd)], "clash") for i in range(200)]
    more = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame(extra, "doc_id long, text string, key string"))
    made = M.fill_in_middle(more).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(*r[:2]) for r in [*rows, *extra]), key=str)
    assert sorted((tuple(r)[:6] for r in made), key=str) == want
    texts = sorted((r[1] or "") for r in [*rows, *extra])
    assert sorted(r["back"] for r in made) == texts
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_empty_table(no_docs):
    assert M.fill_in_middle(no_docs).collect() == []
