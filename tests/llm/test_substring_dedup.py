import hashlib
from collections import Counter

import numpy as np

from docgraph.llm import substring_dedup as S


def expected(rows, window=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            if i is not None:
                least[s] = min(least.get(s, i), i)
    out = Counter()
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            first = least.get(tuple(w[k : k + window]))
            if first is not None and (i is None or first < i):
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, len(w), len(w) - len(kept), b" ".join(kept).decode()] += 1
    return out


def test_equals_brute_force_in_many_small_chunks(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = Counter(tuple(r) for r in S.remove_repeats(docs, chunk_bytes=3_000).collect())
    assert found == expected(rows)
    assert sum(k[2] for k in found) > 0


def test_full_counters_lose_nothing(docs, monkeypatch):
    # Two cells: every estimate is far too high, so all windows are grouped exactly.
    monkeypatch.setattr(S, "CELL_BITS", 1)
    table = docs.where("doc_id < 40").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    local = S.Chunk(__import__("pyarrow").table({"id": [r[0] for r in rows], "text": [r[1] for r in rows], "chunk": [0] * len(rows)}), 13)
    assert len(np.unique(local.cells(0, 1))) <= 2


def test_words_of_equal_half_hash_stay_apart(monkeypatch):
    real = S.hash_words_twice

    def half_equal(words):
        found = real(words).copy()
        found[:, 0] = 5
        return found

    monkeypatch.setattr(S, "hash_words_twice", half_equal)
    texts = [" ".join(f"{c}{k}" for k in range(13)) for c in "ab"]
    chunk = S.Chunk(__import__("pyarrow").table({"id": [1, 2], "text": texts, "chunk": [0, 0]}), 13)
    assert len(set(chunk.lanes[0].tolist())) == 1 and len(chunk.keys(np.arange(2), 1)[0]) == 2


def test_offsets_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 23, 5_000))
    assert (S.unpack_offsets(S.pack_offsets(x)) == x).all()


def test_empty_table(no_docs):
    assert S.remove_repeats(no_docs).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
