import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from docgraph.llm import bpe


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(bpe.vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


def test_odd_texts_equal_the_library(library):
    rng = random.Random(3)
    odd = ["", "a" * 5_000, "<|endoftext|>", "x<|endoftext|> y  <|endoftext|><|endoftext|>", " \n\n   x", "don't we'll 12ab  ", "日本語" * 60, "ab \x1c \x85 c", "ſ's", " " * 500]
    odd += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(300)]
    odd += ["".join(rng.choice("ab e'é1 \n.!<|endoftext|>") for _ in range(80)) for _ in range(300)]
    own = bpe.ByteBpe(bpe.vocabulary())
    ids = own.encode(odd)
    for text, found, back in zip(odd, ids, own.decode(ids)):
        want = library.encode(text, add_special_tokens=False).ids
        assert found.tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)


def test_store_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "ROOM", 50)
    own = bpe.ByteBpe(bpe.vocabulary())
    texts = [f"word{i} again" for i in range(400)]
    first = [i.tolist() for t in texts for i in own.encode([t])]
    assert first == [i.tolist() for i in bpe.ByteBpe(bpe.vocabulary()).encode(texts)]
    assert len(own.place) < 60


def test_rows(docs, library):
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.encode_decode(docs).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), tuple(ids)] += 1
    assert found == want


def test_empty_table(no_docs):
    assert bpe.encode_decode(no_docs).collect() == []
