import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docgraph.llm import token_files as R


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(R.vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture()
def block():
    ids = (np.random.default_rng(0).zipf(1.3, 300_000) % 40_000).astype(np.uint32)
    used, n = np.unique(ids, return_counts=True)
    coder = R.Coder(*R.quantised(dict(zip(used.tolist(), n.tolist()))))
    return coder, ids, coder.encode(ids) | {"n_ids": len(ids), "shard": 0, "number": 0}


def test_exact_round_trip_near_the_entropy(block):
    coder, ids, row = block
    assert (coder.decode(row) == ids).all()
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n * np.log2(n / n.sum())).sum() / 8
    assert len(row["payload"]) < 1.01 * entropy
    for size in (1, 1_023, 1_024, 1_025, R.STEPS * R.LANES, R.STEPS * R.LANES + 1):
        part = coder.encode(ids[:size]) | {"n_ids": size, "shard": 0, "number": 0}
        assert (coder.decode(part) == ids[:size]).all()


def test_decoding_from_checkpoints(block):
    coder, ids, row = block
    step = R.STEPS * R.LANES
    assert (coder.decode(row, 1, 2) == ids[step : 2 * step]).all()
    assert (coder.decode(row, 2) == ids[2 * step :]).all()


def test_damage_is_seen(block):
    coder, _, row = block
    bad = bytearray(row["payload"])
    bad[1_000] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(row | {"payload": bytes(bad)})


def test_frequencies_add_up():
    ids, freq = R.quantised({5: 10**12, 7: 1, 9: 3})
    assert freq.sum() == 1 << R.SCALE_BITS and freq.min() >= 1 and ids.tolist() == [5, 7, 9]
    assert len(R.quantised({})[0]) == 0


def test_words_equal_whole_texts(library):
    import random

    rng = random.Random(1)
    odd = ["", "ΣΑΣ ΟΔΟΣ ", "<|startoftext|> x<|endoftext|>", " é ̈x", "a b\x1cc\x85d", "don't  we'll"]
    odd += ["".join(chr(rng.choice([32, 32, 0x3A3, rng.randint(0, 0x36F), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(300)]
    odd += ["".join(rng.choice("aBzÉéßÀÿŒœĲıİſŽǄǅȺɐ.,'") for _ in range(rng.randint(1, 6))) + " " for _ in range(3_000)]
    odd += [" ".join(chr(c) + end for c in range(0x20, 0x260)) for end in ("", "a", ".", ",,", "A,")]
    odd += ["".join(rng.choice("abÉ.,*%_<|>'!1") for _ in range(rng.randint(1, 7))) + rng.choice([" ", "\n", "\t"]) for _ in range(3_000)]
    for text, found in zip(odd, R.WordEncoder(R.vocabulary()).encode(odd)):
        assert found.tolist() == library.encode(text, add_special_tokens=False).ids


def test_files(docs, library, tmp_path, monkeypatch, spark):
    R.write(docs, str(tmp_path / "set"), shard_rows=20)
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *library.encode(r["text"] or "", add_special_tokens=False).ids, 2) for r in rows)
    found = R.read(spark, str(tmp_path / "set")).join(R.block_starts(spark, str(tmp_path / "set")), ["shard", "block"]).collect()
    found = sorted(found, key=lambda r: r["block_start"] + r["before"])
    assert [(r["id"] is not None, r["id"] or 0) for r in found] == [w[:2] for w in want]
    assert sorted((r["id"] is not None, r["id"] or 0, *r["ids"]) for r in found) == want
    start = 0
    for r in found:
        assert r["block_start"] + r["before"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    trip = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in R.round_trip(docs).collect()}
    assert {(i, n, c) for i, _, n, c in trip} == {(r["id"], r["n_tokens"], r["ids_crc32"]) for r in found}


def test_empty_table(no_docs):
    assert R.round_trip(no_docs).collect() == []
