import base64
import random
import re

import zstandard

from docgraph.llm import quality as Q


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (str(r["doc_id"]), r["text"] or ""))
    want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in rows)
    found = Q.quality(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_bands_reject_repeats_and_noise():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "re", "on", "ti", "an", "s", "ed", "in", "or"]) for _ in range(rng.randint(1, 3)))
    prose = " ".join(word() for _ in range(900))
    phrases = [" ".join(word() for _ in range(4)) for _ in range(3)]
    listed = " ".join(f"{rng.choice(phrases)} {i}" for i in range(400))
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(900))
    rows = Q.measures([prose, listed, noise, prose[:300]], zstandard.ZstdCompressor())
    assert [r[6] for r in rows] == [True, False, False, True]
    assert not rows[1][5] and not rows[2][5]


def test_odd_chunks_reject_a_text_that_is_fine_as_a_whole():
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices("etaoinshr", k=5)) for _ in range(2_000))
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(2_400))
    row = Q.measures([prose + noise], zstandard.ZstdCompressor(), odd_chunks=0.3)[0]
    assert row[10] > 0 and not row[6]


def noise(rng, size, letters=20):
    return " ".join(base64.b64encode(rng.randbytes(letters * 3 // 4)).decode() for _ in range(size // (letters + 1) + 1))[:size]


def prose(rng, size):
    syllables = ["the", "re", "on", "ti", "an", "s", "ed", "in", "or", "al", "ment", "com", "pro", "ver", "st", "qu"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(2_000)]
    return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(2_000)], k=size // 3 + 1))[:size]


def test_noise_and_prose_at_several_lengths():
    rng = random.Random(11)
    for size in (300, 450, 511, 512, 700, 900, 1_023, 1_024, 2_000, 4_095, 4_100, 4_360, 9_000, 40_000, 100_000):
        rows = Q.measures([prose(rng, size)] + [noise(rng, size, letters) for letters in (8, 12, 20)], zstandard.ZstdCompressor(level=3))
        assert [r[6] for r in rows] == [True, False, False, False], size


def test_noise_in_part_of_a_long_text():
    rng = random.Random(12)
    for size in (40_000, 100_000):
        for share in (0.2, 0.3, 0.45, 0.5):
            cut = int(size * share)
            text = prose(rng, size - cut)
            for mixed in (text + noise(rng, cut), noise(rng, cut) + text, text[: cut // 2] + noise(rng, cut) + text[cut // 2 :]):
                row = Q.measures([mixed], zstandard.ZstdCompressor(level=3))[0]
                assert not row[5] and not row[6], (size, share, row)


def test_empty_table(no_docs):
    assert Q.quality(no_docs).collect() == []
