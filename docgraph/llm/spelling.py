"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

The vocabulary is counted over all texts.  Its words lie in blocked Bloom filters, one
per word length, which are sent to all tasks.  A task generates the edits of its
words as hashes: a word's hash is the exclusive or of one value per position and
letter, so each edit costs a few operations and no edited word is built.  Only
deletions, and replacements by a later letter, are probed; insertions and the other
replacements are the same pairs seen from the other word.  The edits that a filter
lets through meet the vocabulary in an exact join, which ends the false ones.

The filters of one pass take at most ``FILTER_BYTES``.  A vocabulary that needs more is
probed in several passes, each with the filters of one slice of its hashes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import mixed, stored, text_parts

#: Texts that become Python strings together.
BATCH_BYTES = 2_000_000
#: Counted words that a task holds, in code points, before it hands them on.
HELD_CHARS = 8_000_000
#: Words longer than this share one filter.
LAST_SHARD = 64
#: Bits of a filter per word, bits that a word sets, and 64-bit cells of a block.
BITS_PER_WORD, PROBES, CELLS = 16, 6, 8
#: Bytes of all filters of a pass.
FILTER_BYTES = 16 << 20
#: Blocks that are filled by one task.
SEGMENT = 1_024
#: Edits that are hashed together.
EDITS = 400_000
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.int64)


def counted(docs: DataFrame, id_col: str, text_col: str, least_chars: int, drop_one_in: int) -> DataFrame:
    """(word, n): occurrences as counted by the tasks, several rows a word."""
    run_of_letters = re.compile(f"[A-Za-zÀ-ÿ]{{{least_chars},}}")

    def batch_of(counts):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches):
        counts, held = Counter(), 0
        for batch in batches:
            for ids, texts in text_parts(batch, BATCH_BYTES):
                for doc_id, text in zip(ids.to_pylist(), texts):
                    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(run_of_letters.findall(text.encode().lower().decode())).items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % drop_one_in == 0:
                            p = h % len(word)
                            word = word[:p] + word[p + 1 :]
                            if len(word) < least_chars:
                                continue
                        if word not in counts:
                            held += len(word) + 50
                        counts[word] += n
                if held > HELD_CHARS:
                    yield batch_of(counts)
                    counts, held = Counter(), 0
        yield batch_of(counts)

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "word string, n long")


def values_of(positions: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The value of each letter at its position."""
    return mixed((positions.astype(np.uint64) << np.uint64(8) | letters.astype(np.uint64)) + np.uint64(0x51ED270B9F3A4C1D))


def keys_of(xors: np.ndarray, length: int) -> np.ndarray:
    return mixed(xors ^ mixed(np.array([length], np.uint64)))


def by_length(words: list[str]):
    """(places, letters as a matrix) of the words of each length, in parts of about a million letters."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, 1_000_000 // length)
        for a in range(0, len(places), step):
            part = places[a : a + step]
            yield part, np.frombuffer("".join(words[p] for p in part).encode("latin-1"), np.uint8).reshape(len(part), length)


def keyed(words: DataFrame) -> DataFrame:
    """Adds ``key``, the hash of the word and its length, to (word, n)."""

    def run(batches):
        for batch in batches:
            words = batch["word"].to_pylist()
            keys = np.zeros(len(words), np.uint64)
            for places, letters in by_length(words):
                at = np.arange(letters.shape[1])
                keys[places] = keys_of(np.bitwise_xor.reduce(values_of(at[None, :], letters), axis=1), letters.shape[1])
            yield pa.RecordBatch.from_pydict({"word": batch["word"], "n": batch["n"], "key": pa.array(keys.view(np.int64))})

    return words.mapInArrow(run, "word string, n long, key long")


def bits_of(keys: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell within the block and bit of it that a probe looks at."""
    at = mixed(keys + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(9 * probe)
    return (at >> np.uint64(6) & np.uint64(CELLS - 1)).astype(np.int64), at & np.uint64(63)


def high_product(key: Column, n: Column) -> Column:
    """The upper half of the key scaled to 0..n-1."""
    return F.shiftright(F.shiftrightunsigned(key, 32) * n, 32)


class Filters:
    """Blocked Bloom filters of one slice of the vocabulary, by shard of word length."""

    def __init__(self, cells: dict[int, np.ndarray], slice_no: int, slices: int):
        self.cells, self.slice_no, self.slices = cells, slice_no, slices

    def maybe(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be words of this length in the slice."""
        cells = self.cells.get(min(length, LAST_SHARD))
        if cells is None:
            return np.zeros(0, np.int64)
        left = np.arange(len(keys))
        if self.slices > 1:
            left = np.flatnonzero(keys % np.uint64(self.slices) == self.slice_no)
        starts = ((keys >> np.uint64(32)) * np.uint64(len(cells) // CELLS) >> np.uint64(32)).astype(np.int64) * CELLS
        for probe in range(PROBES):
            cell, bit = bits_of(keys[left], probe)
            left = left[(cells[starts[left] + cell] >> bit & np.uint64(1)).astype(bool)]
        return left


def build_filters(vocabulary: DataFrame, blocks: dict[int, int], slice_no: int, slices: int) -> Filters:
    """Tasks fill segments of the filters; the driver puts at most ``FILTER_BYTES`` of them together."""
    spark = vocabulary.sparkSession
    sizes = F.broadcast(spark.createDataFrame(list(blocks.items()), "shard int, blocks long"))  # a row per shard, LAST_SHARD at most
    rows = vocabulary.where(unsigned_mod(F.col("key"), slices) == slice_no).join(sizes, "shard")
    rows = rows.select("shard", "key", high_product(F.col("key"), F.col("blocks")).alias("block"))
    rows = rows.withColumn("segment", F.floor(F.col("block") / SEGMENT).cast("long"))

    def run(batches):
        found = {}
        for batch in batches:
            shard, key, block, segment = (batch[c].to_numpy() for c in ("shard", "key", "block", "segment"))
            for s, g in set(zip(shard.tolist(), segment.tolist())):
                cells = found.setdefault((s, g), np.zeros(SEGMENT * CELLS, np.uint64))
                mine = (shard == s) & (segment == g)
                for probe in range(PROBES):
                    cell, bit = bits_of(key[mine].view(np.uint64), probe)
                    np.bitwise_or.at(cells, (block[mine] - g * SEGMENT) * CELLS + cell, np.uint64(1) << bit)
        for (s, g), cells in found.items():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "segment": pa.array([g], pa.int64()), "cells": pa.array([cells.tobytes()], pa.binary())})

    made = rows.repartition("shard", "segment").mapInArrow(run, "shard int, segment long, cells binary").collect()
    cells = {s: np.zeros(-(-n // SEGMENT) * SEGMENT * CELLS, np.uint64) for s, n in blocks.items()}
    for r in made:
        cells[r["shard"]][r["segment"] * SEGMENT * CELLS :][: SEGMENT * CELLS] = np.frombuffer(r["cells"], np.uint64)
    return Filters({s: c[: blocks[s] * CELLS] for s, c in cells.items()}, slice_no, slices)


def unsigned_mod(key: Column, n: int) -> Column:
    """The key, read as unsigned, modulo ``n``."""
    high, low = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))
    return (high % n * ((1 << 32) % n) + low % n) % n


def edits(letters: np.ndarray, filters: Filters):
    """(word, position, letter or 0 for a deletion, key) of the edits of words of one length that a filter lets through."""
    n, length = letters.shape
    at = np.arange(length)
    own = values_of(at[None, :], letters)
    whole = np.bitwise_xor.reduce(own, axis=1)
    known = set(filters.cells)
    if min(length - 1, LAST_SHARD) in known:
        moved = values_of(np.maximum(at - 1, 0)[None, :], letters)
        before = np.bitwise_xor.accumulate(own, axis=1) ^ own
        after = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1] ^ moved
        first = np.ones(letters.shape, bool)  # deleting any letter of a run gives the same word
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        word, place = np.nonzero(first)
        keys = keys_of((before ^ after)[word, place], length - 1)
        hit = filters.maybe(length - 1, keys)
        yield word[hit], place[hit], np.zeros(len(hit), np.int64), keys[hit]
    if min(length, LAST_SHARD) in known:
        step = max(1, EDITS // (len(LETTERS) * n))
        for a in range(0, length, step):
            span = at[a : a + step]
            word, k, letter = np.nonzero(LETTERS[None, None, :] > letters[:, span, None])
            new = values_of(span[:, None], LETTERS[None, :])
            keys = keys_of(whole[word] ^ own[word, span[k]] ^ new[k, letter], length)
            hit = filters.maybe(length, keys)
            yield word[hit], span[k[hit]], LETTERS[letter[hit]], keys[hit]


def probed(vocabulary: DataFrame, filters: Filters) -> DataFrame:
    """(no, at, letter, key): edits of the words that may be words themselves."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)  # FILTER_BYTES at most

    def run(batches):
        for batch in batches:
            no, words = batch["no"].to_numpy(), batch["word"].to_pylist()
            for places, letters in by_length(words):
                step = max(1, EDITS // (4 * letters.shape[1]))
                for a in range(0, len(places), step):
                    for word, at, letter, key in edits(letters[a : a + step], shared.value):
                        yield pa.RecordBatch.from_pydict({
                            "no": pa.array(no[places[a : a + step][word]]), "at": pa.array(at, pa.int64()),
                            "letter": pa.array([chr(c) if c else "" for c in letter.tolist()], pa.string()), "key": pa.array(key.view(np.int64)),
                        })

    # Dealt out evenly by number, as the work is in the words and not in their bytes.
    cores = vocabulary.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return vocabulary.select("no", "word").repartition(parts, "no").mapInArrow(run, "no long, at long, letter string, key long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b): numbers of the words that differ by one edit, each pair once."""
    counts = {r["shard"]: r["words"] for r in vocabulary.groupBy("shard").agg(F.count("*").alias("words")).collect()}
    total = sum(counts.values()) * BITS_PER_WORD // 8
    slices = -(-total // FILTER_BYTES)
    if not slices:
        return vocabulary.select(F.col("no").alias("a"), F.col("no").alias("b")).limit(0)
    blocks = {s: -(-n * BITS_PER_WORD // (64 * CELLS * slices)) for s, n in counts.items()}
    found = None
    for slice_no in range(slices):
        part = stored(probed(vocabulary, build_filters(vocabulary, blocks, slice_no, slices)), "spelling-positives")
        found = part if found is None else found.union(part)
    target = vocabulary.select(F.col("no").alias("b"), F.col("word").alias("of_b"), "key")
    met = found.join(target, "key").join(vocabulary.select("no", F.col("word").alias("of_a")), "no")
    made = F.expr("concat(substring(of_a, 1, int(at)), letter, substring(of_a, int(at) + 2))")
    return met.where(made == F.col("of_b")).select(F.col("no").alias("a"), "b")


def last_forms(forms: DataFrame) -> DataFrame:
    """(no, root) for (no, form): each form is followed to the last by doubling the steps; a form has a multiple of n, so there are few."""
    steps = stored(forms.select("no", F.col("form").alias("root")), "spelling-steps")
    while True:
        further = steps.select(F.col("no").alias("root"), F.col("root").alias("next"))
        joined = steps.join(further, "root", "left").select("no", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = stored(joined, "spelling-steps")
        if not new.where("moved").limit(1).count():
            return new.select("no", "root")
        steps = new.select("no", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5, times: int = 5, drop_one_in: int = 199) -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are runs of Latin letters of all texts, with one letter dropped where a hash of
    id and run says so (a null id hashes as an empty one).  Null and empty texts have no
    words, repeated rows count again, and other columns are not read.  Words of any
    length take part.
    """
    counts = counted(docs, id_col, text_col, least_chars, drop_one_in).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    numbered = keyed(counts).withColumn("no", F.monotonically_increasing_id())
    vocabulary = stored(numbered.withColumn("shard", F.least(F.length("word"), F.lit(LAST_SHARD))), "spelling-vocabulary")
    pairs = stored(near_pairs(vocabulary), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a"))
    named = vocabulary.select(F.col("no").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(named, "b").groupBy(F.col("a").alias("no")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near"), F.col("b"))).alias("best")
    )
    chosen = F.when(-F.col("best.minus_n") >= times * F.col("n"), F.col("best"))
    found = vocabulary.select("no", "word", "n").join(best, "no", "left").withColumn("best", chosen)
    found = stored(found.select("no", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.minus_n")).alias("form_n"), F.col("best.b").alias("form_no")), "spelling-forms")
    roots = last_forms(found.where("form_no IS NOT NULL").select("no", F.col("form_no").alias("form")))
    roots = roots.join(vocabulary.select(F.col("no").alias("root"), F.col("word").alias("root_word")), "root").select("no", "root_word")
    return found.join(roots, "no", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
