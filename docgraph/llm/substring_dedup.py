"""Substring dedup: words covered by a window that an earlier document holds are removed.

Documents are dealt by hash into chunks of about ``chunk_bytes``, shuffled once.
1. Every chunk writes a count-min sketch of its windows: two rows of counters,
   cut into blocks of cells, kept sparse and as small numbers.
2. Each block is merged over all chunks by adding counters, and each chunk learns
   which of its cells hold two or more.  Counters only over-estimate, so no
   window that occurs twice is lost.
3. Windows whose smallest counter is two or more go, once per chunk, to a group
   by their 128-bit hash, where the smallest document of each is found exactly.
4. Every chunk removes what an earlier document, there or elsewhere, holds.

The sketch has eight cells per window at any corpus size and is spread over
blocks; neither it nor a set of hashes is held whole anywhere.  A window in a
third of all documents is one entry per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import hash_words_twice, mixed, split_words

CELL_BITS = 23
#: Windows meant for one block of cells, which sets eight cells per window.
WINDOWS_PER_BLOCK = 1 << 20
LAST = np.iinfo(np.int64).max


def factors(window: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Chunk:
    """The words and windows of a chunk's documents, in the order of (id, text)."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table["id"].to_pylist(), table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.words = [split_words(texts[i]) for i in order]
        self.window = window
        lengths = np.array([len(w) for w in self.words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        halves = np.empty((2, starts[-1]), np.uint64)
        for words, a in zip(self.words, starts):
            halves[:, a : a + len(words)] = hash_words_twice(words).T
        counts = np.maximum(lengths - window + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(lengths)), counts)
        at = np.arange(self.first[-1]) - self.first[self.doc] + starts[self.doc]
        self.lanes = []
        for lane, x in enumerate(halves):  # each lane has its own hash of a word, so that windows have 128 bits
            total = np.zeros(max(len(x) - window + 1, 0), np.uint64)
            for j, factor in enumerate(factors(window, 7 + lane)):
                total += x[j : j + len(total)] * factor
            self.lanes.append(mixed(total[at]))

    def cells(self, row: int, blocks: int) -> np.ndarray:
        g = mixed(self.lanes[row] + np.uint64(row + 1))
        block = ((g >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        return (block << np.uint64(CELL_BITS)) | (g & np.uint64((1 << CELL_BITS) - 1))

    def keys(self, chosen: np.ndarray, buckets: int):
        """Distinct windows among the chosen, ascending: their lanes, bucket, first document, and the entry of each chosen."""
        a, b = self.lanes[0][chosen], self.lanes[1][chosen]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        entry = np.empty(len(a), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = np.full(int(new.sum()), len(self.ids), np.int64)
        np.minimum.at(first, entry, self.doc[chosen])
        bucket = ((a[new] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return a[new], b[new], bucket.astype(np.int64), first, entry

    def numbers(self) -> np.ndarray:
        """Ids; a null id comes after all others."""
        return np.array([LAST if i is None else i for i in self.ids], np.int64)


def pack_offsets(offsets: np.ndarray) -> bytes:
    """Ascending offsets as the byte planes of their differences, compressed."""
    steps = np.diff(offsets.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_offsets(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.int64)


def cut(sorted_groups: np.ndarray):
    """Runs of equal values: (value, from, to)."""
    edges = np.flatnonzero(np.diff(sorted_groups)) + 1
    starts = np.concatenate([[0], edges]) if len(sorted_groups) else []
    ends = np.concatenate([edges, [len(sorted_groups)]]) if len(sorted_groups) else []
    for a, b in zip(starts, ends):
        yield int(sorted_groups[int(a)]), int(a), int(b)


def sketch_of(window: int, blocks: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        out = {"slot": [], "chunk": [], "cells": [], "twice": []}
        for row in range(2):
            cells, counts = np.unique(chunk.cells(row, blocks), return_counts=True)
            for block, a, b in cut(cells >> np.uint64(CELL_BITS)):
                out["slot"].append(row * blocks + block)
                out["chunk"].append(table["chunk"][0].as_py())
                out["cells"].append(pack_offsets(cells[a:b] & np.uint64((1 << CELL_BITS) - 1)))
                out["twice"].append(np.packbits(counts[a:b] > 1).tobytes())
        return pa.table(out, SKETCH)

    return run


SKETCH = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])
ANSWER = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("bits", pa.binary())])
CANDIDATES = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("docs", pa.binary()), ("doc", pa.binary())])


def merge_sketches(table: pa.Table) -> pa.Table:
    """Adds the counters of one block over all chunks (they stop at 255) and tells each chunk which reach two."""
    counters = np.zeros(1 << CELL_BITS, np.uint8)
    for cells, twice in zip(table["cells"], table["twice"]):
        at = unpack_offsets(cells.as_py())
        more = 1 + np.unpackbits(np.frombuffer(twice.as_py(), np.uint8), count=len(at))
        counters[at] = np.minimum(counters[at].astype(np.uint16) + more, 255)
    bits = [np.packbits(counters[unpack_offsets(cells.as_py())] > 1).tobytes() for cells in table["cells"]]
    return pa.table([table["slot"], table["chunk"], pa.array(bits, pa.binary())], schema=ANSWER)


def candidates_of(window: int, blocks: int, buckets: int):
    """Windows with all counters at two or more, by bucket; and one row (slot below 0) that marks them for this chunk."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return CANDIDATES.empty_table()
        chunk = Chunk(docs, window)
        number = docs["chunk"][0].as_py()
        known = dict(zip(answers["slot"].to_pylist(), answers["bits"]))
        likely = np.ones(len(chunk.doc), bool)
        for row in range(2):
            own = chunk.cells(row, blocks)
            cells = np.unique(own)
            flags = np.empty(len(cells), bool)
            for block, a, b in cut(cells >> np.uint64(CELL_BITS)):
                flags[a:b] = np.unpackbits(np.frombuffer(known[row * blocks + block].as_py(), np.uint8), count=b - a)
            likely &= flags[np.searchsorted(cells, own)]
        out = {"slot": [-1 - number], "chunk": [number], "a": [np.packbits(likely).tobytes()], "b": [None], "docs": [None], "doc": [None]}
        keys_a, keys_b, bucket, first, _ = chunk.keys(np.flatnonzero(likely), buckets)
        ids = chunk.numbers()
        for slot, a, b in cut(bucket):
            docs_here, doc = np.unique(ids[first[a:b]], return_inverse=True)
            out["slot"].append(slot)
            out["chunk"].append(number)
            out["a"].append(keys_a[a:b].astype("<u8").tobytes())
            out["b"].append(keys_b[a:b].astype("<u8").tobytes())
            out["docs"].append(docs_here.astype("<i8").tobytes())
            out["doc"].append(doc.astype("<u4").tobytes())
        return pa.table(out, CANDIDATES)

    return run


def group_exactly(table: pa.Table) -> pa.Table:
    """For each chunk's windows of a bucket: whether another chunk holds one in a smaller document."""
    if table["slot"][0].as_py() < 0:
        return pa.table([table["slot"], table["chunk"], table["a"]], schema=ANSWER)
    parts = [(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8"), np.frombuffer(d.as_py(), "<i8")[np.frombuffer(i.as_py(), "<u4")]) for a, b, d, i in zip(table["a"], table["b"], table["docs"], table["doc"])]
    a, b, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = np.empty(len(a), np.int64)
    least[order] = doc[order][new][np.cumsum(new) - 1]
    earlier = least < doc
    ends = np.cumsum([len(p[0]) for p in parts])
    bits = [np.packbits(earlier[e - len(p[0]) : e]).tobytes() for e, p in zip(ends, parts)]
    return pa.table([table["slot"], table["chunk"], pa.array(bits, pa.binary())], schema=ANSWER)


RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def remove_of(window: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return RESULT.empty_table()
        chunk = Chunk(docs, window)
        known = dict(zip(answers["slot"].to_pylist(), answers["bits"]))
        gone = np.zeros(len(chunk.doc), bool)
        number = docs["chunk"][0].as_py()
        if -1 - number in known:
            likely = np.unpackbits(np.frombuffer(known[-1 - number].as_py(), np.uint8), count=len(chunk.doc)).astype(bool)
            chosen = np.flatnonzero(likely)
            _, _, bucket, first, entry = chunk.keys(chosen, buckets)
            elsewhere = np.zeros(len(bucket), bool)
            for slot, a, b in cut(bucket):
                elsewhere[a:b] = np.unpackbits(np.frombuffer(known[slot].as_py(), np.uint8), count=b - a)
            ids = chunk.numbers()
            if len(chosen):
                gone[chosen] = elsewhere[entry] | (ids[first[entry]] < ids[chunk.doc[chosen]])
        out = {"id": chunk.ids, "n_words": [], "n_removed": [], "kept": []}
        for d, words in enumerate(chunk.words):
            bad = np.flatnonzero(gone[chunk.first[d] : chunk.first[d + 1]])
            if len(bad):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, bad, 1)
                np.add.at(edge, bad + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = [words[i] for i in np.flatnonzero(keep)]
            else:
                kept = words
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept).decode())
        return pa.table(out, RESULT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, chunk_bytes: int = 6 << 20) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and the ``kept`` words joined by one space.

    A word goes when a window of ``window`` words over it also starts in a row
    with a smaller id.  Null and empty texts have no words.  A null id comes
    after all others; rows of one id never remove each other's words.  Repeated
    rows stay rows.  Other columns are not read.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    blocks = max(1, -(-size // (6 * WINDOWS_PER_BLOCK)))
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    sketches = dealt.groupBy("chunk").applyInArrow(sketch_of(window, blocks), "slot long, chunk long, cells binary, twice binary")
    answers = sketches.groupBy("slot").applyInArrow(merge_sketches, "slot long, chunk long, bits binary")
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        candidates_of(window, blocks, blocks), "slot long, chunk long, a binary, b binary, docs binary, doc binary"
    )
    exact = found.groupBy("slot").applyInArrow(group_exactly, "slot long, chunk long, bits binary")
    kept = dealt.groupBy("chunk").cogroup(exact.groupBy("chunk")).applyInArrow(
        remove_of(window, blocks), "id long, n_words long, n_removed long, kept string"
    )
    return kept.withColumnRenamed("id", id_col)
