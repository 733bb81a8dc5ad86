"""Quality rules with compression bands.

The zstandard ratio (raw bytes to compressed bytes) of the whole text and of its
fixed chunks must lie between limits that depend on the length: above the band a
text repeats itself, below it the text is noise that does not compress.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import hash_words, mixed, split_words, text_parts

#: (bytes below which the row holds, lowest ratio, highest ratio).  Short texts
#: carry the cost of a frame and have little to refer back to, so their band lies
#: lower.  Base-64 noise stays near 1.3, prose of 4 kB near 2, lists of one phrase above 4.
#: Measured: noise reaches 1.21 below 512 bytes and 1.29 below 1,024, texts of the
#: given tables that pass the base rules start at 1.27 and 1.41.
BANDS = ((256, 0.75, 2.5), (512, 1.25, 2.8), (1_024, 1.32, 2.8), (4_096, 1.4, 3.2), (16_384, 1.5, 3.6), (65_536, 1.6, 4.2), (float("inf"), 1.6, 5.0))
CHUNK_BYTES = 4_096
#: The same for chunks.  Those of 4 kB of the given tables start at 2.0; half prose and half noise comes to 1.6.
CHUNK_BANDS = ((256, 0.75, 2.5), (512, 1.25, 2.8), (1_024, 1.32, 2.8), (2_048, 1.5, 3.2), (4_096, 1.6, 3.2), (float("inf"), 1.7, 3.6))
#: A last chunk shorter than this is measured with the one before: alone it would show little but the cost of its frame.
LEAST_CHUNK = 256
#: Share of a text's chunks that may lie outside their band.
ODD_CHUNKS = 0.1
#: Texts measured together hold so many bytes.
BATCH_BYTES = 2_000_000
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = re.compile(r"[#*$%&|<>]")


def ratio(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(data) / len(compressor.compress(data)) if data else 1.0


def in_band(size: int, value: float, bands=BANDS) -> bool:
    for below, low, high in bands:
        if size < below:
            return low <= value <= high
    return True


def repeated_window_words(texts: list[list[bytes]], window: int = 5) -> np.ndarray:
    """For each text's words: how many lie inside windows whose word sequence occurs twice or more in that text."""
    lengths = np.array([len(w) for w in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if lengths.max(initial=0) <= window:
        return np.zeros(len(texts), np.int64)
    x = np.concatenate([hash_words(words) for words in texts])
    text = np.repeat(np.arange(len(texts)), lengths)
    n = len(x) - window + 1
    inside = text[:n] == text[window - 1 :]
    lanes = []
    for lane in range(2):
        y = x if lane == 0 else mixed(x)
        total = mixed(text[:n].astype(np.uint64) + np.uint64(lane + 1))
        for j, factor in enumerate(FACTORS[lane]):
            total += y[j : j + n] * factor
        lanes.append(total)
    at = np.flatnonzero(inside)
    order = at[np.argsort(lanes[0][at])]
    a, b = lanes[0][order], lanes[1][order]
    equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
    edge = np.zeros(len(x) + 1, np.int64)
    edge[twice] += 1
    edge[twice + window] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


FACTORS = np.random.default_rng(5).integers(1, 1 << 63, (2, 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return len(lines) - len(set(lines))


def chunks_of(data: bytes, chunk_bytes: int) -> list[bytes]:
    cuts = [*range(0, len(data), chunk_bytes), len(data)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < min(LEAST_CHUNK, chunk_bytes):
        del cuts[-2]
    return [data[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def measures(texts: list[str | None], compressor: zstandard.ZstdCompressor, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, odd_chunks: float = ODD_CHUNKS, chunk_bands=CHUNK_BANDS) -> list[tuple]:
    texts = [t or "" for t in texts]
    words = [split_words(t) for t in texts]
    rows = []
    for text, of_text, repeats in zip(texts, words, repeated_window_words(words).tolist()):
        n = len(of_text)
        base_failed = n < 10 or 100 * repeats > 20 * n
        data = text.encode()
        whole = ratio(data, compressor)
        chunks = chunks_of(data, chunk_bytes)
        ratios = [ratio(c, compressor) for c in chunks] if len(chunks) > 1 else [whole] * len(chunks)
        odd = sum(not in_band(len(c), r, chunk_bands if len(chunks) > 1 else bands) for c, r in zip(chunks, ratios))
        verdict = in_band(len(data), whole, bands) and odd <= odd_chunks * len(chunks)
        rows.append((
            n, len(text) - sum(map(text.count, BLANK)), len(SYMBOLS.findall(text)), duplicate_lines(text), repeats, base_failed,
            not base_failed and verdict, whole, min(ratios, default=1.0), max(ratios, default=1.0), odd,
        ))
    return rows


FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("kept", pa.bool_()), ("ratio", pa.float64()), ("lowest_chunk_ratio", pa.float64()), ("highest_chunk_ratio", pa.float64()), ("n_odd_chunks", pa.int64()),
)
SCHEMA = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, lowest_chunk_ratio double, highest_chunk_ratio double, n_odd_chunks long"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, odd_chunks: float = ODD_CHUNKS, chunk_bands=CHUNK_BANDS) -> DataFrame:
    """Per row: id, counts, ``base_failed``, ``kept``, and the ratios behind the verdict.

    Null and empty texts have no words, so they fail the base rules.  Every row is
    judged by itself: repeated rows get the same verdict, null ids stay, other
    columns are not read.
    """

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for ids, texts in text_parts(batch, BATCH_BYTES):
                rows = measures(texts, compressor, bands, chunk_bytes, odd_chunks, chunk_bands)
                columns = {"id": ids} | {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(FIELDS)}
                yield pa.RecordBatch.from_pydict(columns)

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
