"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.session import shared_dir

#: Java form of a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_words(text: str | None) -> list[bytes]:
    """Runs of characters outside ``\\x20\\x09-\\x0D``, as UTF-8; none for null."""
    return text.encode().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def hash_words_twice(words: list[bytes]) -> np.ndarray:
    """A row of two independent 64-bit hashes for each word, the halves of a 128-bit one."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def text_parts(batch: pa.RecordBatch, most: int):
    """Consecutive (ids, texts) of a batch with columns ``id`` and ``text``, of about ``most`` bytes each; null texts as empty.

    Only one part at a time becomes Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield batch["id"].slice(a, b - a), [t or "" for t in batch["text"].slice(a, b - a).to_pylist()]
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, name: str, piece: int = 65_536) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over rows of the same keys with a smaller ``order``.

    ``order`` is a non-negative integer, unique within the keys.  Rows are summed
    in pieces of ``piece`` consecutive orders and then over the pieces, so that
    no task holds all rows of a key.
    """
    from pyspark.sql import Window

    cut = df.withColumn("_piece", F.floor(F.col(order) / piece))
    sums = cut.groupBy(*keys, "_piece").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_piece").alias("_of"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    match = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_piece") == F.col("_of")]
    return cut.join(sums, match).select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


def slices(sizes: list[int], most: int):
    """Consecutive ranges of items whose sizes add up to ``most`` or of one larger item."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
