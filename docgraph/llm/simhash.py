"""SimHash near-dedup by covering locality-sensitive hashing.

Every fingerprint bit i gets a vector m(i) of radius + 1 bits.  Each non-zero
vector v of that length is a table, whose key is the fingerprint restricted to
the bits with odd <m(i), v>.  Any ``radius`` vectors m(i) leave some v that is
orthogonal to all of them, so two fingerprints within the radius agree on the key
of that table: no pair is lost, whatever the fingerprints are.

Only distinct fingerprints meet.  The members of a key are compared in their
task, and a task returns a spanning forest of the links, not the pairs.  Keys with
more than ``group_limit`` members are cut into blocks, and every pair of blocks
is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import split_words, stored, text_parts
from docgraph.llm.components import components

BITS = 64
#: Texts that become Python strings together.
BATCH_BYTES = 2_000_000
SHINGLE = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values (seed 42) of the word shingles; 0 without words."""
    words = split_words(text)
    words = b" ".join(words).lower().split(b" ") if words else []
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 1:
        pieces = [line]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        pieces = [line[a:b] for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    h = np.array([xxhash.xxh64_intdigest(p, 42) for p in pieces], "<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def covering_masks(radius: int, seed: int = 11) -> list[int]:
    """The 2^(radius + 1) - 1 masks; every table keeps about half of the bits."""
    width = radius + 1
    vectors = np.random.default_rng(seed).permutation(np.arange(BITS) % ((1 << width) - 1) + 1)
    return [sum(1 << i for i in range(BITS) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, 1 << width)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``id`` and ``fp`` (64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            for ids, texts in text_parts(batch, BATCH_BYTES):
                values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
                yield pa.RecordBatch.from_pydict({"id": ids, "fp": pa.array(values.view(np.int64))})

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, fp long")


def forest(values: np.ndarray, blocks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what links within the radius join among the members of a group.

    ``blocks`` says from which of two blocks a member is; with two of them only
    pairs across count, as the pairs inside have groups of their own.
    """
    n = len(values)
    label = np.arange(n)
    u = values.view(np.uint64)
    across = blocks.min() != blocks.max()
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    if across:
        near &= (blocks[:, None] != blocks[None, :]) | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        if (new == label).all():
            break
        label = new
    # One spanning tree of each set: a member links to a neighbour that was reached before it.
    links, reached = [], label == np.arange(n)
    front = np.flatnonzero(reached)
    while len(front):
        open_ = near[front] & ~reached[None, :]
        hit = np.flatnonzero(open_.any(0))
        parents = front[open_[:, hit].argmax(0)]
        links += zip(values[hit].tolist(), values[parents].tolist())
        reached[hit] = True
        front = hit
    return links


def links_in_sorted(radius: int):
    """Over rows sorted by group: the links of each group.  Holds one group, of at most two blocks, at a time."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def whole_groups(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            columns = [table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("table_no", "key", "pair", "block", "fp")]
            last = np.ones(len(columns[0]), bool)
            for c in columns[:3]:
                last &= c == c[-1]
            start = len(last) - int(last[::-1].cumprod().sum())
            rest = table.slice(start)
            yield [c[:start] for c in columns]
        if rest is not None:
            yield [rest[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("table_no", "key", "pair", "block", "fp")]

    def run(batches):
        for table_no, key, pair, block, fp in whole_groups(batches):
            if not len(fp):
                continue
            new = np.ones(len(fp), bool)
            new[1:] = (table_no[1:] != table_no[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            two = starts[sizes == 2]
            near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
            links = list(zip(fp[two[near]].tolist(), fp[two[near] + 1].tolist()))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                links += forest(fp[s : s + n], block[s : s + n], radius)
            if links:
                x, y = zip(*links)
                yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())}, schema=schema)

    return run


def near_links(fps: DataFrame, radius: int = 3, group_limit: int = 1_000, seed: int = 11) -> DataFrame:
    """Links (x, y) between distinct fingerprints, which join all that pairs within the radius join."""
    masks = covering_masks(radius, seed)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(v).alias("table_no"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(masks)])).alias("t"))
    keyed = keyed.select("fp", "t.table_no", "t.key")
    shared = keyed.groupBy("table_no", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = keyed.join(shared, ["table_no", "key"])
    blocks = F.ceil(F.col("members") / group_limit).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(seed)), F.col("blocks")).cast("int"))
    # A block meets every other and itself: pair number = smaller * blocks + larger.
    partners = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = met.select("table_no", "key", "block", "fp", "blocks", F.explode(partners).alias("other"))
    pair = F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")
    met = met.select("table_no", "key", pair.alias("pair"), "block", "fp")
    met = met.repartition("table_no", "key", "pair").sortWithinPartitions("table_no", "key", "pair")
    return met.mapInArrow(links_in_sorted(radius), "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = SHINGLE, group_limit: int = 1_000) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable.

    Null, empty and blank texts have fingerprint zero, which links like any other.
    Equal fingerprints always link.  A null id stays a row; the component of a
    group that has no id at all is null.  Repeated rows stay; other columns are
    not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    links = near_links(classes.select("fp"), radius, group_limit)
    joined = components(links)
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group; of several rows with that id one stays.

    Rows without an id cannot be told apart and all stay.
    """
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, radius)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("kept_id")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"))
    of_kept = whole.join(kept, F.col("own_id") == F.col("kept_id")).dropDuplicates(["own_id"]).select("row.*")
    return of_kept.unionByName(docs.where(F.col(id_col).isNull()))
