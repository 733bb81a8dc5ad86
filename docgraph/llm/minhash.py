"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star-shaped candidate edges.

One hash per shingle fills all bins of a signature: its high bits pick the bin, and
a bin keeps its smallest hash.  An empty bin copies the bin that its own sequence
of draws reaches first among the filled ones, so it agrees between two sets with
a probability of their similarity.  ``rows_per_band`` bins make a bucket key; with 32
bands of four bins two sets of similarity 0.8 share no bucket once in twenty
million pairs.

Texts of equal shingle sets are one class from the start.  A bucket asks only for
the pairs of a centre and its members, a star.  Centres are the members that meet
most others in all their buckets, so a text and its many edited copies form one
star.  Links are confirmed on the full sets.  A centre whose star is done leaves the
bucket, and a bucket is done when its members are one component.

What ``STAR_ROUNDS`` stars leave open gets an exact way, so that no bucket spells out
its pairs: the shingles of each set in ascending order of how many of the open sets hold
them.  Two sets that link must share a shingle so far ahead in both orders that enough
others can follow (a prefix filter), and sets with enough shingles of their own meet
nobody.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import mixed, stored, text_parts
from docgraph.llm.components import components

SHINGLE = 4
BANDS = 32
ROWS_PER_BAND = 4
#: Texts that become Python strings together.
BATCH_BYTES = 2_000_000
STAR_ROUNDS = 2
#: Members of a star that are compared with one copy of its centre.
STAR_PIECE = 512


def shingle_set(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    """Distinct runs of ``shingle`` words, A-Z lower-cased; all words as one if there are fewer; none without words."""
    words = text.encode().lower().split() if text else []
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    return {line[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())}


def draws(bins: np.ndarray, first: int, count: int, n_bins: int) -> np.ndarray:
    """Draws ``first`` to ``first + count`` of the sequence of each bin."""
    seeds = (bins.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(first, first + count, dtype=np.uint64)[None, :]
    return (mixed(seeds + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_bins)).astype(np.int64)


def signature(hashes: np.ndarray, n_bins: int) -> np.ndarray:
    """Smallest hash of each bin, empty bins filled by optimal densification."""
    h = np.sort(hashes)
    at = ((h >> np.uint64(32)) * np.uint64(n_bins) >> np.uint64(32)).astype(np.int64)  # in ascending order, as h is
    first = np.append(True, at[1:] != at[:-1])
    found = np.zeros(n_bins, np.uint64)
    filled = np.zeros(n_bins, bool)
    found[at[first]] = h[first]
    filled[at[first]] = True
    empty, tried, count = np.flatnonzero(~filled), 0, 8
    while len(empty):
        sources = draws(empty, tried, count, n_bins)
        hits = filled[sources]
        reached = hits.any(1)
        found[empty[reached]] = found[sources[reached, hits[reached].argmax(1)]]
        empty, tried, count = empty[~reached], tried + count, min(count * 2, 256)
    return found


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, made of its number and its bins."""
    parts = values.reshape(bands, -1)
    keys = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for column in parts.T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows_per_band: int) -> DataFrame:
    """Per row: ``id``, ``text_key`` and ``set_key`` (128 bits each), ``n`` shingles and its bucket keys."""

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in text_parts(batch, BATCH_BYTES):
                n, set_keys, keys = [], [], []
                for text in texts:
                    found = shingle_set(text, shingle)
                    n.append(len(found))
                    if found:
                        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), ">u8").astype(np.uint64)
                        keys.append(band_keys(signature(hashes, bands * rows_per_band), bands))
                        set_keys.append(xxhash.xxh3_128_digest(b"\n".join(sorted(found))))
                    else:
                        keys.append(None)
                        set_keys.append(None)
                yield pa.RecordBatch.from_pydict({
                    "id": ids, "text_key": batch["text_key"].slice(at, len(ids)), "n": pa.array(n, pa.int64()),
                    "set_key": pa.array(set_keys, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
                })
                at += len(ids)

    text = F.col(text_col)
    named = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))
    return named.mapInArrow(run, "id long, text_key binary, n long, set_key binary, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (centre, member) whose shingle sets have ``percent`` similarity or more.

    The members of a centre are dealt out in pieces of ``STAR_PIECE``, each with a copy of
    the centre's text; a task holds two texts at a time.
    """
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / STAR_PIECE).alias("pieces"))
    dealt = pairs.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("member"), F.col("pieces")).alias("piece"), "member")
    sides = dealt.select("centre", "piece", F.lit(1).alias("side"), F.col("member").alias("class"))
    sides = sides.unionByName(dealt.select("centre", "piece", F.lit(0).alias("side"), F.col("centre").alias("class")).distinct())
    rows = sides.join(texts, "class").repartition("centre", "piece").sortWithinPartitions("centre", "piece", "side")

    def run(batches):
        of = whole = None
        for batch in batches:
            at = 0
            heads = list(zip(*(batch[c].to_pylist() for c in ("centre", "piece", "side", "class"))))
            links = []
            for ids, parts in text_parts(pa.RecordBatch.from_pydict({"id": batch["class"], "text": batch["text"]}), BATCH_BYTES):
                for (centre, piece, side, member), text in zip(heads[at : at + len(ids)], parts):
                    found = shingle_set(text, shingle)
                    if side == 0:
                        of, whole = (centre, piece), found
                        continue
                    if of != (centre, piece):
                        raise ValueError("members came without their centre")
                    both = len(whole & found)
                    if 100 * both >= percent * (len(whole) + len(found) - both):
                        links.append((centre, member))
                at += len(ids)
            x, y = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return rows.select("centre", "piece", "side", "class", "text").mapInArrow(run, "x long, y long")


def class_roots(classes: DataFrame, docs: DataFrame, text_col: str, shingle: int, percent: int) -> DataFrame | None:
    """(node, root) of every class that links to another; None if there is no link."""
    entries = classes.select("class", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = entries.join(shared, "key")
    weight = met.groupBy("class").agg(F.sum("members").alias("weight"))
    open_ = stored(met.select("key", "class", "n").join(weight, "class").withColumn("root", F.col("class")), "near-entries")

    text = F.col(text_col)
    once = docs.where(text.isNotNull()).groupBy(F.unhex(F.md5(text)).alias("text_key")).agg(F.first(text).alias("text"))
    wanted = classes.join(weight, "class", "left_semi").select("text_key", "class")
    texts = stored(once.join(wanted, "text_key").select("class", "text"), "near-texts")

    roots = None

    def joined(links, open_):
        """Roots with new links, and the entries with the new roots."""
        known = links if roots is None else links.union(roots.select(F.col("node").alias("x"), F.col("root").alias("y")))
        found = stored(components(known), "near-roots")
        of = found.select(F.col("node").alias("class"), F.col("root").alias("new_root"))
        return found, open_.join(of, "class", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")

    for _ in range(STAR_ROUNDS):
        open_ = still_open(open_)
        first = F.min(F.struct((-F.col("weight")).alias("minus"), F.col("class"), F.col("n"), F.col("root"))).alias("c")
        centres = open_.groupBy("key").agg(first).select("key", F.col("c.class").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.root").alias("centre_root"))
        pairs = open_.join(centres, "key").where((F.col("root") != F.col("centre_root")) & may_link(F.col("n"), F.col("centre_n"), percent))
        pairs = stored(pairs.select("centre", F.col("class").alias("member")).distinct(), "near-pairs")
        links = stored(confirmed(pairs, texts, shingle, percent), "near-links")
        open_ = open_.join(centres.select("key", F.col("centre").alias("class")), ["key", "class"], "left_anti")
        if links.limit(1).count():
            roots, open_ = joined(links, open_)
        open_ = stored(open_, "near-entries")
    rest = stored(still_open(open_).select("class", "n", "root").distinct(), "near-rest")
    pairs = stored(prefix_pairs(rest, texts, shingle, percent), "near-pairs")
    links = stored(confirmed(pairs, texts, shingle, percent), "near-links")
    if links.limit(1).count():
        roots, _ = joined(links, open_)
    return roots


def still_open(entries: DataFrame) -> DataFrame:
    """The entries of buckets with more than one component."""
    spread = entries.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return entries.join(spread, "key")


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def prefix_pairs(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(centre, member): all pairs of classes of different roots that can link, by a prefix filter.

    ``rest``: class, n, root.  A set's shingles are ordered by the number of classes that hold
    them, then by hash.  If the first common shingle of two sets has the places i and j
    in them, they share n1 - i and n2 - j shingles at most.  Shingles that one class
    alone holds come first in its order and are counted, not shuffled.
    """

    def run(batches):
        for batch in batches:
            for ids, parts in text_parts(pa.RecordBatch.from_pydict({"id": batch["class"], "text": batch["text"]}), BATCH_BYTES):
                hashes = [np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, shingle_set(t, shingle))), ">i8").astype(np.int64) for t in parts]
                sizes = [len(h) for h in hashes]
                yield pa.RecordBatch.from_pydict({"class": pa.array(np.repeat(ids.to_numpy(), sizes), pa.int64()), "h": pa.array(np.concatenate(hashes), pa.int64())})

    held = stored(texts.join(rest, "class", "left_semi").select("class", "text").mapInArrow(run, "class long, h long"), "near-shingles")
    common = held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = held.join(common, "h").join(rest, "class")
    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "h"))
    own = F.col("n") - F.count("*").over(Window.partitionBy("class"))  # shingles of this class alone
    placed = shared.withColumn("place", own + rank - 1).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    placed = stored(placed.select("h", "class", "n", "root", "place"), "near-prefixes")
    # Only pairs of different roots are asked for; of a shingle's largest root, members meet those of the others only.
    by_root = placed.groupBy("h", "root").agg(F.count("*").alias("members"))
    major = by_root.groupBy("h").agg(F.max_by("root", F.struct("members", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1")
    many = placed.join(major.select("h", "major"), "h")
    left = many.where("root <> major").select("h", F.col("class").alias("a"), F.col("n").alias("n1"), F.col("root").alias("r1"), F.col("place").alias("i"))
    right = many.select("h", F.col("class").alias("b"), F.col("n").alias("n2"), F.col("root").alias("r2"), F.col("place").alias("j"))
    needed = F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent))
    fits = (F.col("r1") != F.col("r2")) & (F.col("n1") - F.col("i") >= needed) & (F.col("n2") - F.col("j") >= needed) & may_link(F.col("n1"), F.col("n2"), percent)
    return left.join(right, (left["h"] == right["h"]) & fits).select(F.least("a", "b").alias("centre"), F.greatest("a", "b").alias("member")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS_PER_BAND) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept``.

    Texts without words, null ones too, have no shingles and link with nothing.  Texts
    with equal sets always link.  A null id stays a row: it can be in a component but
    never names one, and is kept only if no row of its component has an id.
    Repeated rows stay, and are kept alike; rows of one id and different texts are judged one by
    one.  Other columns are not read.
    """
    rows = stored(described(docs, id_col, text_col, shingle, bands, rows_per_band), "near-rows")
    classes = rows.where("n > 0").groupBy("set_key").agg(
        F.min("id").alias("least"), F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.first("keys").alias("keys")
    )
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "near-classes")
    roots = class_roots(classes, docs, text_col, shingle, percent)
    named = classes.select("set_key", "least", "class")
    if roots is None:
        of_set = named.select("set_key", F.col("least").alias("component_id"))
    else:
        named = named.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
        of_set = named.join(smallest, "root").select("set_key", "component_id")
    found = rows.select("id", "n", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    found = found.select("id", "n", component.alias("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
