"""Mixing sources to target weights, with DataFrame functions only.

1. The words of every source are packed into blocks of ``block_words``.  A source is
   first dealt into parts of a few thousand documents, which are packed side by side.
2. Every output shard gets multinomial source counts, drawn given the totals of all
   shards: each slot of each shard draws a source without putting it back, by a
   pseudorandom permutation of all draws.  A source's total is its target, so the
   draws differ from shard to shard but never miss a target.
3. The slots of a source are numbered through all shards.  Slot j takes the block
   that a pseudorandom permutation of the source's block indexes, one for each pass
   over the source, puts at place j; slots and blocks meet by index.

One row for each source goes to the driver, as its weight does.  All else stays in tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import WORD, prefix_sums, stored

WEIGHTS = (5, 2, 1)
#: Documents meant for one part of a source.
PART_ROWS = 4_096
#: Slots meant for one task.
TASK_SLOTS = 65_536
ROUNDS = 6
#: Walks of a permutation that end outside the indexes less than once in 10^19.
WALKS = 16
KEY = ["id", "text_hash", "source"]
#: Equal rows that are numbered together.
COPIES = 65_536


def shared_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``most`` times its own size; the excess is shared again by weight."""
    targets, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        per_weight = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per_weight * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = per_weight * weights[i]
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def permuted(x: F.Column, n: F.Column, seed: int, *key) -> F.Column:
    """The image of index ``x`` under a permutation of 0 .. n - 1 that the key picks.

    A Feistel network over (x div b, x mod b) permutes 0 .. a * b - 1 with a * b
    barely above n; an image of n or more is permuted again.
    """
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def step(v, r):
        left, right = F.floor(v / b), v % b
        first = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), *key, r, right), a), a) * b + right
        second = left * b + F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), *key, r, left), b), b)
        return F.when(r % 2 == 0, first).otherwise(second)

    once = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), step)

    def walk(v, r):
        # Below 0: arrived, as -1 - image.
        return F.when(v < 0, v).when((r % ROUNDS == 0) & (v < n), -1 - v).otherwise(step(v, r % ROUNDS))

    again = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * WALKS)), x.cast("long"), lambda v, r: F.when((r == 0), step(v, r)).otherwise(walk(v, r)), lambda v: -1 - v)
    return F.when(once < n, once).otherwise(F.when(again >= 0, again).otherwise(F.raise_error(F.lit("a permutation did not end"))))


def numbered_copies(sized: DataFrame) -> DataFrame:
    """Adds ``nth``, which numbers rows of equal key and size from 1.

    Equal rows are counted, which combines on the map side, and written out again a
    bounded number at a time by many tasks, so a row that makes up a third of the
    table is no task of its own.
    """
    counted = sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))
    runs = counted.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(COPIES).cast("long")))).repartition(*KEY, "first")
    last = F.least(F.col("n"), F.col("first") + COPIES - 1)
    return runs.select(*sized.columns, F.explode(F.sequence(F.col("first"), last)).alias("nth"))


def whole_counts(expected: list[float], most: list[int]) -> list[int]:
    """Expected counts as whole numbers of the same rounded sum, none above ``most``: the largest remainders are rounded up."""
    down = [min(int(e), m) for e, m in zip(expected, most)]
    left = round(sum(expected)) - sum(down)
    for i in sorted(range(len(expected)), key=lambda i: (down[i] - expected[i], i)):
        if left > 0 and down[i] < most[i]:
            down[i] += 1
            left -= 1
    return down


@dataclass
class Mix:
    rows: DataFrame  # id, text_hash, source, nth, size, s, source_size, target, taken
    slots: DataFrame  # shard, s, pass, block
    segments: DataFrame  # id, text_hash, source, nth, s, block, first, words


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS,
    block_words: int = 64, shard_slots: int = 1_024, most: int = 3, seed: int = 17,
) -> Mix:
    """Which words of which documents the mix takes.

    Weights go to the sources in code-point order, null last, and repeat.  A null
    or empty text has size 0 and is never taken.  Rows of equal id, text and source
    are told apart by ``nth``.  An empty table gives empty results.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stored(numbered_copies(sized), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    spark = docs.sparkSession
    weight = [weights[i % len(weights)] for i in range(len(found))]
    targets = shared_targets([r["size"] for r in found], weight, most)
    listed = spark.createDataFrame(
        [(i, r["source"], r["size"], t, max(1, -(-r["n"] // PART_ROWS))) for i, (r, t) in enumerate(zip(found, targets))],
        "s int, name string, source_size long, target double, parts int",
    )
    rows = sized.join(listed, sized["source"].eqNullSafe(listed["name"])).drop("name")

    # Blocks: words [k * L, (k + 1) * L) of each part of a source.
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash", "nth"), F.col("parts")))
    before = Window.partitionBy("s", "part").orderBy(F.xxhash64(F.lit(seed + 1), "id", "text_hash", "nth"), *KEY, "nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored(rows.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0))), "packed")
    parts = rows.groupBy("s", "part").agg(F.ceil(F.sum("size") / block_words).alias("blocks"))
    parts = prefix_sums(parts, ["s"], "part", "blocks", "offset")
    used = rows.where("size > 0").join(parts.select("s", "part", "offset"), ["s", "part"])
    k = F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words))).alias("k")
    cut = used.select(*KEY, "nth", "s", "begin", "size", "offset", k)
    low = F.greatest(F.col("begin"), F.col("k") * block_words)
    high = F.least(F.col("begin") + F.col("size"), (F.col("k") + 1) * block_words)
    segments = cut.select(*KEY, "nth", "s", (F.col("offset") + F.col("k")).alias("block"), (low - F.col("begin")).alias("first"), (high - low).alias("words"))

    blocks = {r["s"]: int(r["n"] or 0) for r in parts.groupBy("s").agg(F.sum("blocks").alias("n")).collect()}
    live = [i for i, r in enumerate(found) if r["size"]]
    expected = [targets[i] * blocks[i] / found[i]["size"] for i in live]
    slots = draw_slots(spark, live, expected, [blocks[i] for i in live], shard_slots, most, seed)
    takes = slots.groupBy("s", "block").agg(F.count("*").alias("takes"))
    taken = segments.join(takes, ["s", "block"]).groupBy(*KEY, "nth").agg(F.sum(F.col("words") * F.col("takes")).alias("taken"))
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in [*KEY, "nth"]], F.col("taken").alias("_taken"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*KEY, "nth"]]
    rows = rows.join(taken, match, "left").select(*KEY, "nth", "size", "s", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(rows, slots, segments)


def draw_slots(spark, live: list[int], expected: list[float], blocks: list[int], shard_slots: int, most: int, seed: int) -> DataFrame:
    """Slots (shard, s, pass, block) of all shards.

    Draw d of all shards belongs to the source within whose total its image under a
    permutation of all draws falls; shard k makes the draws from k * shard_slots on.
    """
    totals = whole_counts(expected, [n * most for n in blocks])
    total = sum(totals)
    if not total:
        return spark.createDataFrame([], "shard long, s int, pass long, block long")
    tasks = max(1, -(-total // TASK_SLOTS))
    ends = F.array(*[F.lit(e).cast("long") for e in accumulate(totals)])
    draws = spark.range(0, total, 1, tasks).select(F.floor(F.col("id") / shard_slots).alias("shard"), permuted(F.col("id"), F.lit(total).cast("long"), seed + 2).alias("image"))
    # A transform of one element: the image is found once, not again for every source.
    place = F.transform(F.array("image"), lambda v: F.size(F.filter(ends, lambda e: e <= v)))[0]
    drawn = draws.select("shard", F.element_at(F.array(*map(F.lit, live)), place + 1).alias("s")).groupBy("shard", "s").agg(F.count("*").alias("count"))
    numbered = prefix_sums(drawn, ["s"], "shard", "count", "first")
    size = spark.createDataFrame(list(zip(live, blocks)), "s int, blocks long")
    numbered = numbered.join(size, "s")
    numbered = numbered.withColumn("end", F.col("first") + F.col("count"))
    # A few bytes stand for many slots: dealt out by number, as their size would put them all into one task.
    numbered = numbered.repartition(tasks, "shard", "s")
    j = numbered.select("shard", "s", "blocks", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("j"))
    j = j.select("shard", "s", "blocks", F.floor(F.col("j") / F.col("blocks")).alias("pass"), (F.col("j") % F.col("blocks")).alias("x"))
    return j.select("shard", "s", "pass", permuted(F.col("x"), F.col("blocks"), seed + 3, F.col("s"), F.col("pass")).alias("block"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as rows of the columns of ``docs``.

    A document has one row for each pass in which words of it are taken.  Where all
    are, the text is unchanged, else it is the taken words joined by one space.
    ``chars_col`` becomes the length of the new text.
    """
    mix = plan_mix(docs, id_col, text_col, source_col, **options)
    taken = mix.segments.join(mix.slots.groupBy("s", "block", "pass").count().drop("count"), ["s", "block"])
    copies = taken.groupBy(*KEY, "nth", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("cut"), F.sum("words").alias("n"))
    copies = copies.select(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.col("source").alias("of_source"), "cut", "n")
    # Rows that are equal in id, text and source share their copies.
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"))
    whole = whole.dropDuplicates(KEY)
    match = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")) & F.col("source").eqNullSafe(F.col("of_source"))
    text = F.col("row")[text_col]
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def chosen(w):
        some = F.transform("cut", lambda g: F.slice(w, (g["first"] + 1).cast("int"), g["words"].cast("int")))
        # Left unchanged if all words are taken.
        return F.when(F.size(w) == F.col("n"), text).otherwise(F.array_join(F.flatten(some), " "))

    # A transform of one element: the words are found once, not again for every cut.
    text_of_copy = F.transform(F.array(words), chosen)[0]
    out = whole.join(copies, match).withColumn("mixed", text_of_copy)
    columns = [F.col("mixed").alias(c) if c == text_col else F.length("mixed").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
