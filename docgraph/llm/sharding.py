"""Sharding by extendible hashing, with DataFrame functions only.

A row's key is a 60-bit hash.  The directory is indexed by the first bits of the
hash; a bucket whose rows exceed the byte limit, and only such a bucket, is split on
the next bit.  Sizes are first added up by hash prefix, so the splitting works on
sums: many cells of the directory may point to one bucket, and cells that are
still too large get more bits in another round, over their own rows alone.
Rows that share one hash cannot be split by bits; they fill overflow pages.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docgraph.llm.common import prefix_sums, stored
from docgraph.session import shared_dir

BITS = 60


def key_hash(column) -> F.Column:
    """The first 60 bits of the MD5 of the key as text; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


#: Bytes of text that one task writes, about.
TASK_BYTES = 32 << 20


def buckets_of(rows: DataFrame, limit: int, begin: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Directory cells of ``end`` bits with the bucket each belongs to, and the cells that do not fit even so.

    A node of the tree of prefixes fits if its bytes do, or if it holds one hash only.
    """
    cells = rows.groupBy(F.shiftright("_hash", BITS - end).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("_hash").alias("low"), F.max("_hash").alias("high")
    )
    nodes = cells.withColumn("depth", F.explode(F.sequence(F.lit(begin), F.lit(end))))
    nodes = nodes.withColumn("prefix", F.expr(f"shiftright(cell, {end} - depth)"))
    sums = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    fit = sums.where((F.col("b") <= limit) | (F.col("low") == F.col("high"))).select("depth", "prefix", "b", "n")
    owner = nodes.select("cell", "depth", "prefix").join(fit, ["depth", "prefix"])
    owner = owner.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "b", "n")).alias("o"))
    directory = owner.select("cell", "o.depth", "o.prefix", F.col("o.b").alias("shard_bytes"), F.col("o.n").alias("shard_rows"))
    return directory, cells.join(directory, "cell", "left_anti").select("cell")


def places(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> tuple[DataFrame, int]:
    """Each row of ``docs`` as struct ``row``, with its id, ``bytes``, ``shard``, ``depth`` and ``page``; and the bytes of all.

    Only sizes and hashes go through the rounds; a row then meets the directory by
    its own hash, so repeated and null ids stay one row each.  ``docs`` is read
    again for this and must give the same rows each time.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), key_hash(F.col(id_col)).alias("_hash"))
    sizes = stored(rows.select("bytes", "_hash"), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    begin, end = 0, min(BITS, 4 + max(0, math.ceil(math.log2(max(1, total / shard_bytes)))))
    crowded = (F.col("shard_bytes") > shard_bytes) & (F.col("shard_rows") > 1)
    columns = ["row", "id", "bytes", "shard", F.col("depth").cast("int"), F.col("page").cast("long")]
    out = []
    while True:
        directory, open_cells = buckets_of(sizes, shard_bytes, begin, end)
        bits = F.substring(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), BITS, "0"), F.lit(BITS + 1) - F.col("depth"), F.col("depth"))
        directory = stored(directory.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(bits)).drop("prefix"), "directory")
        cell = F.shiftright("_hash", BITS - end)
        out.append(rows.join(directory.where(~crowded), cell == F.col("cell")).withColumn("page", F.lit(0)).select(*columns))
        full = directory.where(crowded)
        if not full.isEmpty():
            out.append(pages(rows.join(full, cell == F.col("cell")), shard_bytes).select(*columns))
        open_cells = stored(open_cells, "open-cells")
        if open_cells.isEmpty():
            break
        sizes = stored(sizes.join(open_cells, cell == F.col("cell"), "left_semi"), "open-sizes")
        begin, end = end + 1, min(BITS, end + 8)
    placed = out[0]
    for more in out[1:]:
        placed = placed.unionByName(more)
    return placed, total


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 20) -> DataFrame:
    """Per row: id, ``bytes`` of its text, ``shard`` (its hash bits), ``depth`` and ``page``.

    Every (shard, page) holds at most ``shard_bytes``, except where one row alone is
    larger.  ``page`` is above 0 only among rows of one hash (repeated or null ids).
    A null text has 0 bytes; an empty table gives no rows.
    """
    return places(docs, id_col, text_col, shard_bytes)[0].select(F.col("id").alias(id_col), "bytes", "shard", "depth", "page")


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash in pages: those above half a limit alone, the others by half limits of bytes before them."""
    half = max(1, limit // 2)
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "crowded")
    large = F.col("bytes") > half
    weighed = numbered.select("_row", "shard", "bytes", F.when(large, 0).otherwise(F.col("bytes")).alias("_small"), F.when(large, 1).otherwise(0).alias("_large"))
    weighed = prefix_sums(weighed, ["shard"], "_row", "_small", "_bytes_before")
    weighed = prefix_sums(weighed, ["shard"], "_row", "_large", "_large_before")
    small_page = F.floor(F.col("_bytes_before") / half)
    # Pages of large rows have odd numbers, the others even ones, so that neither depends on the other's count.
    page = F.when(large, 2 * F.col("_large_before") + 1).otherwise(2 * small_page)
    return numbered.join(weighed.select("_row", page.alias("page")), "_row")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 20) -> None:
    """Writes every row of ``docs``, with all its columns, into one folder per (shard, page).

    A folder is named by ``b`` and the hash bits, which no reader takes for a number.
    """
    placed, total = places(docs, id_col, text_col, shard_bytes)
    shard, page = folder_names(docs.schema)
    placed = placed.select("row.*", F.concat(F.lit("b"), "shard").alias(shard), F.col("page").alias(page))
    # As many tasks as the bytes need, so that no task grows with the table.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    placed.repartition(tasks, shard, page).write.partitionBy(shard, page).parquet(path)


def folder_names(schema: StructType) -> tuple[str, str]:
    """Names of the folder levels that no column of the table has."""
    taken = {f.name.lower() for f in schema}
    line = "_"
    while {f"{line}shard", f"{line}page"} & taken:
        line += "_"
    return f"{line}shard", f"{line}page"


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the given schema as ``write_shards`` wrote them, with ``shard`` (hash bits) and ``page`` of the folder each lies in, as struct ``row``."""
    names = [F.col(f"`{f.name}`") for f in schema]
    shard, page = folder_names(schema)
    found = spark.read.schema(StructType([*schema, StructField(shard, StringType()), StructField(page, LongType())])).parquet(path)
    return found.select(F.struct(*names).alias("row"), F.substring(shard, 2, BITS).alias("shard"), F.col(page).alias("page"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 20) -> DataFrame:
    """Writes the shards and gives, per row read back from them: id, ``bytes``, ``shard``, ``depth`` and ``page``."""
    path = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, id_col, text_col, shard_bytes)
    text = F.coalesce(F.octet_length(F.col("row")[text_col]), F.lit(0)).cast("long")
    back = read_shards(docs.sparkSession, path, docs.schema)
    return back.select(F.col("row")[id_col].alias(id_col), text.alias("bytes"), "shard", F.length("shard").cast("int").alias("depth"), "page")
