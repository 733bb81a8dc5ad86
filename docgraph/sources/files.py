"""File scans and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.session import shared_dir

SNAPSHOT_VERSION = 1


def object_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A1: stored bytes with an error code for empty objects."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.withColumn("error_code", F.when(F.col("length") == 0, "EMPTY_STORED_FILE"))


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """A2: documents of a folder without lock files; bytes are read only when asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
    return with_names(found).where(~F.startswith("name", F.lit("~$")))


def with_names(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def source_signature(files: DataFrame) -> DataFrame:
    """A3: one hash over (name, size, mtime) of all files.

    Per-file hashes are summed by bucket first, so no task sees all names; the
    bucket digests are hashed in order.
    """
    digest = F.sha2(F.to_json(F.struct("name", "length", "modified")), 256)
    buckets = files.select(F.substring(digest, 1, 2).alias("b"), digest.alias("d"))
    halves = [F.conv(F.substring("d", i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31, 46)]
    summed = buckets.groupBy("b").agg(*[F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)], F.count("*").alias("n"))
    line = F.concat_ws(":", "b", *[F.col(f"s{i}").cast("string") for i in range(4)], F.col("n").cast("string"))
    return summed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("signature"), F.sum("n").alias("files"))


def changed_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """A3: files whose (path, size, mtime) the index does not know."""
    return files.join(indexed, ["path", "length", "modificationTime"], "left_anti")


def save_snapshot(index: DataFrame, path: str, signature: str) -> None:
    """Data first, then the one-row table that makes it valid."""
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{path}/data")
    spark.range(1).select(F.lit(SNAPSHOT_VERSION).alias("version"), F.lit(signature).alias("signature")).write.mode(
        "overwrite"
    ).parquet(f"{path}/meta")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/meta").first()["version"]
    if version != SNAPSHOT_VERSION:
        raise ValueError(f"unsupported snapshot version {version}")
    return spark.read.parquet(f"{path}/data")


def rewrite_documents(derived: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions present in ``derived``; a rerun changes nothing."""
    derived.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
