"""Access to the Parquet tables of one scale factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgraph.session import cut_lineage

TEXT_TABLES = ("documents", "pages", "conversations")


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._stored: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df

    def stored(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """``build(self)`` written once and read by every later use of this object."""
        if name not in self._stored:
            self._stored[name] = cut_lineage(build(self))
        return self._stored[name]


#: Tables up to this size are dealt out to all cores when they come in few files.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table of few files out to all cores.

    Text work is heavy per byte, and a table of one or two files feeds as many
    tasks.  The scan's size in bytes bounds what is shuffled for this; the files of
    a larger table are split by the scan and left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df
