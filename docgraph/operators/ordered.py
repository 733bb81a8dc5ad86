"""Ordered scans over long groups.

A window over a whole document puts that document into one task.  Here every
scan works in two steps: inside bounded segments of the group, then over one
summary row per segment.  A document holding a third of all rows therefore
spreads over as many tasks as it has segments.  ``seg`` must grow with ``order``.

A null ``seg`` says that the group is a single segment: it has no summary, so groups
that are short enough for one cost one shuffle and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of stored input whose rows go to one task.
TASK_BYTES = 16 << 20


def _tasks(df: DataFrame) -> int:
    """Tasks that the size of the files of ``df`` asks for; a leaf of unknown size, as of local rows, asks for none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return -(-sum(size for size in sizes if size < 1 << 60) // TASK_BYTES)


def _session_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as the size of its files asks for.

    Sorts and aggregates over ``keys`` then hold a bounded part of the rows each, whatever the
    session's number of shuffle partitions; with fewer tasks than that, ``df`` is left alone.
    """
    tasks = _tasks(df)
    return df.repartition(tasks, *keys) if tasks > _session_tasks(df) else df


def dealt_wide(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """As ``dealt``, but never to fewer tasks than the session has: for rows of few bytes and much work.

    With ``of``, its files decide and not those of ``df``."""
    return df.repartition(max(_tasks(df if of is None else of), _session_tasks(df)), *keys)


def exploded(df: DataFrame, kept: list, items: Column | str, name: str) -> DataFrame:
    """``kept`` and a row per item of ``items`` that is not null, as ``name``.

    An inner explode makes Spark infer a filter on the size of the array, which it pushes
    below and whose array is computed once more there, at each level of nesting again.
    """
    return df.select(*kept, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def _windows(keys: list[str], seg: str, order: str, reverse: bool, inclusive: bool):
    by = F.desc(order) if reverse else F.asc(order)
    by_seg = F.desc(seg) if reverse else F.asc(seg)
    local = (
        Window.partitionBy(*keys, seg).orderBy(by)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    outer = Window.partitionBy(*keys).orderBy(by_seg).rowsBetween(Window.unboundedPreceding, -1)
    return local, outer


def carry_last(
    df: DataFrame,
    keys: list[str],
    seg: str,
    order: str,
    values: dict[str, Column],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    summarise: DataFrame | None = None,
) -> DataFrame:
    """Adds, per name, the last non-null value seen so far (from the end if reversed).

    ``summarise`` names an equal set of rows that is cheaper to compute than ``df``.
    """
    local, outer = _windows(keys, seg, order, reverse, inclusive)
    pick = F.min_by if reverse else F.max_by
    rows = df if summarise is None else summarise
    summary = rows.where(F.col(seg).isNotNull()).groupBy(*keys, seg).agg(
        *[pick(v, F.when(v.isNotNull(), F.col(order))).alias(f"_c_{n}") for n, v in values.items()]
    )
    summary = summary.select(
        *keys, seg, *[F.last(f"_c_{n}", ignorenulls=True).over(outer).alias(f"_c_{n}") for n in values]
    )
    scanned = df.select(
        "*", *[F.last(v, ignorenulls=True).over(local).alias(f"_l_{n}") for n, v in values.items()]
    )
    joined = scanned.join(summary, [*keys, seg], "left")
    keep = [c for c in df.columns if c not in values]
    return joined.select(
        *keep, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values]
    )


def running_sum(
    df: DataFrame, keys: list[str], seg: str, order: str, values: dict[str, Column],
    *, inclusive: bool = True,
) -> DataFrame:
    local, outer = _windows(keys, seg, order, False, inclusive)
    summary = df.where(F.col(seg).isNotNull()).groupBy(*keys, seg).agg(*[F.sum(v).alias(f"_c_{n}") for n, v in values.items()])
    summary = summary.select(
        *keys, seg, *[F.sum(f"_c_{n}").over(outer).alias(f"_c_{n}") for n in values]
    )
    scanned = df.select("*", *[F.sum(v).over(local).alias(f"_l_{n}") for n, v in values.items()])
    joined = scanned.join(summary, [*keys, seg], "left")
    keep = [c for c in df.columns if c not in values]
    total = lambda n: F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))
    return joined.select(*keep, *[total(n).alias(n) for n in values])


def row_index(df: DataFrame, keys: list[str], seg: str, order: str, name: str) -> DataFrame:
    """Adds the dense 0-based position of each row inside its group."""
    return running_sum(df, keys, seg, order, {name: F.lit(1)}, inclusive=False)


def first_per_key(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """Keep-first: one row per key, smallest ``by``.  Combines on the map side,
    so a key that holds a third of the rows costs no more than any other."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], by: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of every key.  Spark limits each partition before its shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
