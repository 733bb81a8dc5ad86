"""Row filters whose parameters may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equals_all(df: DataFrame, filters: dict[str, object], allowed: tuple[str, ...]) -> DataFrame:
    """Equality on every given field; an empty value is no filter."""
    unknown = set(filters) - set(allowed)
    if unknown:
        raise ValueError(f"not a filter: {sorted(unknown)}")
    for name, value in filters.items():
        if isinstance(value, (list, tuple)):
            df = df.where(F.col(name).isin(*value)) if value else df
        elif value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def active(df: DataFrame) -> DataFrame:
    """B1."""
    return df.where("deleted_at is null and not is_deleted")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of the ordered rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def contains_needle(df: DataFrame, fields: tuple[str, ...], needle: str) -> DataFrame:
    """Any of the fields holds the needle, letter case aside."""
    hit = F.lit(False)
    for name in fields:
        hit = hit | F.coalesce(F.lower(name).contains(needle.lower()), F.lit(False))
    return df.where(hit)
