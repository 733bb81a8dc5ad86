"""Hooks for outside models (U3, U4) and named views for readers (U6).  No model is shipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.functions.text import unfence


def generate(df: DataFrame, prompt: str, provider: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """Adds the provider's answer to every prompt, ``batch`` prompts per call."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[str] = []
            for i in range(0, len(part), batch):
                out.extend(provider(part.iloc[i : i + batch].tolist()))
            yield pd.Series(out, dtype=object)

    return df.withColumn("answer", run(F.col(prompt)))


def structured(df: DataFrame, prompt: str, provider: Callable[[list[str]], list[str]], schema: str) -> DataFrame:
    """Answers parsed against ``schema``; an unusable answer parses to null."""
    return generate(df, prompt, provider).withColumn("parsed", F.from_json(unfence(F.col("answer")), schema))


def recognize(images: DataFrame, content: str, provider: Callable[[bytes], list[dict]]) -> DataFrame:
    """U4: OCR blocks of every image from a given provider, one row per block."""
    schema = "array<struct<order_index:int,text:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        for part in parts:
            yield part.map(lambda raw: json.dumps(provider(raw)))

    rest = [c for c in images.columns if c != content]
    found = F.explode(F.from_json(run(F.col(content)), schema)).alias("block")
    return images.select(*rest, found).select(*rest, "block.*")


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
