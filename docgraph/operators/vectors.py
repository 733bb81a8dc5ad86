"""Vectors: hash embedding, exact top-k, hybrid scores, upsert and index jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.functions import text as X
from docgraph.operators.ordered import top_per_key

DIMENSION = 384
QUERY_BLOCK = 1024
SLAB_ROWS = 8192


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; a zero norm divides by one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    denominator = norm(a) * norm(b)
    return dot / F.when(denominator == 0, 1.0).otherwise(denominator)


def _hash_sums(texts: DataFrame, key: str, text: str, model: str, dimension: int) -> DataFrame:
    """Signed token counts per key and dimension.

    Texts are dealt out by key once; their tokens are then counted, hashed and summed where
    they are, so that no token is shuffled.
    """
    tokens = texts.select(key, text).repartition(key).select(key, F.explode(F.regexp_extract_all(X.fold(F.col(text)), F.lit(X.TERM_PATTERN), F.lit(0))).alias("token"))
    counted = tokens.groupBy(key, "token").agg(F.count("*").alias("n"))
    digest = F.sha2(F.concat(F.lit(f"{model}:"), "token"), 256)
    number = lambda a, b: F.conv(F.substring("h", a, b), 16, 10).cast("long")
    placed = counted.withColumn("h", digest).select(
        key, (number(1, 8) % dimension).alias("dim"),
        F.when(number(9, 2) % 2 == 0, F.col("n")).otherwise(-F.col("n")).alias("v"),
    )
    return placed.groupBy(key, "dim").agg(F.sum("v").cast("double").alias("v")).where("v <> 0")


def hash_parts(texts: DataFrame, key: str, text: str, model: str, dimension: int = DIMENSION) -> DataFrame:
    """The components of a key in one row: at most ``dimension`` of them, and their norm."""
    summed = _hash_sums(texts, key, text, model, dimension)
    return summed.groupBy(key).agg(
        F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), "v")).alias("parts"),
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"),
    )


def hash_components(texts: DataFrame, key: str, text: str, model: str, dimension: int = DIMENSION) -> DataFrame:
    """H14 as rows (key, dim, value), unit length per key."""
    parts = hash_parts(texts, key, text, model, dimension).select(key, "norm", F.explode("parts").alias("p"))
    return parts.select(key, F.col("p.dim").cast("long").alias("dim"), (F.col("p.v") / F.col("norm")).alias("value"))


def hash_vectors(texts: DataFrame, key: str, text: str, model: str, dimension: int = DIMENSION, *, unit: bool = True) -> DataFrame:
    """H14 as one dense array per key; a text without tokens gets zeros.  Without ``unit`` the signed counts are left as they are."""
    parts = hash_parts(texts, key, text, model, dimension)
    maps = parts.select(key, "norm", F.map_from_entries("parts").alias("m"))
    value = lambda i: F.coalesce(F.try_element_at("m", i) / (F.col("norm") if unit else 1), F.lit(0.0)).cast("float")
    return texts.select(key).join(maps, key, "left").select(
        key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value).alias("vector")
    )


def embed(texts: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """Vectors from a given provider, called once per ``batch`` texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[list[float]] = []
            for i in range(0, len(part), batch):
                out.extend(provider(part.iloc[i : i + batch].tolist()))
            yield pd.Series(out)

    return texts.withColumn("vector", run(F.col(text)))


def same_length_cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length."""
    return F.when(F.size(a) == F.size(b), cosine(a, b)).otherwise(0.0)


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    data = np.stack(vectors).astype(np.float64)
    norms = np.linalg.norm(data, axis=1)
    norms[norms == 0] = 1.0
    return data / norms[:, None]


def _scores(rows: list[np.ndarray], asked: list[np.ndarray]) -> np.ndarray:
    """max(0, cosine) of every row with every query; 0 where the lengths differ."""
    out = np.zeros((len(rows), len(asked)))
    sizes, wanted = np.array([len(v) for v in rows]), np.array([len(v) for v in asked])
    for size in np.unique(wanted):
        at, of = np.flatnonzero(sizes == size), np.flatnonzero(wanted == size)
        if len(at) and size:
            out[np.ix_(at, of)] = _unit([rows[i] for i in at]) @ _unit([asked[i] for i in of]).T
    return np.maximum(out, 0.0).round(9)


def _search(vector: str, key: str, k: int):
    """The best ``k`` of a slab of the corpus for each query of a block; of equal scores the smallest keys."""

    def run(corpus: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names, found, best = [], [], []
        if len(corpus) and len(asked):
            corpus = corpus.sort_values(key)
            scores, keys = _scores(corpus[vector].tolist(), asked["vector"].tolist()), corpus[key].to_numpy(dtype=object)
            for j, query in enumerate(asked["query_id"]):
                column = scores[:, j]
                picked = np.arange(len(column))
                if len(column) > k:
                    least = np.partition(column, -k)[-k]
                    above = np.flatnonzero(column > least)
                    picked = np.concatenate([above, np.flatnonzero(column == least)[: k - len(above)]])
                names += [query] * len(picked)
                found += keys[picked].tolist()
                best += column[picked].tolist()
        return pd.DataFrame({"query_id": pd.Series(names, dtype=object), key: pd.Series(found, dtype=object), "score": pd.Series(best, dtype=float)})

    return run


def top_k(
    corpus: DataFrame, queries: DataFrame, k: int, *, key: str = "chunk_id", vector: str = "vector", block: int = QUERY_BLOCK, slab: int = SLAB_ROWS
) -> DataFrame:
    """exact cosine top-k of every query, score max(0, cosine), 0 for unequal lengths.

    ``queries``: query_id, vector.  Queries are dealt into blocks and the corpus into
    slabs, both tables; every (slab, block) is one group, which keeps the best ``k``
    per query, so neither vectors nor pairs pass through the driver.
    """
    blocks = max(1, -(-queries.count() // block))
    slabs = max(1, -(-corpus.count() // slab))
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = corpus.select(key, vector).withColumn("_slab", F.pmod(F.xxhash64(key), F.lit(slabs))).withColumn("_block", every(blocks))
    asked = queries.select("query_id", F.col("vector")).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("_slab", every(slabs))
    found = rows.groupBy("_slab", "_block").cogroup(asked.groupBy("_slab", "_block")).applyInPandas(
        _search(vector, key, k), f"query_id {qkind}, {key} {kind}, score double"
    )
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc(key)], k)


def keyword_score(query_terms: Column, content: Column) -> Column:
    """G1: share of the query's terms found in the content."""
    return F.size(F.array_intersect(query_terms, X.terms(content))) / F.greatest(F.size(query_terms), F.lit(1))


def hybrid(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, *, key: str = "chunk_id", text: str = "normalized_content") -> DataFrame:
    """0.7 semantic plus 0.3 keyword over a list of candidates.

    ``hits`` holds the candidates of each query, from ``top_k``; their depth is the
    caller's parameter, ``overfetch(k)`` being the usual one.
    """
    asked = queries.select("query_id", X.terms(F.col("query_text")).alias("terms"))
    joined = hits.drop("rank").join(asked, "query_id").join(chunks.select(key, text), key)
    scored = joined.withColumn("keyword_score", keyword_score(F.col("terms"), F.col(text)))
    scored = scored.select(
        "query_id", key, F.col("score").alias("semantic_score"), "keyword_score",
        F.round(0.7 * F.col("score") + 0.3 * F.col("keyword_score"), 9).alias("score"),
    )
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.desc("semantic_score"), F.asc(key)], k)


def overfetch(k: int) -> int:
    return max(3 * k, 40)


RECORD_KEY = ["chunk_id", "embedding_model", "embedding_version"]


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], batch_order: str) -> DataFrame:
    """Rows of the batch replace equal keys; within it the last one wins."""
    from docgraph.operators.ordered import last_per_key

    old = existing.withColumn("_new", F.lit(0)).withColumn("_at", F.lit(None).cast("long"))
    new = batch.withColumn("_new", F.lit(1)).withColumn("_at", F.col(batch_order).cast("long"))
    both = old.unionByName(new.select(*[c for c in old.columns]))
    return last_per_key(both, keys, [F.col("_new"), F.col("_at")]).drop("_new", "_at")


def delete_documents(records: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: remaining records, and how many each document lost."""
    ids = deleted.select("document_id").distinct()
    gone = records.join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("deleted"))
    return records.join(ids, "document_id", "left_anti"), gone


def index_jobs(chunks: DataFrame, vectors: DataFrame, jobs: DataFrame, dimension: int) -> DataFrame:
    """One job row per document; a wrong or missing vector fails it."""
    last = jobs.groupBy("document_id").agg(F.max("attempt").alias("last"))
    good = vectors.select("chunk_id", (F.size("vector") == dimension).alias("good"))
    joined = chunks.select("document_id", "chunk_id", X.detect_language(F.col("content")).alias("language")).join(good, "chunk_id", "left")
    done = joined.groupBy("document_id").agg(
        F.count("*").alias("total_chunks"), F.count_if(F.coalesce("good", F.lit(False))).alias("indexed_chunks"),
        F.count_if(F.col("language") == "vi").alias("vietnamese_chunks"),
    )
    return done.join(last, "document_id", "left").select(
        "document_id", (F.coalesce("last", F.lit(0)) + 1).alias("attempt"), "total_chunks", "indexed_chunks", "vietnamese_chunks",
        F.when(F.col("indexed_chunks") == F.col("total_chunks"), "COMPLETED").otherwise("FAILED").alias("status"),
        (F.col("indexed_chunks") / F.col("total_chunks") * 100).alias("progress"),
    )
