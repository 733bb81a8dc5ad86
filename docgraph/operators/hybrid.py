"""Hybrid search without a fixed cut, and the chain of queries behind an answer.

The score is 0.7 times the cosine of hashed vectors plus 0.3 times the share of the
query's terms found.  Slabs of chunks meet blocks of query texts as matrices, and both parts
of the score are computed for all of their pairs at once: the cosines by one product, the
terms found by the postings of the slab.  No pair carries a text or a vector of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import retrieval
from docgraph.operators import vectors as V
from docgraph.operators.ordered import dealt_wide, top_per_key
from docgraph.session import written

SEMANTIC, KEYWORD = 0.7, 0.3
#: Scores are rounded to six digits before they are merged.
CLOSE = 2e-6
#: Characters of the texts in a slab or block.
PART_CHARS = 4 << 20
#: Tokens whose place in a vector a task remembers.
KNOWN_TOKENS = 1 << 20


def scored_pairs(pairs: DataFrame, chunks: DataFrame, texts: DataFrame, chunk_vectors: DataFrame, text_vectors: DataFrame) -> DataFrame:
    """semantic_score, keyword_score and score of given pairs (query_id, chunk_id)."""
    asked = text_vectors.select("query_id", F.col("vector").alias("q")).join(texts.select("query_id", X.terms(F.col("query_text")).alias("terms")), "query_id")
    held = chunk_vectors.select("chunk_id", "vector").join(chunks.select("chunk_id", "content"), "chunk_id")
    both = pairs.select("query_id", "chunk_id").join(asked, "query_id").join(held, "chunk_id")
    semantic = F.round(F.greatest(V.cosine(F.col("vector"), F.col("q")), F.lit(0.0)), 6)
    scored = both.select("query_id", "chunk_id", semantic.alias("semantic_score"), V.keyword_score(F.col("terms"), F.col("content")).alias("keyword_score"))
    return scored.withColumn("score", total(F.col("semantic_score"), F.col("keyword_score")))


def total(semantic: Column, keyword: Column) -> Column:
    return F.round(SEMANTIC * semantic + KEYWORD * keyword, 6)


def best_first() -> list[Column]:
    return [F.desc("score"), F.desc("semantic_score"), F.asc("chunk_id")]


def _round6(x: np.ndarray) -> np.ndarray:
    """``F.round(x, 6)``: half up of the shortest decimal that names the double."""
    scaled = x * 1e6
    whole = np.floor(scaled)
    out = (whole + (scaled - whole >= 0.5)) / 1e6
    near = np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-5)
    if len(near):
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for v in values])[at]
    return out


def _dense(dims: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signed counts as a matrix, and the norm of each row."""
    rows = np.repeat(np.arange(len(dims)), [len(d) for d in dims])
    out = np.zeros((len(dims), V.DIMENSION))
    if len(rows):
        out[rows, np.concatenate(dims).astype(int)] = np.concatenate(counts)
    return out, np.sqrt((out * out).sum(axis=1))


def _shared_terms(held: list[np.ndarray], asked: list[np.ndarray]) -> np.ndarray:
    """Number of terms that each row of ``held`` shares with each of ``asked``, term by term over their postings."""
    texts_of: dict[str, list[int]] = {}
    for j, terms in enumerate(asked):
        for term in terms:
            texts_of.setdefault(term, []).append(j)
    rows_of: dict[str, list[int]] = {}
    for i, terms in enumerate(held):
        for term in terms:
            if term in texts_of:
                rows_of.setdefault(term, []).append(i)
    out = np.zeros((len(held), len(asked)), dtype=np.int32)
    for term, rows in rows_of.items():
        out[np.ix_(rows, texts_of[term])] += 1
    return out


def _search(k: int):
    """The best ``k`` chunks of a slab for each text of a block, as of ``best_first``."""

    def run(corpus: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns: dict[str, list] = {"query_id": [], "chunk_id": [], "semantic_score": [], "keyword_score": [], "score": []}
        if len(corpus) and len(asked):
            corpus = corpus.sort_values("chunk_id")
            keys = corpus["chunk_id"].to_numpy(dtype=object)
            (rows, row_norms), (texts, text_norms) = (_dense(df["dims"].tolist(), df["counts"].tolist()) for df in (corpus, asked))
            dots, shared = rows @ texts.T, _shared_terms(corpus["terms"].tolist(), asked["terms"].tolist())
            for j, (query, terms) in enumerate(zip(asked["query_id"], asked["terms"])):
                norms = row_norms * text_norms[j]
                semantic = _round6(np.maximum(dots[:, j] / np.where(norms == 0, 1.0, norms), 0.0))
                keyword = shared[:, j] / max(len(terms), 1)
                raw = SEMANTIC * semantic + KEYWORD * keyword
                # Rounding may lift a score by half a millionth only.
                near = np.arange(len(raw)) if len(raw) <= k else np.flatnonzero(raw >= np.partition(raw, -k)[-k] - CLOSE)
                score = _round6(raw[near])
                picked = np.lexsort((near, -semantic[near], -score))[:k]
                near, score = near[picked], score[picked]
                for name, values in zip(columns, ([query] * len(near), keys[near], semantic[near], keyword[near], score)):
                    columns[name] += list(values)
        kinds = {"query_id": object, "chunk_id": object}
        return pd.DataFrame({name: pd.Series(values, dtype=kinds.get(name, float)) for name, values in columns.items()})

    return run


def _embedded(texts: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """key, terms, dims, counts: distinct terms and the components that are not zero."""
    parts = V.hash_parts(texts, key, text, model).select(key, F.col("parts.dim").alias("dims"), F.col("parts.v").alias("counts"))
    return texts.select(key, X.terms(F.col(text)).alias("terms")).join(parts, key, "left").select(
        key, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
        F.coalesce("dims", F.array().cast("array<int>")).alias("dims"), F.coalesce("counts", F.array().cast("array<double>")).alias("counts"),
    )


def _parts(df: DataFrame, text: str, most: int) -> int:
    """Parts of at most ``most`` rows and some ``PART_CHARS`` characters each, which enter Python as one batch."""
    rows, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return max(1, -(-rows // most), -(-chars // PART_CHARS))


def hybrid_top_k(
    chunks: DataFrame, texts: DataFrame, k: int, *, model: str = "m1", depth: int | None = None, scope: DataFrame | None = None,
    block: int = V.QUERY_BLOCK, slab: int = V.SLAB_ROWS,
) -> DataFrame:
    """The best ``k`` chunks of every query text by the full score, exactly; rows as of ``scored_pairs``, with ``rank``.

    ``chunks``: chunk_id, content, and document_id where there is a ``scope``.  ``texts``: query_id,
    query_text.  Texts are dealt into blocks and chunks into slabs, both tables; each pair of them
    scores all of its pairs at once and keeps the best ``k`` per text.  With ``scope`` (query_id,
    document_id) a text searches these documents alone, and every pair that it names is scored.
    ``depth`` is not needed any more: no list is cut.
    """
    rank = lambda df: top_per_key(df, ["query_id"], best_first(), k)
    if scope is not None:
        chunk_vectors = written(V.hash_vectors(chunks, "chunk_id", "content", model, unit=False))
        text_vectors = written(V.hash_vectors(texts, "query_id", "query_text", model, unit=False))
        pairs = scope.select("query_id", "document_id").distinct().join(chunks.select("chunk_id", "document_id"), "document_id")
        return rank(scored_pairs(pairs, chunks, texts, chunk_vectors, text_vectors))
    blocks, slabs = _parts(texts, "query_text", block), _parts(chunks, "content", slab)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    rows = _embedded(chunks, "chunk_id", "content", model).withColumn("_slab", dealt("chunk_id", slabs)).withColumn("_block", every(blocks))
    asked = _embedded(texts, "query_id", "query_text", model).withColumn("_block", dealt("query_id", blocks)).withColumn("_slab", every(slabs))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((texts, "query_id"), (chunks, "chunk_id"))]
    found = rows.groupBy("_slab", "_block").cogroup(asked.groupBy("_slab", "_block")).applyInPandas(
        _search(k), f"query_id {kinds[0]}, chunk_id {kinds[1]}, semantic_score double, keyword_score double, score double"
    )
    return rank(found)


def _cosines(model: str):
    """Cosines of the hashed vectors of each row's content and of its texts, all given as tokens."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}

        def vector(tokens: list[str]) -> np.ndarray:
            for token in tokens:
                if token not in known:
                    h = hashlib.sha256(f"{model}:{token}".encode()).hexdigest()
                    known[token] = int(h[:8], 16) % V.DIMENSION + (0 if int(h[8:10], 16) % 2 == 0 else V.DIMENSION)
            counts = np.bincount([known[token] for token in tokens] or [0], minlength=2 * V.DIMENSION) * (len(tokens) > 0)
            return (counts[: V.DIMENSION] - counts[V.DIMENSION :]).astype(float)

        for contents, texts in parts:
            if len(known) > KNOWN_TOKENS:
                known.clear()
            out = []
            for content, asked in zip(contents, texts):
                held, of = vector(content), [vector(tokens) for tokens in asked]
                norms = [np.sqrt((held * held).sum()) * np.sqrt((v * v).sum()) for v in of]
                out.append([float((held * v).sum() / (norm or 1.0)) for v, norm in zip(of, norms)])
            yield pd.Series(out, dtype=object)

    return run


def scoped_hits(chunks: DataFrame, questions: DataFrame, scope: DataFrame, model: str = "m1") -> DataFrame:
    """question_id, nth, chunk_id, semantic_score, keyword_score, score of every query text of a question and every chunk in its scope.

    A question and a chunk meet once, as their texts, whatever the number of query texts; vectors
    and terms are made in the row of the pair and no vector is shuffled or stored.
    """
    pairs = scope.select("question_id", "document_id").distinct().join(chunks.select("chunk_id", "document_id"), "document_id").select("question_id", "chunk_id")
    both = pairs.join(questions.select("question_id", "question", "document_count"), "question_id").join(dealt_wide(chunks.select("chunk_id", "content"), "chunk_id"), "chunk_id")
    tokens = lambda c: F.coalesce(F.regexp_extract_all(X.fold(c), F.lit(X.TERM_PATTERN), F.lit(0)), F.array().cast("array<string>"))
    texts = F.transform(retrieval.query_texts(F.col("question"), F.col("document_count")), tokens)
    both = both.select("question_id", "chunk_id", texts.alias("texts"), tokens(F.col("content")).alias("tokens"))
    found = both.withColumn("cosines", _cosines(model)("tokens", "texts"))
    held = F.array_distinct("tokens")
    shares = F.transform("texts", lambda x: F.size(F.array_intersect(F.array_distinct(x), held)) / F.greatest(F.size(F.array_distinct(x)), F.lit(1)))
    each = found.select("question_id", "chunk_id", F.posexplode(F.arrays_zip(F.col("cosines"), shares.alias("shares"))).alias("nth", "x"))
    semantic = F.round(F.greatest(F.col("x.cosines"), F.lit(0.0)), 6)
    scored = each.select("question_id", "nth", "chunk_id", semantic.alias("semantic_score"), F.col("x.shares").alias("keyword_score"))
    return scored.withColumn("score", total(F.col("semantic_score"), F.col("keyword_score")))


def retrieve(chunks: DataFrame, questions: DataFrame, *, one: int = 20, several: int = 40, scope: DataFrame | None = None, model: str = "m1") -> DataFrame:
    """The chunks of a question, found with all of its query texts.

    Each text keeps its best ``one`` chunks, or ``several`` where the question is put to more than
    one document; a chunk's best score counts, and the question keeps as many.
    ``questions``: question_id, question, document_count.  ``scope``: question_id, document_id.
    """
    limit = questions.select("question_id", F.when(F.col("document_count") > 1, several).otherwise(one).alias("limit"))
    if scope is not None:
        hits = scoped_hits(chunks, questions, scope, model).join(limit, "question_id")
        hits = top_per_key(hits, ["question_id", "nth"], best_first(), several).where(F.col("rank") <= F.col("limit"))
        return retrieval.merge_hits(hits.select("question_id", "chunk_id", "score"), limit)
    texts = retrieval.build_queries(questions).withColumn("query_id", F.concat_ws("#", "question_id", "nth"))
    texts = written(texts.select("query_id", "question_id", "query_text"))
    hits = hybrid_top_k(chunks, texts, several, model=model)
    hits = hits.join(texts.select("query_id", "question_id"), "query_id").join(limit, "question_id").where(F.col("rank") <= F.col("limit"))
    return retrieval.merge_hits(hits.select("question_id", "chunk_id", "score"), limit)


def answer(chunks: DataFrame, questions: DataFrame, *, scope: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """I16: status, confidence and citations of every question, from its own query texts to the conflicts of its sources.

    ``chunks`` has a ``topic`` too.  ``scores``: rerank scores, see ``retrieval.rerank``.
    """
    hits = written(retrieve(chunks, questions, scope=scope))
    asked = questions.withColumn("intent", X.question_intent(F.col("question"), F.col("document_count")))
    # Of a content only its values and whether there is any are needed below; no text goes with the hits.
    told = chunks.select(
        "chunk_id", "document_id", "topic", X.quantified_values(F.col("content")).alias("found_values"),
        F.substring(X.strip(F.col("content")), 1, 1).alias("content"),
    )
    items = written(retrieval.rerank(hits, chunks, asked, scores).join(told, "chunk_id"))
    return retrieval.answer_status(items, retrieval.conflicts(items, questions), questions)
