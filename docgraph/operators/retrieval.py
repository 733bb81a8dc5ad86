"""Lexical search, reranking, conflicts and answer status for a table of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.functions import text as X
from docgraph.operators import lexical
from docgraph.operators.lexical import PHRASE_BONUS, query_tokens, token_frequencies
from docgraph.operators.ordered import dealt_wide, top_per_key
from docgraph.operators.vectors import keyword_score
from docgraph.session import cut_lineage

ON_FAILURE = 0.7


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    """D6."""
    return frequencies.groupBy("token").agg(F.count("*").alias("df"))


def lexical_scores(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question and chunk that share a token, with their score; for the best chunks see ``lexical``.

    The chunk norm runs over the question's tokens only.  Postings are dealt out by chunk and
    meet the weights of the question tokens there, so a frequent token is spread over all
    tasks and the pairs of a chunk are summed where they arise.
    """
    asked = query_tokens(questions)
    # Written once: document frequencies and pair scores both read the postings.
    tf = cut_lineage(token_frequencies(chunks, asked))
    total = chunks.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    df = document_frequencies(tf)
    # Written, so that their size is known when the joins below are planned; so are the other small tables.
    weights = cut_lineage(asked.join(df, "token", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(
        "question_id", "token", "n",
        (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"),
    ))
    norms = cut_lineage(weights.groupBy("question_id").agg(
        F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), 2))).alias("query_norm"), F.count("*").alias("query_terms")
    ))
    w = F.col("tf") * F.col("idf")
    pairs = dealt_wide(tf, "chunk_id", of=chunks).join(weights, "token").groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("n") * F.col("idf") * w).alias("dot"), F.sqrt(F.sum(w * w)).alias("chunk_norm"), F.count("*").alias("shared")
    )
    scored = cut_lineage(pairs.join(norms, "question_id").select(
        "question_id", "chunk_id", (F.col("dot") / (F.col("query_norm") * F.col("chunk_norm"))).alias("cosine"),
        (F.col("shared") == F.col("query_terms")).alias("full"),
    ))
    # The whole phrase can only occur where every one of its tokens does; only these few contents are read again.
    joined = lambda c: F.array_join(X.tokens(F.col(c)), " ")
    full = cut_lineage(scored.where("full").select("question_id", "chunk_id"))
    phrased = cut_lineage(
        full.join(questions.select("question_id", joined("question").alias("phrase")), "question_id")
        .join(chunks.select("chunk_id", "content"), "chunk_id")
        .where(joined("content").contains(F.col("phrase")))
        .select("question_id", "chunk_id", F.lit(PHRASE_BONUS).alias("bonus"))
    )
    score = F.col("cosine") + F.coalesce("bonus", F.lit(0.0))
    return scored.join(phrased, ["question_id", "chunk_id"], "left").select(
        "question_id", "chunk_id", F.round(score, 9).alias("score")
    )


def lexical_top_k(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """best ``k`` chunks by a pruned search of an index of the questions' tokens; where fewer share a token
    the first other chunks follow with score 0.  ``chunks``: chunk_id, document_id, order_index, content."""
    return lexical.top_k(lexical.build_index(chunks, query_tokens(questions)), questions, k)


def scoped_top_k(chunks: DataFrame, questions: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks of each question among the documents it may read.

    ``scope``: question_id, document_id, the documents that the asker sees.  Document
    frequencies, like scores, count the chunks of a question's own scope, so nothing
    is learnt from other tenants.  Chunks that share no token follow with score 0; a
    question without any visible chunk has no row.
    """
    asked = query_tokens(questions)
    place = chunks.select("chunk_id", "document_id", "order_index")
    seen = cut_lineage(scope.select("question_id", "document_id").distinct().join(place, "document_id"))
    totals = seen.groupBy("question_id").agg(F.count("*").alias("total"))
    tf = token_frequencies(chunks, asked)
    own = cut_lineage(seen.select("question_id", "chunk_id").join(tf, "chunk_id").join(asked, ["question_id", "token"]))
    df = own.groupBy("question_id", "token").agg(F.count("*").alias("df"))
    weights = asked.join(totals, "question_id").join(df, ["question_id", "token"], "left").select(
        "question_id", "token", (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"), "n"
    )
    norms = weights.groupBy("question_id").agg(F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), 2))).alias("query_norm"), F.count("*").alias("query_terms"))
    w = F.col("tf") * F.col("idf")
    pairs = own.join(weights.drop("n"), ["question_id", "token"]).groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("n") * F.col("idf") * w).alias("dot"), F.sqrt(F.sum(w * w)).alias("chunk_norm"), F.count("*").alias("shared")
    )
    scored = pairs.join(norms, "question_id")
    joined = lambda c: F.array_join(X.tokens(F.col(c)), " ")
    full = scored.where("shared = query_terms").select("question_id", "chunk_id")
    phrased = full.join(questions.select("question_id", joined("question").alias("phrase")), "question_id")
    phrased = phrased.join(chunks.select("chunk_id", joined("content").alias("body")), "chunk_id").where(F.col("body").contains(F.col("phrase")))
    phrased = phrased.select("question_id", "chunk_id", F.lit(PHRASE_BONUS).alias("bonus"))
    score = F.col("dot") / (F.col("query_norm") * F.col("chunk_norm")) + F.coalesce("bonus", F.lit(0.0))
    scored = scored.join(phrased, ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", F.round(score, 9).alias("score"))
    ranked = seen.join(scored, ["question_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top_per_key(ranked, ["question_id"], [F.desc("score"), F.asc("document_id"), F.asc("order_index")], k)


def with_quotes(hits: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Text work on the selected hits only."""
    texts = chunks.select("chunk_id", "content")
    asked = questions.select("question_id", X.tokens(F.col("question")).alias("q"))
    return hits.join(texts, "chunk_id").join(asked, "question_id").withColumn(
        "quote", X.best_quote(F.col("content"), F.col("q"))
    ).drop("content", "q")


def keyword_overlaps(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """G1: of every question and chunk that share a term, the share of the question's terms found.

    Distinct terms meet in an equi join and are counted where their chunk is dealt; only
    terms that a question has leave the chunks.  Pairs without a common term score 0 and are left out.
    """
    asked = cut_lineage(questions.select("question_id", F.explode(X.terms(F.col("question"))).alias("term")))
    sizes = asked.groupBy("question_id").agg(F.count("*").alias("terms"))
    held = chunks.select("chunk_id", F.explode(X.terms(F.col("content"))).alias("term"))
    held = held.join(asked.select("term").distinct(), "term", "left_semi")
    shared = dealt_wide(held, "chunk_id").join(asked, "term").groupBy("question_id", "chunk_id").agg(F.count("*").alias("shared"))
    return shared.join(sizes, "question_id").select("question_id", "chunk_id", (F.col("shared") / F.col("terms")).alias("score"))


def query_texts(question: Column, document_count: Column) -> Column:
    """The query texts of a question as an array, its own first."""
    low, intent = X.fold(question), X.question_intent(question, document_count)
    timed = low.contains("thời hạn") | low.contains("deadline")
    paid = low.contains("kinh phí") | low.contains("ngân sách")
    return F.array_compact(
        F.array(
            question,
            F.when(timed, F.concat(question, F.lit(" số ngày thời điểm bắt đầu kết thúc"))),
            F.when(paid, F.concat(question, F.lit(" tổng mức vốn nguồn vốn đơn vị tiền"))),
            F.when(intent == "COMPREHENSIVE", F.concat(F.lit("quy định trách nhiệm và căn cứ liên quan "), question)),
        )
    )


def build_queries(questions: DataFrame) -> DataFrame:
    """The query texts of a question, its own first.  ``questions``: question_id,
    question, document_count."""
    q, count = F.col("question"), F.col("document_count")
    return questions.select(
        "question_id", X.question_intent(q, count).alias("intent"), F.posexplode(query_texts(q, count)).alias("nth", "query_text")
    )


def merge_hits(hits: DataFrame, limit: DataFrame | int) -> DataFrame:
    """F8: best score of a chunk over a question's queries; ``limit`` per question (question_id, limit) or for all."""
    best = hits.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")))
    if isinstance(limit, int):
        return ranked.where(F.col("rank") <= limit)
    return ranked.join(limit, "question_id").where(F.col("rank") <= F.col("limit")).drop("limit")


def rerank(
    hits: DataFrame, chunks: DataFrame, questions: DataFrame, scores: DataFrame | None = None, *, wide: int = 15, narrow: int = 8
) -> DataFrame:
    """keeps ``wide`` (comprehensive) or ``narrow`` hits by rerank score, clamped to [0, 1].

    ``scores`` (question_id, chunk_id, rerank_score) come from a provider; a
    question with a missing score falls back to vector order.  Without a
    provider the keyword overlap is the score.
    """
    joined = hits.join(questions.select("question_id", "question", "intent"), "question_id")
    if scores is None:
        joined = joined.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn(
            "rerank_score", keyword_score(X.terms(F.col("question")), F.col("content"))
        ).drop("content")
    else:
        joined = joined.join(scores, ["question_id", "chunk_id"], "left")
    complete = joined.groupBy("question_id").agg((F.count("*") == F.count("rerank_score")).alias("available"))
    joined = joined.join(complete, "question_id")
    score = F.when(F.col("available"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rerank_score")))).otherwise(F.col("score"))
    joined = joined.withColumn("rerank_score", F.round(score, 9)).drop("rank", "question")
    kept = top_per_key(joined, ["question_id"], [F.desc("rerank_score"), F.desc("score"), F.asc("chunk_id")], wide)
    return kept.where((F.col("intent") == "COMPREHENSIVE") | (F.col("rank") <= narrow))


def provider_scores(pairs: DataFrame, provider: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Scores of (question, content) pairs from a given provider, in Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, content in parts:
            yield pd.Series(provider(asked.tolist(), content.tolist()), dtype=float)

    return pairs.withColumn("rerank_score", run("question", "content"))


def conflicts(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Topics for which the kept chunks of several documents name different values.

    ``items``: question_id, document_id, chunk_id, topic, content (at most 15 per question); with ``found_values``
    (``quantified_values`` of the content) the content is not read.
    """
    named = F.col("found_values") if "found_values" in items.columns else X.quantified_values(F.col("content"))
    wide = items.groupBy("question_id").agg(F.count_distinct("document_id").alias("docs")).where("docs > 1")
    asked = questions.where(~X.fold(F.col("question")).contains("so sánh")).select("question_id")
    listed = items.join(wide.select("question_id"), "question_id", "left_semi").join(asked, "question_id", "left_semi")
    values = listed.select(
        "question_id", X.fold(F.coalesce("topic", F.lit("Nội dung liên quan"))).alias("topic"), "chunk_id",
        F.explode(named).alias("value"),
    )
    return values.groupBy("question_id", "topic").agg(
        F.array_sort(F.collect_set("value")).alias("values"), F.count_distinct("chunk_id").alias("chunks")
    ).where("size(values) > 1")


def answer_status(items: DataFrame, found: DataFrame, questions: DataFrame, *, first: int = 5) -> DataFrame:
    """I16: confidence (from the ``first`` ones) and status of every question from its kept hits.

    ``items``: question_id, rank, rerank_score, available, content.
    """
    cited = F.count_if(X.strip(F.substring(X.strip(F.col("content")), 1, 300)) != "")
    mean = F.avg(F.when(F.col("rank") <= first, F.col("rerank_score")))
    per = items.groupBy("question_id").agg(
        cited.alias("citations"), mean.alias("mean"), F.bool_and("available").alias("available")
    )
    clash = found.select("question_id").distinct().withColumn("conflict", F.lit(True))
    joined = questions.select("question_id").join(per, "question_id", "left").join(clash, "question_id", "left")
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean"))) * F.when(F.col("available"), 1.0).otherwise(ON_FAILURE)
    base = F.when(F.col("available"), base).otherwise(F.least(base, F.lit(0.69)))
    bare = F.col("citations") == 0
    confidence = F.when(F.col("mean").isNull(), 0.0).when(bare, F.least(base, F.lit(0.35))).otherwise(base)
    status = (
        F.when(F.col("mean").isNull(), "NOT_FOUND").when(bare, "LOW_CONFIDENCE_SOURCE")
        .when(F.col("conflict"), "CONFLICTING").when(confidence < 0.5, "LOW_CONFIDENCE_SOURCE")
        .when(F.col("available"), "SUPPORTED").otherwise("PARTIALLY_SUPPORTED")
    )
    return joined.select(
        "question_id", status.alias("answer_status"), F.round(confidence, 4).alias("confidence"),
        F.coalesce("citations", F.lit(0)).alias("citations"),
    )


def answer_events(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Metadata, tokens of eight words, citations and done, in order.

    ``answers``: answer_id, answer, answer_status, confidence.  ``citations``: answer_id, nth, payload.
    """
    words = F.filter(F.split(X.strip(F.col("answer")), r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(8)))
    piece = lambda i: F.concat(F.array_join(F.slice(words, i + 1, F.lit(8)), " "), F.lit(" "))
    event = lambda stage, nth, kind, data: [
        "answer_id", F.lit(stage).alias("stage"), nth.alias("nth"), F.lit(kind).alias("event"), data.alias("data")
    ]
    zero = F.lit(0)
    head = answers.select(*event(0, zero, "metadata", F.to_json(F.struct("answer_status", "confidence"))))
    body = answers.select("answer_id", F.posexplode(F.transform(starts, piece)).alias("i", "piece")).select(
        *event(1, F.col("i"), "token", F.col("piece"))
    )
    cited = citations.select(*event(2, F.col("nth").cast("int"), "citation", F.col("payload")))
    done = answers.select(*event(3, zero, "done", F.col("answer")))
    return head.unionByName(body).unionByName(cited).unionByName(done)


def selected_sources(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Results an answer cites by number; all of them if it cites none."""
    size = results.groupBy("answer_id").agg(F.max("number").alias("top"))
    used = answers.join(size, "answer_id").withColumn("used", F.filter(X.cited_numbers(F.col("answer")), lambda n: n.between(1, F.col("top"))))
    return results.join(used.select("answer_id", "used"), "answer_id").where(
        (F.size("used") == 0) | F.array_contains("used", F.col("number"))
    ).drop("used")
