"""Lexical search over an inverted index in blocks, pruned by the k-th score found so far.

A chunk's score for a question is the cosine of both over the question's tokens.  By
Cauchy-Schwarz it is at most the root of the share that the tokens found in the chunk
have in the question's squared weight.  The tokens of a question are ordered by weight;
a chunk whose first token found is t can reach no more than what t and the tokens
after it come to.  So a first wave scores the chunks of the heaviest tokens, and the
second one looks only at tokens whose bound reaches the k-th score of the first.  A word
that is in every chunk has little weight and is not followed.

Postings lie in blocks: a token and a run of chunks in the order in which ties are
broken.  A block at or below the k-th score whose first chunk comes after the k-th one
is left out whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators.ordered import top_per_key
from docgraph.session import written

PHRASE_BONUS = 0.15
#: Share of the k-th score down to which tokens are followed, to tell chunks apart before they are scored.
FOLLOW = 0.6
#: Scores are rounded to nine digits.
CLOSE = 2e-9
#: Consecutive chunks whose postings of a token make one block.
BLOCK = 128


@dataclass
class LexicalIndex:
    """Tables of an index; each is written once."""

    chunks: DataFrame  # chunk_id, document_id, order_index, content
    place: DataFrame  # chunk_id, document_id, order_index, block
    postings: DataFrame  # chunk_id, token, tf
    blocks: DataFrame  # token, block, at (document_id, order_index of the first chunk), postings (chunk_id, tf), before
    frequencies: DataFrame  # token, df
    total: int


def query_tokens(questions: DataFrame) -> DataFrame:
    """Rows (question_id, token, n) of the questions."""
    listed = questions.select("question_id", F.explode(X.tokens(F.col("question"))).alias("token"))
    return listed.groupBy("question_id", "token").agg(F.count("*").alias("n"))


def token_frequencies(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (chunk_id, token, tf), of the wanted tokens if some are given."""
    listed = chunks.select("chunk_id", F.explode(X.tokens(F.col("content"))).alias("token"))
    if wanted is not None:
        listed = listed.join(wanted.select("token").distinct(), "token", "left_semi")
    return listed.groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))


def build_index(chunks: DataFrame, wanted: DataFrame | None = None, block: int = BLOCK) -> LexicalIndex:
    """Index of all tokens, or of the ``wanted`` ones (column token).

    Chunks are numbered in ranges of (document_id, order_index), so no task sees all of
    them, and neither does any the postings of a frequent token.
    """
    place = chunks.select("chunk_id", "document_id", "order_index").repartitionByRange("document_id", "order_index")
    place = place.withColumn("_range", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("document_id", "order_index", "chunk_id")) - 1
    number = F.shiftleft(F.col("_range").cast("long"), 32) + F.floor(nth / block)
    place = written(place.withColumn("block", number).drop("_range"))
    postings = written(token_frequencies(chunks, wanted))
    at = F.min(F.struct("document_id", "order_index")).alias("at")
    blocks = postings.join(place, "chunk_id").groupBy("token", "block").agg(at, F.collect_list(F.struct("chunk_id", "tf")).alias("postings"))
    earlier = Window.partitionBy("token").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.withColumn("before", F.coalesce(F.sum(F.size("postings")).over(earlier), F.lit(0))))
    frequencies = blocks.groupBy("token").agg(F.sum(F.size("postings")).alias("df"))
    return LexicalIndex(chunks, place, postings, blocks, frequencies, place.count())


def question_terms(index: LexicalIndex, questions: DataFrame) -> DataFrame:
    """Per question and token: weights, the bound of a chunk that has this token but none before it, and the postings before it."""
    asked = query_tokens(questions).join(index.frequencies, "token", "left")
    idf = F.log(F.lit(1 + index.total) / (1 + F.coalesce("df", F.lit(0)))) + 1.0
    asked = asked.withColumn("idf", idf).withColumn("w2", F.pow(F.col("n") * F.col("idf"), 2))
    order = Window.partitionBy("question_id").orderBy(F.desc("w2"), "token")
    rest = F.sum("w2").over(order.rowsBetween(0, Window.unboundedFollowing))
    all_of = Window.partitionBy("question_id")
    norm = F.sqrt(F.sum("w2").over(all_of))
    # Only a chunk with all tokens can hold the whole phrase, and its first one is the first.
    bound = F.sqrt(rest) / norm + F.when(F.row_number().over(order) == 1, PHRASE_BONUS).otherwise(0.0)
    df = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return asked.select(
        "question_id", "token", "n", "idf", "w2", norm.alias("query_norm"), F.count("*").over(all_of).alias("query_terms"),
        F.round(bound, 9).alias("bound"), df.alias("df_before"),
    )


def exact_scores(index: LexicalIndex, questions: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of the given pairs (question_id, chunk_id) that share a token."""
    w = F.col("tf") * F.col("idf")
    of = terms.select("question_id", "token", "n", "idf", "query_norm", "query_terms")
    summed = pairs.join(index.postings, "chunk_id").join(of, ["question_id", "token"]).groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("n") * F.col("idf") * w).alias("dot"), F.sqrt(F.sum(w * w)).alias("chunk_norm"), F.count("*").alias("shared"),
        F.first("query_norm").alias("query_norm"), F.first("query_terms").alias("query_terms"),
    )
    full = summed.where("shared = query_terms").select("question_id", "chunk_id")
    joined = lambda c: F.array_join(X.tokens(F.col(c)), " ")
    phrased = (
        full.join(questions.select("question_id", joined("question").alias("phrase")), "question_id")
        .join(index.chunks.select("chunk_id", "content"), "chunk_id").withColumn("body", joined("content"))
        .where(F.col("body").contains(F.col("phrase"))).select("question_id", "chunk_id", F.lit(PHRASE_BONUS).alias("bonus"))
    )
    score = F.col("dot") / (F.col("query_norm") * F.col("chunk_norm")) + F.coalesce("bonus", F.lit(0.0))
    return summed.join(phrased, ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", F.round(score, 9).alias("score"))


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("document_id"), F.asc("order_index"), F.asc("chunk_id")]


def search(index: LexicalIndex, questions: DataFrame, k: int, first_wave: int | None = None) -> DataFrame:
    """The best ``k`` chunks that share a token with a question, exactly; of equal scores the first ones.

    ``first_wave``: postings per question that are scored before anything is pruned; a
    question that has found fewer than ``k`` chunks gets a larger first wave, and then all it has.
    """
    ranks = lambda df: top_per_key(df.join(index.place.drop("block"), "chunk_id"), ["question_id"], best_first(), k)
    terms = written(question_terms(index, questions))
    blocks = index.blocks
    wave = first_wave or max(4 * k, 64)
    best = None
    for size in (wave, 64 * wave):
        asked = terms if best is None else terms.join(best.groupBy("question_id").agg(F.count("*").alias("got")), "question_id", "left").where(F.coalesce("got", F.lit(0)) < k)
        opened = asked.where(F.col("df_before") < size).select("question_id", "token").join(blocks.where(F.col("before") < size), "token")
        pairs = opened.select("question_id", F.explode("postings.chunk_id").alias("chunk_id")).distinct()
        found = exact_scores(index, questions, terms, pairs)
        if best is not None:
            found = found.unionByName(best.select("question_id", "chunk_id", "score")).distinct()
        best = written(ranks(found))
        full = best.where(F.col("rank") == k).select("question_id", F.col("score").alias("kth"), F.struct("document_id", "order_index").alias("kth_at"))
        if not terms.select("question_id").distinct().join(full, "question_id", "left_anti").limit(1).count():
            break
    # Tokens are followed until the rest could bring a chunk to a part of the k-th score only.
    reach = terms.join(full, "question_id", "left")
    kth = F.coalesce("kth", F.lit(0.0))
    tie = F.abs(F.col("bound") - kth) <= CLOSE
    reach = reach.withColumn("followed", F.col("bound") >= kth * FOLLOW).withColumn("tie", tie & F.col("kth").isNotNull())
    of_question = Window.partitionBy("question_id")
    unknown = F.sum(F.when(~F.col("followed") | F.col("tie"), F.col("w2")).otherwise(0.0)).over(of_question)
    reach = reach.withColumns({"others": unknown, "n_followed": F.count_if(F.col("followed") & ~F.col("tie")).over(of_question)}).where("followed")
    # Of a token that can only tie, a block after the k-th chunk is left out.
    opened = reach.join(index.blocks, "token").where(~F.col("tie") | (F.col("at") <= F.col("kth_at")))
    met = opened.select("question_id", "token", "n", "idf", "others", "n_followed", "query_norm", kth.alias("kth"), F.explode("postings").alias("p"))
    one = lambda c: F.first(c).alias(c)
    w = F.col("p.tf") * F.col("idf")
    met = met.groupBy("question_id", F.col("p.chunk_id").alias("chunk_id")).agg(
        F.sum(F.col("n") * F.col("idf") * w).alias("dot"), F.sum(w * w).alias("own2"), F.count("*").alias("shared"),
        one("others"), one("n_followed"), one("query_norm"), one("kth"),
    )
    # The best direction that the other tokens could give; the bonus needs all tokens.
    bonus = F.when(F.col("shared") >= F.col("n_followed"), PHRASE_BONUS).otherwise(0.0)
    most = F.round(F.sqrt(F.col("dot") * F.col("dot") / F.col("own2") + F.col("others")) / F.col("query_norm") + bonus, 9)
    met = met.select("question_id", "chunk_id", most.alias("most"), "kth").where(F.col("most") >= F.col("kth") - CLOSE)
    met = written(met.join(best.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti"))
    # The most promising chunks raise the k-th score for the rest.
    promising = top_per_key(met, ["question_id"], [F.desc("most"), F.asc("chunk_id")], 4 * k).select("question_id", "chunk_id")
    scored = exact_scores(index, questions, terms, promising)
    best = written(ranks(scored.unionByName(best.select("question_id", "chunk_id", "score"))))
    full = best.where(F.col("rank") == k).select("question_id", F.col("score").alias("now"))
    left = met.join(full, "question_id", "left").where(F.col("most") >= F.coalesce("now", F.lit(0.0)) - CLOSE).select("question_id", "chunk_id")
    left = left.join(promising, ["question_id", "chunk_id"], "left_anti")
    more = exact_scores(index, questions, terms, left)
    return ranks(more.unionByName(best.select("question_id", "chunk_id", "score")))


def top_k(index: LexicalIndex, questions: DataFrame, k: int) -> DataFrame:
    """``search``, and where fewer than ``k`` chunks share a token the first other chunks follow with score 0."""
    best = search(index, questions, k).select("question_id", "chunk_id", "document_id", "order_index", "score")
    # At most k of the first 2 k chunks can be among the best already, so k others are left.
    first = index.place.drop("block").orderBy("document_id", "order_index", "chunk_id").limit(2 * k).withColumn("one", F.lit(1))
    asked = query_tokens(questions).select("question_id").distinct().withColumn("one", F.lit(1))
    filler = asked.join(first, "one").withColumn("score", F.lit(0.0)).select(*best.columns)
    hits = best.unionByName(filler).groupBy("question_id", "chunk_id", "document_id", "order_index").agg(F.max("score").alias("score"))
    return top_per_key(hits, ["question_id"], best_first(), k)
