"""Visibility as bitmaps: what an actor may read is a few bitmaps, not a row per document.

Chunks are numbered once.  An access set (a commune, an owner, a grantee) is one
bitmap per 32,768 chunk numbers, built once whoever asks; an actor's bitmaps are the
union of its sets.  A search tests each candidate's bit, so an administrator of a
commune with a million documents adds some thirty rows to it and not a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import lexical
from docgraph.operators.governance import role_has
from docgraph.operators.ordered import top_per_key
from docgraph.session import written

SET = ["kind", "commune_id", "holder_id"]


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``chunk_no`` (from 1), written once so that the numbers stay."""
    return written(chunks.withColumn("chunk_no", F.monotonically_increasing_id() + 1))


def access_sets(chunks: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """kind, commune_id, holder_id, bucket, bits.  ``chunks`` from ``numbered``; deleted documents are in no set."""
    live = documents.where(~F.col("is_deleted")).select("document_id", "commune_id", "owner_id")
    held = chunks.select("chunk_no", "document_id").join(live, "document_id")
    everyone = held.select("chunk_no", F.lit("COMMUNE").alias("kind"), "commune_id", F.lit(None).cast("long").alias("holder_id"))
    owned = held.select("chunk_no", F.lit("OWNER").alias("kind"), "commune_id", F.col("owner_id").cast("long").alias("holder_id"))
    allowed = grants.where("permission in ('READ', 'ASK')").select("document_id", "commune_id", "user_id")
    given = held.join(allowed, ["document_id", "commune_id"])
    given = given.select("chunk_no", F.lit("GRANT").alias("kind"), "commune_id", F.col("user_id").cast("long").alias("holder_id"))
    every = everyone.unionByName(owned).unionByName(given)
    return every.groupBy(*SET, F.bitmap_bucket_number("chunk_no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("chunk_no")).alias("bits"))


def actor_bits(users: DataFrame, sets: DataFrame) -> DataFrame:
    """user_id, bucket, bits: the union of the sets of every active user."""
    active = users.where(F.col("is_active") & (F.col("status") == "ACTIVE"))
    users_of = active.where((F.col("role") == "USER") & role_has(F.col("role"), "documents:read_own"))
    own = users_of.select("user_id", "commune_id", F.explode(F.array(F.lit("OWNER"), F.lit("GRANT"))).alias("kind"), F.col("user_id").cast("long").alias("holder_id"))
    admin = active.where((F.col("role") == "ADMIN") & role_has(F.col("role"), "documents:read_commune")).select("user_id", "commune_id", F.lit("COMMUNE").alias("kind"), F.lit(None).cast("long").alias("holder_id"))
    asked = own.unionByName(admin.select(*own.columns))
    named = sets.select(*[F.col(c).alias(f"of_{c}") for c in SET], "bucket", "bits")
    match = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in SET]
    return asked.join(named, match).groupBy("user_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def visible_counts(bits: DataFrame) -> DataFrame:
    """Chunks that each actor may read, from the bitmaps alone."""
    return bits.groupBy("user_id").agg(F.sum(F.bitmap_count("bits")).alias("visible"))


def may_read(bits: Column, number: Column) -> Column:
    """Whether the bit of a chunk number is set in the bitmap of its bucket."""
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def scoped_search(chunks: DataFrame, questions: DataFrame, bits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` chunks of each question among those its asker may read.

    ``chunks`` from ``numbered``; ``questions``: question_id, question, user_id; ``bits`` from
    ``actor_bits``.  Document frequencies count the asker's own chunks, so nothing is learnt
    from other tenants.  Chunks that share no token follow with score 0.
    """
    asked = lexical.query_tokens(questions)
    askers = questions.select("question_id", "user_id").distinct()
    own_bits = written(askers.join(bits, "user_id").select("question_id", "bucket", "bits"))
    totals = own_bits.groupBy("question_id").agg(F.sum(F.bitmap_count("bits")).alias("total"))
    number = chunks.select("chunk_id", "chunk_no", F.bitmap_bucket_number("chunk_no").alias("bucket"))
    postings = lexical.token_frequencies(chunks, asked).join(number, "chunk_id")
    met = postings.join(asked, "token").join(own_bits, ["question_id", "bucket"]).where(may_read(F.col("bits"), F.col("chunk_no")))
    own = written(met.select("question_id", "chunk_id", "token", "tf", "n"))
    df = own.groupBy("question_id", "token").agg(F.count("*").alias("df"))
    weights = asked.join(totals, "question_id").join(df, ["question_id", "token"], "left")
    weights = weights.select("question_id", "token", "n", (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"))
    norms = weights.groupBy("question_id").agg(F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), 2))).alias("query_norm"), F.count("*").alias("query_terms"))
    w = F.col("tf") * F.col("idf")
    pairs = own.join(weights.drop("n"), ["question_id", "token"]).groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("n") * F.col("idf") * w).alias("dot"), F.sqrt(F.sum(w * w)).alias("chunk_norm"), F.count("*").alias("shared")
    )
    scored = written(pairs.join(norms, "question_id"))
    joined = lambda c: F.array_join(X.tokens(F.col(c)), " ")
    full = scored.where("shared = query_terms").select("question_id", "chunk_id")
    phrased = full.join(questions.select("question_id", joined("question").alias("phrase")), "question_id")
    phrased = phrased.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("body", joined("content")).where(F.col("body").contains(F.col("phrase")))
    phrased = phrased.select("question_id", "chunk_id", F.lit(lexical.PHRASE_BONUS).alias("bonus"))
    score = F.col("dot") / (F.col("query_norm") * F.col("chunk_norm")) + F.coalesce("bonus", F.lit(0.0))
    scored = scored.join(phrased, ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", F.round(score, 9).alias("score"))
    place = chunks.select("chunk_id", "chunk_no", "document_id", "order_index")
    best = written(top_per_key(scored.join(place.drop("chunk_no"), "chunk_id"), ["question_id"], lexical.best_first(), k).drop("rank"))
    # Only questions that found too little open their bitmaps, and keep the first chunks.
    got = best.groupBy("question_id").agg(F.count("*").alias("got"))
    short = own_bits.join(got, "question_id", "left").where(F.coalesce("got", F.lit(0)) < k)
    rest = place.withColumn("bucket", F.bitmap_bucket_number("chunk_no")).join(short, "bucket").where(may_read(F.col("bits"), F.col("chunk_no")))
    rest = rest.select("question_id", "chunk_id", "document_id", "order_index").join(best.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    rest = top_per_key(rest.withColumn("score", F.lit(0.0)), ["question_id"], lexical.best_first(), k).drop("rank")
    return top_per_key(best.unionByName(rest.select(*best.columns)), ["question_id"], lexical.best_first(), k)
