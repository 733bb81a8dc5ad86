import random

from pyspark.sql import functions as F

from docgraph.operators import access as A
from docgraph.operators import governance as G
from docgraph.operators import retrieval as Q


def tenants(spark):
    rng = random.Random(3)
    users = [(u, u % 3, "ADMIN" if u % 5 == 0 else "USER", "LOCKED" if u == 7 else "ACTIVE", u != 8) for u in range(20)]
    docs = [(d, rng.randrange(20), d % 3, d % 11 == 0) for d in range(150)]
    docs = [(d, o, c if rng.random() < 0.8 else o % 3, gone) for d, o, c, gone in docs]
    grants = [(rng.randrange(150), u, rng.randrange(3), rng.choice(["READ", "ASK", "NONE"])) for u in range(20) for _ in range(6)]
    return (
        spark.createDataFrame(users, "user_id long, commune_id long, role string, status string, is_active boolean"),
        spark.createDataFrame(docs, "document_id long, owner_id long, commune_id long, is_deleted boolean"),
        spark.createDataFrame(grants, "document_id long, user_id long, commune_id long, permission string"),
    )


def test_bitmaps_hold_what_the_rows_say(spark):
    users, documents, grants = tenants(spark)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    chunks = [(f"c{d}-{i}", d, i, " ".join(rng.choices(words, k=8))) for d in range(150) for i in range(2)]
    chunks = A.numbered(spark.createDataFrame(chunks, "chunk_id string, document_id long, order_index int, content string").repartition(5))
    bits = A.actor_bits(users, A.access_sets(chunks, documents, grants))
    visible = G.visible_documents(users, documents, grants).select("user_id", "document_id").distinct()
    want = {(r["user_id"], r["n"]) for r in visible.groupBy("user_id").agg((2 * F.count("*")).alias("n")).collect()}
    assert {tuple(r) for r in A.visible_counts(bits).collect()} == want and len(want) > 10
    seen = chunks.withColumn("bucket", F.bitmap_bucket_number("chunk_no")).join(bits, "bucket").where(A.may_read(F.col("bits"), F.col("chunk_no")))
    assert {tuple(r) for r in seen.select("user_id", "document_id").distinct().collect()} == {tuple(r) for r in visible.collect()}
    asked = spark.createDataFrame([(u, " ".join(rng.choices([*words, "none"], k=4)), u % 20) for u in range(40)] + [(50, "none at all", 3)], "question_id long, question string, user_id long")
    scope = asked.join(visible, "user_id").select("question_id", "document_id")
    rows = lambda df: sorted((r["question_id"], r["rank"], r["document_id"], r["order_index"], r["score"]) for r in df.collect())
    got, old = rows(A.scoped_search(chunks, asked, bits, 3)), rows(Q.scoped_top_k(chunks, asked, scope, 3))
    assert got == old and len(got) > 60


def test_pairs_of_a_commune_are_dealt_to_many_tasks(spark, monkeypatch):
    users, documents, grants = tenants(spark)
    rows = lambda: sorted(map(tuple, G.visible_documents(users, documents, grants).collect()))
    want = rows()
    monkeypatch.setattr(G, "PAIRS_PER_TASK", 20)
    admins = users.where("role = 'ADMIN'").select("user_id", "commune_id")
    met = G._commune_documents(admins, documents.where("not is_deleted").select("document_id", "commune_id"))
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 100 < sum(sizes) and rows() == want
