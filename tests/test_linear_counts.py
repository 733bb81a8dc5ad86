"""Counts and sets whose cost follows the rows, not the pairs."""

from pyspark.sql import functions as F

from docgraph.operators import governance as G
from docgraph.operators import rules as R
from test_access import tenants


def test_visible_counts_pair_no_administrator_with_documents(spark):
    users, documents, grants = tenants(spark)
    counts = G.visible_counts(users, documents, grants)
    rows = G.visible_documents(users, documents, grants).distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in rows.collect()}
    # 2,000 administrators of a commune of 2,000 documents: 2,000 rows, not four million.
    many = spark.range(2_000).selectExpr("id user_id", "1L commune_id", "'ADMIN' role", "'ACTIVE' status", "true is_active")
    held = spark.range(2_000).selectExpr("id document_id", "-1L owner_id", "1L commune_id", "false is_deleted")
    plan = G.visible_counts(many, held, grants)
    assert {r.visible for r in plan.collect()} == {2_000} and plan.count() == 2_000


def test_flags_of_equal_sets_without_a_second_pass_over_drafts(spark):
    drafts = spark.createDataFrame([("a", "X", 2), ("b", "X", 1), ("c", "X", 0), ("d", "Y", 3), ("e", "X", 9), ("f", "X", 8)], "flag_id string, issue_type string, ord int")
    links = [("a", "N", str(i)) for i in range(3000)] + [("b", "N", str(i % 3000)) for i in reversed(range(4000))] + [("c", "N", "1"), ("d", "N", "1")]
    kept = R.dedup_drafts(drafts, spark.createDataFrame(links, "flag_id string, kind string, element_id string").repartition(4))
    assert {r.flag_id for r in kept.collect()} == {"b", "c", "d", "f"}
    assert "LeftSemi" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_small_sets_meet_in_their_row_and_equal_large_ones(spark, monkeypatch):
    schema = "flag_id string, kind string, element_id string"
    drafts = spark.createDataFrame([(f, "X", i) for i, f in enumerate("abcd")], "flag_id string, issue_type string, ord int")
    # Two links each for a and b, twenty for c with the same two elements, three for d.
    links = [("a", "N", "1"), ("a", "N", "2"), ("b", "N", "2"), ("b", "N", "1"), *[("c", "N", str(1 + i % 2)) for i in range(20)], *[("d", "N", str(i)) for i in range(3)]]
    for limit in (1, 5, 1_000):
        monkeypatch.setattr(R, "ROW_LINKS", limit)
        kept = R.dedup_drafts(drafts, spark.createDataFrame(links, schema).repartition(3))
        assert {(r.flag_id, r.merged) for r in kept.collect()} == {("a", 3), ("d", 1)}
