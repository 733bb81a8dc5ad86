"""Arrays that cost much are computed once, though their items become rows."""

from pyspark.sql import functions as F

from docgraph.operators import regulatory as R
from docgraph.operators import structure as S
from docgraph.operators.ordered import exploded


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_that_are_not_null(spark):
    df = spark.createDataFrame([(1, [1, None, 2]), (2, []), (3, None)], "k long, a array<long>")
    assert sorted(exploded(df, ["k"], "a", "x").collect()) == [(1, 1), (1, 2)]
    assert exploded(df, [F.col("k").alias("j")], F.transform("a", lambda x: x + 1), "x").columns == ["j", "x"]


def test_sections_are_folded_once(spark, tmp_path):
    spark.createDataFrame([("v", "Điều 1. a\nb")], "version_id string, raw_text string").write.parquet(f"{tmp_path}/v")
    rows = S.legal_locations(spark.read.parquet(f"{tmp_path}/v"))
    assert plan(rows).count("aggregate(") == 1
    assert [r.content for r in rows.collect()] == ["b"]


def test_facts_are_searched_once(spark, tmp_path):
    text = "Điều 1\nNgưỡng phê duyệt: 5 triệu đồng"
    spark.createDataFrame([("v", "d", text)], "version_id string, document_id string, raw_text string").write.parquet(f"{tmp_path}/v")
    versions = spark.read.parquet(f"{tmp_path}/v")
    assert plan(R.facts(versions)).count("phê") == plan(R._with_facts(versions)).count("phê")
    assert [(r.fact_key, r.value) for r in R.facts(versions).collect()] == [("approval_threshold", "5 triệu đồng")]
    assert [r.location for r in R.located_facts(versions).collect()] == ["Điều 1"]


def test_actions_carry_the_keys_of_their_impact(spark):
    listed = spark.createDataFrame([("i", "v", 1, "Phòng Tài chính", True, False)], "impact_id string, version_id string, project_id long, department string, has_value boolean, has_responsibility boolean")
    got = R.advice(listed).select("version_id", "project_id", "nth").collect()
    assert [tuple(r) for r in got] == [("v", 1, 0), ("v", 1, 1)]


def test_impacts_are_verified_by_their_pair(spark):
    versions = spark.createDataFrame([("v", "u")], "version_id string, previous_id string")
    changes = spark.createDataFrame([], "version_id string, change_type string, evidence array<string>")
    found = spark.createDataFrame([(None, "v", 1), (None, "v", 2)], "impact_id string, version_id string, project_id long")
    sides = [(None, "v", 1, "REGULATION"), (None, "v", 1, "PROJECT"), (None, "v", 2, "PROJECT")]
    evidence = spark.createDataFrame(sides, "impact_id string, version_id string, project_id long, source_type string")
    assert [(r.checked, r.rejected) for r in R.verify(versions, changes, evidence, found).collect()] == [(2, 1)]
