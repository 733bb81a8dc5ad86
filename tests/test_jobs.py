"""Job states, lockout and the query contract."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
import check
from docgraph.streaming import jobs as S

SMALL = "/root/testdata/sf0.001"


def test_job_rules(spark):
    rows = [("j", 1, "QUEUED", 10), ("j", 2, "PROCESSING", 40), ("j", 3, "PROCESSING", 30), ("j", 4, "COMPLETED", 90), ("j", 5, "PROCESSING", 95)]
    df = spark.createDataFrame([(*r, "S", None, None, None) for r in rows], "job_id string, seq long, status string, progress int, current_step string, current_page int, total_pages int, error_message string")
    got = [r.outcome for r in S.job_states_batch(df).orderBy("seq").collect()]
    assert got == ["ACCEPTED", "ACCEPTED", "PROCESSING_PROGRESS_REGRESSION", "ACCEPTED", "INVALID_STATE_TRANSITION"]


def test_lockout(spark):
    start = dt.datetime(2024, 1, 1, 23, 55)
    steps = [False] * 5 + [True, False] + [True]
    gaps = [0, 1, 2, 3, 4, 5, 6, 40]
    df = spark.createDataFrame([(i, 1, start + dt.timedelta(minutes=g), ok) for i, (g, ok) in enumerate(zip(gaps, steps))], "event_id long, user_id long, ts timestamp, ok boolean")
    got = [r.outcome for r in S.login_outcomes_batch(df).orderBy("event_id").collect()]
    assert got == ["INVALID_CREDENTIALS"] * 4 + ["LOCKED", "RATE_LIMITED", "RATE_LIMITED", "SUCCESS"]


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries)


@pytest.mark.parametrize("name", ["F6_lexical_top_k", "I1_regulatory_diff", "E8_packed_chunks", "R15_all_flags", "I10_citation_checks", "C4_I18_visible_documents"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    rel = con.sql(entry.oracle_sql()[name])
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
