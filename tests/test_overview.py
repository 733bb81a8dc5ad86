"""Overviews of documents, runs and workflows."""

import datetime as dt

from docgraph.operators import overview as V

DAY = dt.datetime(2024, 1, 1)
SCHEMAS = {
    "summaries": "document_id long, summary_id long, created_at timestamp",
    "nodes": "document_id long, node_id string",
    "edges": "document_id long, edge_id string",
    "flags": "document_id long, severity string",
    "questions": "document_id long, question string",
    "processing": "document_id long, attempt int, seq long, status string, progress int",
    "index_jobs": "document_id long, attempt int, seq long, status string, progress int",
}
ROWS = {
    "summaries": [(1, 10, DAY), (1, 11, DAY + dt.timedelta(days=1)), (2, 20, DAY)],
    "nodes": [(1, "a"), (1, "b"), (9, "c")],
    "edges": [(1, "e")],
    "flags": [(1, "HIGH"), (1, "LOW"), (2, "CRITICAL"), (None, "HIGH")],
    "questions": [(2, "why?")],
    "processing": [(1, 1, 5, "FAILED", 40), (1, 2, 3, "COMPLETED", 100), (2, 1, 1, "QUEUED", 0)],
    "index_jobs": [(1, 1, 1, "COMPLETED", 100)],
}


def frames(spark, rows):
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def told(df):
    names = ["document_id", "summary_id", "nodes", "edges", "red_flags", "high_flags", "questions", "processing_status", "processing_progress", "index_status", "index_progress"]
    return sorted(map(tuple, df.select(*names).collect()))


def test_overview(spark):
    documents = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    assert told(V.analysis_overview(documents, **frames(spark, ROWS))) == [
        (1, 11, 2, 1, 2, 1, 0, "COMPLETED", 100, "COMPLETED", 100),
        (2, 20, 0, 0, 1, 1, 1, "QUEUED", 0, None, None),
        (3, None, 0, 0, 0, 0, 0, None, None, None, None),
    ]
    assert told(V.analysis_overview(documents.limit(0), **frames(spark, ROWS))) == []


def test_a_refresh_equals_a_full_computation(spark):
    """Added, altered and removed rows, a new document and one that goes; unchanged documents are not computed again."""
    before = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    old = V.analysis_overview(before, **frames(spark, ROWS))
    later = dict(ROWS)
    later["flags"] = [(1, "LOW"), (4, "HIGH"), (2, "CRITICAL")]
    later["processing"] = [*ROWS["processing"], (1, 3, 9, "QUEUED", 0), (4, 1, 2, "FAILED", 7)]
    documents = spark.createDataFrame([(1,), (2,), (4,)], "document_id long")
    changed = spark.createDataFrame([(1,), (4,), (3,), (1,)], "document_id long")
    assert told(V.refreshed_overview(old, changed, documents, **frames(spark, later))) == told(V.analysis_overview(documents, **frames(spark, later)))
    marked = old.replace({20: 99}, subset=["summary_id"])
    kept = V.refreshed_overview(marked, changed, documents, **frames(spark, later)).where("document_id = 2").first()
    assert kept["summary_id"] == 99


def test_run_view(spark):
    runs = spark.createDataFrame([("r1", 1, "DONE", 2), ("r2", 2, "NEW", 1)], "run_id string, document_id long, status string, attempt int")
    tasks = spark.createDataFrame([("t1", "r1", "reader", 1, "DONE", None), ("t2", "r1", "judge", 2, "FAILED", "no")], "task_id string, run_id string, agent_name string, sequence_number int, status string, error_message string")
    outputs = spark.createDataFrame([("t1", "old", 0.2, DAY), ("t1", "new", 0.9, DAY + dt.timedelta(1)), ("tx", "lost", 0.1, DAY)], "task_id string, result string, confidence double, created_at timestamp")
    verified = spark.createDataFrame([("r1", "REJECTED", 3, DAY), ("r1", "VERIFIED", 0, DAY + dt.timedelta(1))], "run_id string, status string, issues int, created_at timestamp")
    got = [(r["run_id"], r["attempt"], r["verification_status"], r["sequence_number"], r["result"], r["task_error"]) for r in V.run_view(runs, tasks, outputs, verified).orderBy("run_id", "sequence_number").collect()]
    assert got == [("r1", 2, "VERIFIED", 1, "new", None), ("r1", 2, "VERIFIED", 2, None, "no"), ("r2", 1, None, None, None, None)]


def test_workflow_view(spark):
    flows = spark.createDataFrame([("w", 1, "DONE"), ("none", 2, "NEW")], "workflow_id string, document_id long, status string")
    steps = spark.createDataFrame([("w", f"s{i}", i, "DONE", None) for i in (5_000, 1, 4_096)], "workflow_id string, step_id string, number long, status string, error_message string")
    runs = spark.createDataFrame(
        [("w", "m", DAY + dt.timedelta(hours=h), n, "OK", None) for h, n in ((30, 1), (1, 2), (1, 1))], "workflow_id string, model string, started_at timestamp, attempt_number int, status string, error_message string",
    )
    got = {(r["workflow_id"], r["part"], r["position"], r["name"]) for r in V.workflow_view(flows, steps, runs).collect()}
    assert got == {("w", "STEP", 1, "s1"), ("w", "STEP", 2, "s4096"), ("w", "STEP", 3, "s5000"), ("w", "EXECUTION", 1, "m"), ("w", "EXECUTION", 2, "m"), ("w", "EXECUTION", 3, "m"), ("none", None, None, None)}
