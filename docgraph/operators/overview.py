"""Views that join the latest of everything known of a document, a run or a workflow.

Runs and workflows come as one row for each task, step or model execution, not as
nested lists, so a workflow with a million executions is no single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.operators.ordered import row_index


def _last(df: DataFrame, key: str, at: list[str], columns: dict[str, str]) -> DataFrame:
    """The newest row of every key, combined on the map side; ``columns`` names what is kept of it."""
    row = F.max_by(F.struct(*[F.col(c).alias(name) for c, name in columns.items()]), F.struct(*at)).alias("_row")
    return df.groupBy(key).agg(row).select(key, "_row.*")


def _counted(df: DataFrame, key: str, **counts: Column) -> DataFrame:
    return df.groupBy(key).agg(*[c.alias(name) for name, c in counts.items()])


def analysis_overview(
    documents: DataFrame, summaries: DataFrame, nodes: DataFrame, edges: DataFrame, flags: DataFrame, questions: DataFrame,
    processing: DataFrame, index_jobs: DataFrame,
) -> DataFrame:
    """One row for each document, with its newest summary, graph statistics, flags, questions and newest jobs.

    Each part is aggregated by document before the join, so no part multiplies
    another and all joins run on the partitioning of the aggregates.  A document
    without a part has counts of 0 and nulls; parts of unknown documents are left out.

    Columns read: ``document_id`` everywhere; summaries ``summary_id, created_at``;
    flags ``severity``; jobs ``attempt, seq, status, progress``.
    """
    parts = [
        _last(summaries, "document_id", ["created_at", "summary_id"], {"summary_id": "summary_id"}),
        _counted(nodes, "document_id", nodes=F.count("*")),
        _counted(edges, "document_id", edges=F.count("*")),
        _counted(flags, "document_id", red_flags=F.count("*"), high_flags=F.count_if(F.col("severity").isin("HIGH", "CRITICAL"))),
        _counted(questions, "document_id", questions=F.count("*")),
        _last(processing, "document_id", ["attempt", "seq"], {"status": "processing_status", "progress": "processing_progress"}),
        _last(index_jobs, "document_id", ["attempt", "seq"], {"status": "index_status", "progress": "index_progress"}),
    ]
    out = documents.select("document_id").distinct()
    for part in parts:
        out = out.join(part, "document_id", "left")
    return out.fillna(0, ["nodes", "edges", "red_flags", "high_flags", "questions"])


def refreshed_overview(old: DataFrame, changed: DataFrame, documents: DataFrame, **parts: DataFrame) -> DataFrame:
    """C23 after a change: rows of the ``changed`` documents are computed again from their own parts, all others stay.

    Equal to ``analysis_overview`` of everything if ``changed`` holds the document of
    every row that was added, altered or removed since ``old``.  A document that is
    no longer in ``documents`` goes.
    """
    ids = changed.select("document_id").distinct()
    of_changed = {name: part.join(ids, "document_id", "left_semi") for name, part in parts.items()}
    fresh = analysis_overview(documents.join(ids, "document_id", "left_semi"), **of_changed)
    return old.join(ids, "document_id", "left_anti").unionByName(fresh)


def run_view(runs: DataFrame, tasks: DataFrame, outputs: DataFrame, verifications: DataFrame) -> DataFrame:
    """Runs with their tasks, each task's newest output and the run's newest verification.

    One row for each task in its ``sequence_number``; a run without tasks keeps one
    row.  Columns read: runs ``run_id, document_id, status, attempt``; tasks
    ``task_id, run_id, agent_name, sequence_number, status, error_message``; outputs
    ``task_id, result, confidence, created_at``; verifications ``run_id, status,
    issues, created_at``.
    """
    newest = _last(outputs, "task_id", ["created_at", "result", "confidence"], {"result": "result", "confidence": "confidence"})
    told = tasks.select("run_id", "task_id", "agent_name", "sequence_number", F.col("status").alias("task_status"), F.col("error_message").alias("task_error"))
    told = told.join(newest, "task_id", "left")
    verified = _last(verifications, "run_id", ["created_at", "status", "issues"], {"status": "verification_status", "issues": "verification_issues"})
    heads = runs.select("run_id", "document_id", "status", "attempt").join(verified, "run_id", "left")
    return heads.join(told, "run_id", "left")


def workflow_view(workflows: DataFrame, steps: DataFrame, executions: DataFrame) -> DataFrame:
    """Steps and model executions of workflows, each numbered from 1 in its order.

    Steps go by ``number``, executions by (``started_at``, ``attempt_number``).  A
    workflow without either keeps one row, whose ``part`` is null.  Positions come
    from segments of a day or of 4,096 steps, so a long workflow is many tasks.
    """
    listed = steps.select(
        "workflow_id", F.lit("STEP").alias("part"), F.col("step_id").cast("string").alias("name"), "status", "error_message",
        F.expr("number div 4096").alias("_seg"), F.struct(F.lit(None).cast("timestamp").alias("at"), F.col("number").cast("long").alias("number"), F.col("step_id").cast("string").alias("name")).alias("_by"),
    )
    run = executions.select(
        "workflow_id", F.lit("EXECUTION").alias("part"), F.col("model").alias("name"), "status", "error_message",
        F.unix_date(F.to_date("started_at")).cast("long").alias("_seg"), F.struct(F.col("started_at").cast("timestamp").alias("at"), F.col("attempt_number").cast("long").alias("number"), F.col("model").alias("name")).alias("_by"),
    )
    both = row_index(listed.unionByName(run), ["workflow_id", "part"], "_seg", "_by", "_n")
    told = both.select("workflow_id", "part", (F.col("_n") + 1).alias("position"), "name", F.col("status").alias("part_status"), "error_message")
    return workflows.select("workflow_id", "document_id", "status").join(told, "workflow_id", "left")
