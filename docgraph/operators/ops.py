"""Job, version and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.operators.ordered import row_index, top_per_key


def latest(df: DataFrame, key: str, by: str, columns: list[str]) -> DataFrame:
    """The row with the highest ``by`` per key, combined on the map side."""
    row = F.max_by(F.struct(*columns), F.struct(by, *[c for c in columns if c != by])).alias("r")
    return df.groupBy(key).agg(row).select(key, "r.*")


def next_number(df: DataFrame, keys: DataFrame, key: str, number: str) -> DataFrame:
    """Highest number plus one, 1 for a key without rows."""
    top = df.groupBy(key).agg(F.max(number).alias("top"))
    return keys.join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)) + 1).alias("next_number"))


def number_versions(df: DataFrame, family: str, date: str) -> DataFrame:
    """Versions counted per family; the newest is current, older completed ones superseded."""
    seg = F.expr(f"unix_date({date}) div 3650")
    counted = row_index(df.withColumns({"_seg": seg, "_day": F.unix_date(date)}), [family], "_seg", "_day", "_n")
    newest = df.groupBy(family).agg(F.max(date).alias("_newest"))
    out = counted.join(newest, family).withColumns(
        {"version_number": F.col("_n") + 1, "is_current": F.col(date) == F.col("_newest")}
    )
    return out.withColumn(
        "status",
        F.when(~F.col("is_current") & (F.col("status") == "COMPLETED"), "SUPERSEDED").otherwise(F.col("status")),
    ).drop("_seg", "_day", "_n", "_newest")


def workflow_status(steps: DataFrame, listed: int | None = None) -> DataFrame:
    """Worst step decides; the counts stand beside it.  ``errors`` lists distinct messages, the first ``listed`` if given."""
    failed, review = F.col("status") == "FAILED", F.col("status").isin("NEEDS_REVIEW", "SKIPPED")
    counted = steps.groupBy("workflow_id").agg(F.count("*").alias("steps"), F.count_if(failed).alias("failed"), F.count_if(review).alias("review"))
    messages = steps.where("error IS NOT NULL").select("workflow_id", "error").distinct()
    if listed is not None:
        messages = top_per_key(messages, ["workflow_id"], [F.col("error")], listed)
    errors = messages.groupBy("workflow_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))
    return counted.join(errors, "workflow_id", "left").withColumn("errors", F.coalesce("errors", F.lit(""))).withColumn(
        "status",
        F.when(F.col("failed") > 0, "FAILED").when(F.col("review") > 0, "NEEDS_REVIEW").otherwise("COMPLETED"),
    )


def attempt_telemetry(runs: DataFrame) -> DataFrame:
    """Attempts, fallback share, failures and latency per model."""
    return runs.groupBy("model").agg(
        F.count("*").alias("attempts"),
        F.avg(F.col("is_fallback").cast("double")).alias("fallback_share"),
        F.count_if(F.col("failed")).alias("failures"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"),
    )


def reprocess_guard(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Refused while the latest job is unfinished, else the next attempt."""
    last = latest(jobs, "document_id", "attempt", ["attempt", "status"])
    busy = F.col("status").isin("UPLOADED", "QUEUED", "PROCESSING")
    return requests.join(last, "document_id", "left").select(
        "document_id",
        F.when(busy, "DOCUMENT_ALREADY_PROCESSING").alias("error_code"),
        F.when(~F.coalesce(busy, F.lit(False)), F.coalesce("attempt", F.lit(0)) + 1).alias("next_attempt"),
    )
