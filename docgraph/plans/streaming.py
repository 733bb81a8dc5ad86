"""Streaming queries (S1-S10, A13).  Each reads the event table as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.plans.registry import query
from docgraph.sources import files, views
from docgraph.sources.tables import Tables
from docgraph.sources.views import with_views
from docgraph.streaming import jobs as S


class StreamTables(Tables):
    """The same tables as unbounded inputs."""

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        # The glob lets the source take a single file as well as a folder of files.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


def _stream(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


def _updates(stream, t, name):
    return S.run_updates(stream, files.fresh_path(t.spark, name))


_S1 = """RECURSIVE_BODY WITH
    ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM job_events),
    run AS (
      SELECT job_id, 0::BIGINT AS n, NULL::BIGINT AS seq, 'UPLOADED' AS status, 0::BIGINT AS progress, 'UPLOADED' AS step, NULL::VARCHAR AS outcome FROM ev WHERE n = 1
      UNION ALL
      SELECT job_id, n, seq, CASE WHEN outcome = 'ACCEPTED' THEN e_status ELSE status END, CASE WHEN outcome <> 'ACCEPTED' THEN progress WHEN e_status = 'COMPLETED' THEN 100 ELSE e_progress END,
        CASE WHEN outcome = 'ACCEPTED' THEN e_step ELSE step END, outcome
      FROM (SELECT r.job_id, e.n, e.seq, r.status, r.progress, r.step, e.status AS e_status, e.progress AS e_progress, e.current_step AS e_step,
          CASE WHEN r.status IN ('COMPLETED', 'FAILED') THEN CASE WHEN e.status = r.status AND e.progress = r.progress AND e.current_step = r.step THEN 'NO_OP' ELSE 'INVALID_STATE_TRANSITION' END
            WHEN e.status <> r.status AND NOT ((r.status = 'UPLOADED' AND e.status IN ('QUEUED', 'FAILED')) OR (r.status = 'QUEUED' AND e.status IN ('PROCESSING', 'FAILED'))
              OR (r.status = 'PROCESSING' AND e.status IN ('COMPLETED', 'FAILED'))) THEN 'INVALID_STATE_TRANSITION'
            WHEN e.progress NOT BETWEEN 0 AND 100 THEN 'INVALID_PROCESSING_PROGRESS' WHEN e.progress < r.progress THEN 'PROCESSING_PROGRESS_REGRESSION'
            WHEN e.current_page < 0 THEN 'INVALID_CURRENT_PAGE' WHEN e.current_page > e.total_pages THEN 'INVALID_PAGE_PROGRESS'
            WHEN e.status = 'FAILED' AND e.error_message IS NULL THEN 'PROCESSING_ERROR_MESSAGE_REQUIRED' ELSE 'ACCEPTED' END AS outcome
        FROM run r JOIN ev e ON e.job_id = r.job_id AND e.n = r.n + 1))
    SELECT job_id, seq, outcome, status, progress FROM run WHERE n > 0"""


@query("S1_job_state_machine", with_views("job_events", _S1))
def _(t):
    return S.job_states_batch(views.job_events(t))


@query("S1_job_state_machine_stream", with_views("job_events", _S1))
def _(t):
    return _updates(S.job_states(views.job_events(_stream(t))), t, "s1")


_S2 = """RECURSIVE_BODY WITH
    ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM login_events),
    run AS (
      SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS failures, NULL::TIMESTAMP AS until, NULL::VARCHAR AS outcome FROM ev WHERE n = 1
      UNION ALL
      SELECT user_id, n, event_id, CASE outcome WHEN 'RATE_LIMITED' THEN failures WHEN 'INVALID_CREDENTIALS' THEN failures + 1 ELSE 0 END,
        CASE outcome WHEN 'LOCKED' THEN ts + INTERVAL 15 MINUTE WHEN 'SUCCESS' THEN NULL ELSE until END, outcome
      FROM (SELECT r.user_id, e.n, e.event_id, e.ts, r.failures, r.until, CASE WHEN r.until > e.ts THEN 'RATE_LIMITED' WHEN e.ok THEN 'SUCCESS'
          WHEN r.failures + 1 >= 5 THEN 'LOCKED' ELSE 'INVALID_CREDENTIALS' END AS outcome FROM run r JOIN ev e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, event_id, outcome, failures FROM run WHERE n > 0"""


@query("S2_login_lockout", with_views("login_events", _S2))
def _(t):
    return S.login_outcomes_batch(views.login_events(t))


@query("S2_login_lockout_stream", with_views("login_events", _S2))
def _(t):
    return _updates(S.login_outcomes(views.login_events(_stream(t))), t, "s2")


#: What the watermark of a stream one day behind has passed when its input ends.
_PASSED = " WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events))"


@query("S1_job_states_in_event_time", with_views("job_events", _S1.replace("FROM job_events)", "FROM job_events" + _PASSED, 1)))
def _(t):
    return _updates(S.job_states(views.job_events(_stream(t)), "1 day"), t, "s1-late")


@query("S2_login_lockout_in_event_time", with_views("login_events", _S2.replace("FROM login_events)", "FROM login_events" + _PASSED, 1)))
def _(t):
    return _updates(S.login_outcomes(views.login_events(_stream(t)), "1 day"), t, "s2-late")


@query("S3_refresh_rotation", """
    SELECT user_id AS family_id, event_id AS seq, CASE WHEN n = 1 THEN 'ROTATED' WHEN n < 6 THEN 'ROTATED' WHEN n = 6 THEN 'REFRESH_TOKEN_REUSE'
      WHEN n % 2 = 0 THEN 'INVALID_REFRESH_TOKEN' ELSE 'SESSION_REVOKED_OR_EXPIRED' END AS outcome
    FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""")
def _(t):
    # Per family: five rotations, then the first hash again, then current and unknown ones.
    from docgraph.operators.ordered import row_index

    e = row_index(t.events.withColumn("seg", F.expr("event_id div 4096")), ["user_id"], "seg", "event_id", "i")
    rows = e.selectExpr(
        "user_id family_id", "event_id seq", "ts",
        "case when i < 5 then concat('h', i - 1) when i = 5 then 'h0' when i % 2 = 1 then 'unknown' else 'h4' end presented", "concat('h', i) issued",
    )
    path = files.fresh_path(t.spark, "s3-in")
    rows.write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    return _updates(S.rotations(stream), t, "s3")


@query("S4_security_revocation", """
    WITH h AS (SELECT *, lag(role) OVER w AS o_role, lag(pw) OVER w AS o_pw, lag(act) OVER w AS o_act FROM (
        SELECT user_id, event_id, ts, CASE WHEN event_id % 40 = 0 THEN 'ADMIN' ELSE 'USER' END AS role, event_id // 500 AS pw, event_type <> 'error' AS act FROM events)
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id AS at, CASE WHEN role <> o_role THEN 'ROLE_CHANGED' WHEN pw <> o_pw THEN 'PASSWORD_CHANGED' ELSE 'ACCOUNT_LOCKED' END AS reason
    FROM h WHERE role <> o_role OR pw <> o_pw OR (o_act AND NOT act)""")
def _(t):
    h = t.events.selectExpr(
        "user_id", "event_id div 4096 seg", "event_id at", "if(event_id % 40 = 0, 'ADMIN', 'USER') role", "event_id div 500 password_hash", "event_type <> 'error' is_active"
    )
    return S.security_changes(h)


@query("S5_recovery_sweep", with_views("job_events", """
    SELECT seq FROM job_events WHERE current_step = 'UPLOADED'"""))
def _(t):
    from docgraph.operators.governance import pending_jobs

    j = views.job_events(t).selectExpr("seq", "lpad(cast(seq as string), 20, '0') job_id", "ts created_at", "if(current_step = 'UPLOADED', 'UPLOADED', status) status")
    return pending_jobs(j).select("seq")


@query("S5_recovery_sweep_oldest_100", with_views("job_events", """
    SELECT seq FROM job_events WHERE current_step = 'UPLOADED' ORDER BY ts, seq LIMIT 100"""))
def _(t):
    from docgraph.operators.governance import pending_jobs

    j = views.job_events(t).selectExpr("seq", "lpad(cast(seq as string), 20, '0') job_id", "ts created_at", "if(current_step = 'UPLOADED', 'UPLOADED', status) status")
    return pending_jobs(j, limit=100).select("seq")


@query("S6_result_expiry", """
    SELECT user_id AS query_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
      AND ts + INTERVAL 48 HOUR > TIMESTAMP '2024-01-31'""")
def _(t):
    saved = t.events.selectExpr("user_id query_id", "event_id", "ts")
    return S.live_results(saved, "2024-01-31 00:00:00", 48 * 3600).select("query_id", "event_id")


@query("S6_result_expiry_stream", """
    SELECT user_id AS query_id, event_id, CASE WHEN n > 1 THEN 'REPLACED' WHEN ts + INTERVAL 48 HOUR < (SELECT max(ts) FROM events) THEN 'EXPIRED' ELSE 'SAVED' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)""")
def _(t):
    saved = _stream(t).events.selectExpr("user_id query_id", "event_id", "cast(ts as timestamp) ts")
    changes = _updates(S.result_changes(saved, 48 * 3600), t, "s6")
    # The last thing said of a result: SAVED comes before REPLACED or EXPIRED.
    order = F.when(F.col("change") == "SAVED", 0).otherwise(1)
    return changes.groupBy("query_id", "event_id").agg(F.max_by("change", order).alias("status"))


@query("A13_S7_audit_append", with_views("audit_events", """
    SELECT event_id, action, result, k FROM audit_events"""))
def _(t):
    path = files.fresh_path(t.spark, "audit")
    S.run_to_table(S.audit_stream(views.audit_events(_stream(t))), path)
    return t.spark.read.parquet(f"{path}/data").select("event_id", "action", "result", F.col("metadata")["k"].alias("k"))


@query("S8_incremental_index", """
    SELECT doc_id, length(text) AS n FROM documents""")
def _(t):
    rows = _stream(t).documents.selectExpr("doc_id", "cast(length(text) as bigint) n")
    return S.merge_into_buckets(rows, files.fresh_path(t.spark, "s8"), "doc_id", 8)


@query("S9_cancel_deleted", with_views("job_events", """
    SELECT seq, CASE WHEN document_id % 3 = 0 AND status IN ('QUEUED', 'PROCESSING') THEN 'CANCELLED' ELSE status END AS status,
      CASE WHEN document_id % 3 = 0 AND status IN ('QUEUED', 'PROCESSING') THEN 'DOCUMENT_DELETED' END AS error_code FROM job_events"""))
def _(t):
    j = views.job_events(t)
    return S.cancel_deleted(j, j.where("document_id % 3 = 0")).select("seq", "status", "error_code")


@query("S10_transcript_questions", """
    SELECT conv_id, turn, 1000 * turn AS start_ms FROM conversations WHERE role = 'user'""")
def _(t):
    c = _stream(t).conversations.withColumn("supplied", F.when(F.col("role") == "user", "QUESTION"))
    asked = c.where(X.segment_type(F.col("text"), F.col("supplied")) == "QUESTION").selectExpr("conv_id", "turn", "1000 * turn start_ms")
    path = files.fresh_path(t.spark, "s10")
    S.run_to_table(asked, path)
    return t.spark.read.parquet(f"{path}/data").orderBy("conv_id", "start_ms")


@query("S11_windowed_events", """
    SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS day, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count_if(F.col("event_type") == "error").alias("failures")).select(
        F.col("w.start").alias("day"), "failures"
    )
