"""Queries over files, tenants, policies, jobs and reports (A1-A6, A8, A11, A13, A15-A17, B1, B6, B10, B11, B13, B16, C3, C4, C22, C23, C25, C26, D*, E14, E18, F1-F3, F10, H22, H33, H36-H41, I18, I19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import audit as A
from docgraph.operators import governance as G
from docgraph.operators import ops as O
from docgraph.operators import overview as V
from docgraph.operators.filters import active, contains_needle, equals_all, page
from docgraph.operators.ordered import first_per_key, top_per_key
from docgraph.operators.vectors import upsert
from docgraph.plans.registry import query
from docgraph.sources import files, views
from docgraph.sources.tables import spread
from docgraph.sources.views import with_views
from docgraph.streaming import jobs as S

AS_OF = "2024-01-20 00:00:00"


@query("A1_object_scan")
def _(t):
    # Reads sizes only; the bytes column is pruned from the scan.
    found = files.object_scan(t.spark, t.folder)
    return files.with_names(found).select("name", "length", "error_code")


@query("A2_folder_scan", with_views("uploads", """
    SELECT page_id, filename AS name FROM uploads WHERE lower(filename) LIKE '%.docx' """))
def _(t):
    u = views.uploads(t).withColumn("path", F.concat(F.lit("/in/"), "filename"))
    locks = u.withColumn("path", F.concat(F.lit("/in/~$"), "filename"))
    named = files.with_names(u.unionByName(locks)).where(F.lower("name").endswith(".docx"))
    return named.where(~F.startswith("name", F.lit("~$"))).select("page_id", "name")


@query("A3_changed_files", """
    SELECT page_id FROM pages WHERE page_id % 3 <> 0 OR page_id % 9 = 0""")
def _(t):
    now = t.pages.selectExpr("page_id", "url path", "length(html) length", "page_id modificationTime")
    indexed = now.where("page_id % 3 = 0").selectExpr("path", "if(page_id % 9 = 0, length + 1, length) length", "modificationTime")
    return files.changed_files(now, indexed).select("page_id")


@query("A3_source_signature", """
    SELECT 'reordered' AS files_are, count(*) AS files, true AS same FROM pages
    UNION ALL SELECT 'without a name', count(*) FILTER (WHERE page_id % 11 <> 3), count(*) FILTER (WHERE page_id % 11 = 3) = 0 FROM pages
    UNION ALL SELECT 'longer', count(*), count(*) FILTER (WHERE page_id % 97 = 5) = 0 FROM pages""")
def _(t):
    f = t.pages.selectExpr("page_id", "url name", "length(html) length", "page_id modified")
    first = files.source_signature(f).select(F.col("signature").alias("of_first"))
    cases = {
        "reordered": f.orderBy(F.desc("name")), "without a name": f.where("page_id % 11 <> 3"),
        "longer": f.withColumn("length", F.expr("if(page_id % 97 = 5, length + 1, length)")),
    }
    found = [files.source_signature(df).withColumn("files_are", F.lit(name)) for name, df in cases.items()]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.crossJoin(first).select("files_are", "files", (F.col("signature") == F.col("of_first")).alias("same"))  # one row each


@query("A4_upload_gate", with_views("uploads", """
    SELECT page_id, CASE WHEN page_id % 11 IN (0, 1, 3) THEN 'UNSAFE_FILENAME' WHEN page_id % 11 = 2 THEN 'UNSUPPORTED_FILE_EXTENSION'
      WHEN page_id % 13 = 0 THEN 'MIME_TYPE_MISMATCH' WHEN page_id % 17 = 0 THEN 'EMPTY_FILE' WHEN page_id % 7 = 0 THEN 'INVALID_FILE_SIGNATURE' END AS error_code FROM uploads"""))
def _(t):
    return views.uploads(t).select(
        "page_id", G.upload_error(F.col("filename"), F.col("content_type"), F.col("content")).alias("error_code")
    )


@query("A6_duplicate_uploads", """
    SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY doc_id % 2, text ORDER BY doc_id) > 1 THEN 'DUPLICATE_DOCUMENT' END AS error_code FROM documents""")
def _(t):
    u = t.documents.select(F.col("doc_id").alias("upload_id"), (F.col("doc_id") % 2).alias("workspace_id"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.col("doc_id").alias("arrived"))
    return G.reject_duplicates(u).select(F.col("upload_id").alias("doc_id"), "error_code")


@query("A6_duplicates_of_stored", """
    SELECT b.doc_id FROM documents b WHERE b.doc_id % 5 = 0 AND b.text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 10 <> 3)""")
def _(t):
    rows = t.documents.selectExpr("doc_id upload_id", "0 workspace_id", "sha2(cast(text as binary), 256) checksum", "doc_id arrived")
    stored = rows.where("upload_id % 5 <> 0").selectExpr("workspace_id", "checksum", "upload_id % 10 = 3 is_deleted", "if(upload_id % 10 = 3, current_date(), null) deleted_at")
    held = stored.where("deleted_at is null and not is_deleted").select("workspace_id", "checksum").distinct()
    checked = G.reject_duplicates(rows.where("upload_id % 5 = 0"), stored).where("error_code is not null")
    return checked.join(held, ["workspace_id", "checksum"], "left_semi").select(F.col("upload_id").alias("doc_id"))


@query("A8_idempotent_rewrite", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    path = files.fresh_path(t.spark, "derived")
    d = t.documents.select("doc_id", "text", "lang")
    files.rewrite_documents(d, path, "lang")
    files.rewrite_documents(d.where("lang = 'de'"), path, "lang")
    return t.spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("A11_index_snapshot", "SELECT vec_id, label FROM embeddings")
def _(t):
    path = files.fresh_path(t.spark, "snapshot")
    files.save_snapshot(t.embeddings, path, "s")
    return files.load_snapshot(t.spark, path).select("vec_id", "label")


_PURGE = """SELECT object_key FROM tenant_documents WHERE is_deleted
    UNION ALL SELECT 'pages/' || document_id || '/' || i FROM tenant_documents, range(2) r(i) WHERE is_deleted AND document_id % 2 = 0"""


@query("A15_purge_keys", with_views("tenant_documents", _PURGE))
def _(t):
    d = views.tenant_documents(t)
    pages = d.selectExpr("document_id", "explode(array(0, 1)) i").selectExpr("document_id", "if(document_id % 2 = 0, concat('pages/', document_id, '/', i), null) object_key")
    return G.purge_keys(d, d.select("document_id", "object_key"), pages).select("object_key")


@query("A16_profile_upsert", """
    SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS responsibilities FROM customer""")
def _(t):
    old = t.customer.selectExpr("c_custkey user_id", "c_mktsegment responsibilities")
    new = t.customer.where("c_custkey % 4 = 0").selectExpr("c_custkey user_id", "'new' responsibilities", "1L at")
    return upsert(old, new, ["user_id"], "at")


@query("A17_insert_if_absent", """
    SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1""")
def _(t):
    new = t.orders.select("o_custkey", "o_orderkey")
    held = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return G.insert_absent(new, held, ["o_custkey"], [F.col("o_orderkey")])


@query("B1_active_documents", with_views("tenant_documents", "SELECT document_id FROM tenant_documents WHERE NOT is_deleted"))
def _(t):
    return active(views.tenant_documents(t)).select("document_id")


@query("B6_library_search", """
    SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') OR contains(lower(p_type), 'an')""")
def _(t):
    return contains_needle(t.part, ("p_name", "p_brand", "p_type"), "AN").select("p_partkey")


@query("B6_name_search_top", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 6")
def _(t):
    return contains_needle(t.part, ("p_name",), "a").orderBy("p_partkey").limit(6).select("p_partkey", "p_name")


def _waiting(t, limit=None):
    j = views.job_events(t).selectExpr("seq", "lpad(cast(seq as string), 20, '0') job_id", "ts created_at", "if(status = 'QUEUED', 'UPLOADED', status) status")
    return G.pending_jobs(j, limit).select("seq")


@query("B11_pending_jobs", with_views("job_events", "SELECT seq FROM job_events WHERE status = 'QUEUED'"))
def _(t):
    return _waiting(t)


@query("B11_pending_jobs_oldest_100", with_views("job_events", """
    SELECT seq FROM job_events WHERE status = 'QUEUED' ORDER BY ts, seq LIMIT 100"""))
def _(t):
    return _waiting(t, 100)


_LATEST = "SELECT document_id, attempt, status, seq FROM job_events QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY attempt DESC, seq DESC) = 1"


def _latest_jobs(t):
    j = views.job_events(t)
    return O.latest(j.withColumn("by", F.struct("attempt", "seq")), "document_id", "by", ["by", "status"]).selectExpr(
        "document_id", "by.attempt attempt", "by.seq seq", "status"
    )


@query("E14_latest_job", with_views("job_events", _LATEST))
def _(t):
    return _latest_jobs(t)


@query("B13_reprocess_guard", with_views("job_events", f"""
    SELECT document_id, CASE WHEN status IN ('UPLOADED', 'QUEUED', 'PROCESSING') THEN 'DOCUMENT_ALREADY_PROCESSING' END AS error_code,
      CASE WHEN status NOT IN ('UPLOADED', 'QUEUED', 'PROCESSING') THEN attempt + 1 END AS next_attempt FROM ({_LATEST})"""))
def _(t):
    last = _latest_jobs(t)
    return O.reprocess_guard(last.select("document_id"), last)


@query("D4_next_attempt", with_views("job_events", """
    SELECT c_custkey AS document_id, coalesce(max(attempt), 0) + 1 AS next_number FROM customer LEFT JOIN job_events ON document_id = c_custkey GROUP BY 1"""))
def _(t):
    keys = t.customer.select(F.col("c_custkey").alias("document_id"))
    return O.next_number(views.job_events(t).select("document_id", "attempt"), keys, "document_id", "attempt")


@query("B12_verified_questions", "SELECT doc_id, quality FROM labels WHERE toxic = 0 AND quality = 1")
def _(t):
    return equals_all(t.labels, {"toxic": 0, "quality": 1}, ("toxic", "quality")).select("doc_id", "quality")


@query("B16_snapshot_section_filter", with_views("chunks", """
    SELECT chunk_id FROM chunks WHERE article = 'Điều 2' AND lang = 'en'"""))
def _(t):
    return equals_all(views.doc_chunks(t), {"article": "Điều 2", "lang": "en", "clause": ""}, ("article", "lang", "clause")).select("chunk_id")


# ------------------------------------------------------------------ visibility and policies

_VISIBLE = """
    SELECT u.user_id, d.document_id FROM users u JOIN tenant_documents d ON d.commune_id = u.commune_id AND NOT d.is_deleted
    WHERE u.is_active AND u.status = 'ACTIVE' AND (u.role = 'ADMIN' OR d.owner_id = u.user_id
      OR EXISTS (SELECT 1 FROM grants g WHERE g.document_id = d.document_id AND g.user_id = u.user_id AND g.commune_id = u.commune_id))"""


@query("C4_I18_visible_documents", with_views("users tenant_documents grants", _VISIBLE))
def _(t):
    return G.visible_documents(views.users(t), views.tenant_documents(t), views.grants(t))


@query("F2_visible_page", with_views("users tenant_documents grants", f"""
    SELECT d.document_id FROM ({_VISIBLE}) v JOIN tenant_documents d USING (document_id) WHERE v.user_id = 10 ORDER BY d.created_at DESC, d.document_id LIMIT 10 OFFSET 10"""))
def _(t):
    d = views.tenant_documents(t)
    mine = G.visible_documents(views.users(t).where("user_id = 10"), d, views.grants(t))
    seen = d.join(mine, "document_id", "left_semi")
    return page(seen, [F.desc("created_at"), F.col("document_id")], 2, 10).select("document_id")


_PAIRS = """pairs AS (
    SELECT u.user_id, u.role, u.status, u.is_active, u.commune_id AS a_commune, d.*, g.user_id IS NOT NULL AS has_grant
    FROM tenant_documents d JOIN users u ON u.user_id IN (d.owner_id, d.owner_id + 1, d.owner_id - d.owner_id % 10)
    LEFT JOIN grants g ON g.document_id = d.document_id AND g.user_id = u.user_id)"""


def _pairs(t):
    d = views.tenant_documents(t).withColumn("a_user_id", F.explode(F.array_distinct(F.expr("array(owner_id, owner_id + 1, owner_id - owner_id % 10)"))))
    u = views.users(t).select(*[F.col(c).alias(f"a_{c}") for c in ("user_id", "commune_id", "role", "status", "is_active")])
    g = views.grants(t).select("document_id", F.col("user_id").alias("a_user_id"), F.lit(True).alias("g"))
    return d.join(u, "a_user_id").join(g, ["document_id", "a_user_id"], "left").withColumn("has_grant", F.coalesce("g", F.lit(False)))


_DELETE = """is_active AND status = 'ACTIVE' AND commune_id = a_commune AND NOT is_deleted AND (role = 'ADMIN' OR (owner_id = user_id AND meeting_id IS NULL AND approval_status NOT IN ('APPROVED', 'PENDING_APPROVAL')))"""


@query("H36_document_policy", with_views("users tenant_documents grants", f"""WITH {_PAIRS}
    SELECT user_id, document_id, is_active AND status = 'ACTIVE' AND commune_id = a_commune AND NOT is_deleted AND (role = 'ADMIN' OR owner_id = user_id OR has_grant) AS can_read,
      {_DELETE} AS can_delete, is_active AND status = 'ACTIVE' AND role = 'ADMIN' AND commune_id = a_commune AND is_deleted AS can_restore FROM pairs"""))
def _(t):
    return G.document_policy(_pairs(t)).select(F.col("a_user_id").alias("user_id"), "document_id", "can_read", "can_delete", "can_restore")


@query("B10_soft_delete_outcomes", with_views("users tenant_documents grants", f"""WITH {_PAIRS}
    SELECT user_id, document_id, CASE WHEN {_DELETE} THEN NULL WHEN commune_id <> a_commune THEN 'TENANT_MISMATCH' WHEN is_deleted THEN 'ALREADY_DELETED'
      WHEN role = 'USER' AND owner_id <> user_id THEN 'NOT_OWNER' WHEN role = 'USER' AND meeting_id IS NOT NULL THEN 'DOCUMENT_IN_MEETING'
      WHEN role = 'USER' AND approval_status IN ('APPROVED', 'PENDING_APPROVAL') THEN 'APPROVAL_STATE_FORBIDS_DELETE' ELSE 'MISSING_PERMISSION' END AS denial_reason FROM pairs"""))
def _(t):
    return G.document_policy(_pairs(t)).select(F.col("a_user_id").alias("user_id"), "document_id", "denial_reason")


@query("H37_role_permissions", """
    SELECT c_custkey AS user_id, c_custkey % 10 = 0 AS can_lock, true AS can_ask FROM customer""")
def _(t):
    r = F.col("role")
    return views.users(t).select("user_id", G.role_has(r, "users:update_status").alias("can_lock"), G.role_has(r, "documents:ask_ai").alias("can_ask"))


_LOCKS = """SELECT u.user_id AS request_id, CASE WHEN NOT (a.is_active AND a.status = 'ACTIVE' AND a.role = 'ADMIN' AND a.commune_id = u.commune_id) THEN 'FORBIDDEN'
      WHEN a.user_id = u.user_id THEN 'SELF_LOCK_FORBIDDEN' WHEN NOT u.is_active OR u.status = 'LOCKED' THEN 'USER_ALREADY_LOCKED'
      WHEN u.role = 'ADMIN' AND n <= 1 THEN 'LAST_ADMIN_LOCK_FORBIDDEN' ELSE 'LOCKED' END AS outcome
    FROM users u JOIN (SELECT commune_id, min(user_id) AS boss FROM users WHERE role = 'ADMIN' AND is_active AND status = 'ACTIVE' GROUP BY 1) b ON b.commune_id = u.commune_id
    JOIN users a ON a.user_id = CASE WHEN u.user_id % 50 = 1 THEN u.user_id ELSE b.boss END
    JOIN (SELECT commune_id, count(*) FILTER (role = 'ADMIN' AND is_active AND status = 'ACTIVE') AS n FROM users GROUP BY 1) c ON c.commune_id = u.commune_id"""


@query("D3_H38_lock_outcomes", with_views("users", _LOCKS))
def _(t):
    u = views.users(t)
    boss = u.where("role = 'ADMIN' and is_active and status = 'ACTIVE'").groupBy("commune_id").agg(F.min("user_id").alias("boss"))
    requests = u.join(boss, "commune_id").selectExpr("user_id request_id", "if(user_id % 50 = 1, user_id, boss) actor_id", "user_id target_id")
    return G.lock_outcomes(requests, u)


_COMMUNES = "communes AS (SELECT n_nationkey AS commune_id, n_name AS commune_name, n_regionkey AS province_id FROM nation)"


def _communes(t):
    return t.nation.selectExpr("n_nationkey commune_id", "n_name commune_name", "n_regionkey province_id")


@query("C3_I19_province_directory", with_views("users", f"""WITH {_COMMUNES},
    asked AS (SELECT min(user_id) AS requester_id, commune_id FROM users GROUP BY 2)
    SELECT a.requester_id, u.full_name, u.position, c.commune_name, u.email FROM asked a JOIN communes h ON h.commune_id = a.commune_id
    JOIN communes c ON c.province_id = h.province_id JOIN users u ON u.commune_id = c.commune_id WHERE u.status = 'ACTIVE' AND u.is_active"""))
def _(t):
    u = views.users(t)
    asked = u.groupBy("commune_id").agg(F.min("user_id").alias("user_id")).select("user_id")
    return G.directory(u, _communes(t), asked)


@query("F10_users_in_order", with_views("users", """
    SELECT user_id, full_name FROM users WHERE commune_id = 3 ORDER BY full_name, user_id LIMIT 20"""))
def _(t):
    return page(views.users(t).where("commune_id = 3"), ["full_name", "user_id"], 1, 20).select("user_id", "full_name")


@query("H41_identifier_match", """
    SELECT c_custkey AS login_id, c_custkey AS user_id FROM customer""")
def _(t):
    u = views.users(t)
    asked = u.selectExpr("user_id login_id", "upper(if(user_id % 2 = 0, username, email)) identifier")
    return G.by_identifier(u, asked)


_SESSIONS = """sessions AS (SELECT event_id AS session_id, user_id, user_id % 40 AS token_family_id, ts + INTERVAL 5 DAY AS expires_at,
      CASE WHEN event_id % 9 = 0 THEN ts END AS revoked_at FROM events)"""


def _sessions(t):
    return t.events.selectExpr(
        "event_id session_id", "user_id", "user_id % 40 token_family_id", "ts started_at", "ts + interval 5 days expires_at", "if(event_id % 9 = 0, ts, null) revoked_at"
    )


@query("C22_token_reuse", f"""WITH {_SESSIONS}
    SELECT session_id, token_family_id, 'REFRESH_TOKEN_REUSE' AS revoke_reason FROM sessions WHERE revoked_at IS NULL
      AND token_family_id IN (SELECT token_family_id FROM sessions WHERE session_id % 300 = 0)""")
def _(t):
    s = _sessions(t)
    presented = s.where("session_id % 100 = 0").selectExpr("session_id", "concat('h', session_id % 3) token_hash")
    history = s.selectExpr("session_id", "'h0' token_hash")
    return G.token_reuse(presented, s, history)


@query("C26_session_validity", with_views("users", f"""WITH {_SESSIONS}
    SELECT s.session_id, s.user_id, coalesce(s.revoked_at IS NULL AND s.expires_at > TIMESTAMP '{AS_OF}' AND u.token_version = s.session_id % 4 AND u.commune_id IS NOT NULL, false) AS valid
    FROM sessions s LEFT JOIN users u ON u.user_id = s.user_id"""))
def _(t):
    s, u = _sessions(t), views.users(t)
    claims = s.select("session_id", "user_id", (F.col("session_id") % 4).cast("int").alias("token_version")).join(u.select("user_id", "role", "commune_id"), "user_id", "left")
    return G.valid_sessions(claims, s, u, AS_OF)


@query("H22_sanitized_metadata", with_views("audit_events", """
    SELECT event_id, k, '[REDACTED]' AS access_token, substr(note, 1, 1024) AS note FROM audit_events"""))
def _(t):
    a = S.audit_stream(views.audit_events(t))
    m = F.col("metadata")
    return a.select("event_id", m["k"].alias("k"), m["Access_Token"].alias("access_token"), m["note"].alias("note"))


@query("H22_nested_metadata", """
    SELECT event_id, '{"Cookie":"[REDACTED]","detail":{"items":[' || array_to_string(list_transform(range(least(n, 100)), lambda i: CASE WHEN i % 2 = 0 THEN i::VARCHAR ELSE '{"userToken":"[REDACTED]","v":' || i || '}' END), ',')
      || '],"note":"' || substr(repeat(event_type || ' ', n), 1, 1024) || '"},"k":' || n || ',"ok":' || CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END || '}' AS metadata
    FROM (SELECT event_id, event_type, (event_id % 251)::BIGINT AS n FROM events)""")
def _(t):
    item = lambda i: F.when(i % 2 == 0, i.cast("string")).otherwise(F.concat(F.lit('{"v":'), i.cast("string"), F.lit(',"userToken":"t"}')))
    n = F.col("event_id") % 251
    items = F.array_join(F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), item)).otherwise(F.array().cast("array<string>")), ",")
    text = F.concat(
        F.lit('{"k":'), n.cast("string"), F.lit(',"Cookie":{"a":[1]},"ok":'), F.when(F.col("event_type") == "error", "false").otherwise("true"),
        F.lit(',"detail":{"note":"'), F.repeat(F.concat("event_type", F.lit(" ")), n.cast("int")), F.lit('","items":['), items, F.lit("]}}"),
    )
    return A.sanitized_json(spread(t.events).select("event_id", text.alias("metadata")), "event_id", "metadata")


@query("F3_audit_page", with_views("audit_events", """
    SELECT event_id, action FROM audit_events WHERE commune_id = 4 ORDER BY created_at DESC, event_id DESC LIMIT 25 OFFSET 25"""))
def _(t):
    a = views.audit_events(t).where("commune_id = 4")
    return page(a, [F.desc("created_at"), F.desc("event_id")], 2, 25).select("event_id", "action")


@query("F1_chunk_page", with_views("blocks", """
    SELECT document_id, order_index, (SELECT count(*) FROM blocks WHERE document_id = 4) AS total FROM blocks WHERE document_id = 4 ORDER BY order_index LIMIT 5 OFFSET 5"""))
def _(t):
    b = views.blocks(t).where("document_id = 4")
    total = b.groupBy("document_id").agg(F.count("*").alias("total"))
    return page(b, ["order_index"], 2, 5).join(total, "document_id").select("document_id", "order_index", "total")


@query("H33_display_stem", with_views("uploads", """
    SELECT page_id, regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS suffix FROM uploads"""))
def _(t):
    return views.uploads(t).select("page_id", X.display_stem(F.col("filename")).alias("stem"), X.name_suffix(F.col("filename")).alias("suffix"))


# ------------------------------------------------------------------ reports

# Jobs of odd attempts stand for index jobs, so newest index and processing jobs differ.
_LATEST_INDEX = _LATEST.replace("FROM job_events", "FROM job_events WHERE attempt % 2 = 1")


@query("D1_workspace_dashboard", with_views("tenant_documents job_events", f"""
    SELECT d.workspace_id, count(*) AS documents, count(*) FILTER (j.status IN ('QUEUED', 'PROCESSING')) AS processing,
      count(*) FILTER (j.status = 'COMPLETED') AS completed, count(*) FILTER (i.status = 'COMPLETED') AS indexed
    FROM tenant_documents d LEFT JOIN ({_LATEST}) j USING (document_id) LEFT JOIN ({_LATEST_INDEX}) i USING (document_id) GROUP BY 1"""))
def _(t):
    j = views.job_events(t)
    return G.workspace_dashboard(views.tenant_documents(t), j, j.where("attempt % 2 = 1"))


@query("D7_document_class", """
    SELECT doc_id, CASE WHEN t = n THEN 'TEXT_BASED' WHEN t = 0 THEN 'SCANNED' ELSE 'HYBRID' END AS document_type, round(t / n, 6) AS text_ratio
    FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (c >= 20) AS t FROM (
      SELECT doc_id, p, sum(length(regexp_replace(line, '\\s+', '', 'g'))) AS c FROM (
        SELECT doc_id, line, pos // 5 AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))
      GROUP BY 1, 2) GROUP BY 1)""")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    solid = F.length(F.regexp_replace("line", r"\s+", ""))
    pages = lines.groupBy("doc_id", F.expr("pos div 5").alias("p")).agg(F.sum(solid).alias("c"))
    per = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("c") >= 20).alias("t"))
    kind = F.when(F.col("t") == F.col("n"), "TEXT_BASED").when(F.col("t") == 0, "SCANNED").otherwise("HYBRID")
    return per.select("doc_id", kind.alias("document_type"), F.round(F.col("t") / F.col("n"), 6).alias("text_ratio"))


@query("D13_status_counters", with_views("job_events", """
    SELECT count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(DISTINCT current_step) AS steps FROM job_events"""))
def _(t):
    return views.job_events(t).agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_distinct("current_step").alias("steps"),
    )


@query("D14_accounts_by_province", """
    SELECT n_regionkey AS province_id, n_nationkey AS commune_id, count(*) AS accounts FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def _(t):
    u = views.users(t).join(_communes(t), "commune_id")
    return u.rollup("province_id", "commune_id").agg(F.count("*").alias("accounts"))


@query("D16_workflow_status", with_views("job_events", """
    SELECT job_id AS workflow_id, count(*) AS steps, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'QUEUED') THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS status,
      coalesce(string_agg(DISTINCT error_message, '; '), '') AS errors FROM job_events GROUP BY 1"""))
def _(t):
    steps = views.job_events(t).selectExpr("job_id workflow_id", "if(status = 'QUEUED', 'NEEDS_REVIEW', status) status", "error_message error")
    return O.workflow_status(steps).select("workflow_id", "steps", "status", "errors")


@query("D17_attempt_telemetry", """
    SELECT event_type AS model, count(*) AS attempts, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS fallback_share,
      count(*) FILTER (event_id % 7 = 0) AS failures, round(avg(event_id % 1000), 6) AS mean_latency_ms, max(event_id % 1000) AS max_latency_ms FROM events GROUP BY 1""")
def _(t):
    runs = t.events.selectExpr("event_type model", "event_id % 3 = 0 is_fallback", "event_id % 7 = 0 failed", "event_id % 1000 latency_ms")
    return O.attempt_telemetry(runs).select(
        "model", "attempts", F.round("fallback_share", 6).alias("fallback_share"), "failures", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), "max_latency_ms"
    )


@query("D21_archive", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS documents FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("documents")).orderBy(F.desc("year"), F.desc("month"))


@query("E18_keep_first", """
    SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def _(t):
    return first_per_key(t.documents.select("text", "doc_id"), ["text"], [F.col("doc_id")])


@query("C23_latest_artefacts", with_views("tenant_documents job_events kg_edges", f"""
    SELECT d.document_id, j.status, coalesce(g.edges, 0) AS edges, l.quality FROM tenant_documents d LEFT JOIN ({_LATEST}) j USING (document_id)
    LEFT JOIN (SELECT document_id, count(*) AS edges FROM kg_edges GROUP BY 1) g USING (document_id) LEFT JOIN labels l ON l.doc_id = d.document_id"""))
def _(t):
    edges = views.kg_edges(t).groupBy("document_id").agg(F.count("*").alias("edges"))
    flags = t.labels.selectExpr("doc_id document_id", "quality")
    joined = views.tenant_documents(t).join(_latest_jobs(t), "document_id", "left").join(edges, "document_id", "left").join(flags, "document_id", "left")
    return joined.select("document_id", "status", F.coalesce("edges", F.lit(0)).alias("edges"), "quality")


@query("C25_run_view", with_views("job_events", """
    SELECT j.job_id, j.seq, j.status, e.event_type AS output, count(*) OVER (PARTITION BY j.job_id ORDER BY j.seq) AS task_order FROM job_events j JOIN events e ON e.event_id = j.seq"""))
def _(t):
    from docgraph.operators.ordered import row_index

    j = views.job_events(t).withColumn("seg", F.expr("seq div 4096"))
    tasks = row_index(j.select("job_id", "seq", "status", "seg"), ["job_id"], "seg", "seq", "n")
    outputs = t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("output"))
    return tasks.join(outputs, "seq").select("job_id", "seq", "status", "output", (F.col("n") + 1).alias("task_order"))


@query("C23_analysis_overview", with_views("kg_nodes kg_edges job_events", f"""
    SELECT c_custkey AS document_id, s.seq AS summary_id, coalesce(n.c, 0) AS nodes, coalesce(e.c, 0) AS edges, coalesce(f.c, 0) AS red_flags, coalesce(f.h, 0) AS high_flags,
      coalesce(q.c, 0) AS questions, j.status AS processing_status, j.progress AS processing_progress, i.status AS index_status, i.progress AS index_progress
    FROM customer
    LEFT JOIN (SELECT document_id, seq FROM job_events WHERE status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, seq DESC) = 1) s ON s.document_id = c_custkey
    LEFT JOIN (SELECT document_id, count(*) AS c FROM kg_nodes GROUP BY 1) n ON n.document_id = c_custkey
    LEFT JOIN (SELECT document_id, count(*) AS c FROM kg_edges GROUP BY 1) e ON e.document_id = c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS c, count(*) FILTER (event_id % 4 < 2) AS h FROM events WHERE event_type = 'error' GROUP BY 1) f ON f.user_id = c_custkey
    LEFT JOIN (SELECT conv_id, count(*) AS c FROM conversations WHERE role = 'user' GROUP BY 1) q ON q.conv_id = c_custkey
    LEFT JOIN ({_LATEST.replace("status, seq", "status, seq, progress")}) j ON j.document_id = c_custkey
    LEFT JOIN ({_LATEST_INDEX.replace("status, seq", "status, seq, progress")}) i ON i.document_id = c_custkey"""))
def _(t):
    jobs = views.job_events(t)
    return V.analysis_overview(
        t.customer.selectExpr("c_custkey document_id"),
        summaries=jobs.where("status = 'COMPLETED'").selectExpr("document_id", "seq summary_id", "ts created_at"),
        nodes=views.kg_nodes(t), edges=views.kg_edges(t),
        flags=t.events.where("event_type = 'error'").selectExpr("user_id document_id", "case event_id % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' else 'LOW' end severity"),
        questions=t.conversations.where("role = 'user'").selectExpr("conv_id document_id"),
        processing=jobs, index_jobs=jobs.where("attempt % 2 = 1"),
    )


@query("C25_agent_run_view", """
    WITH tasks AS (SELECT l_orderkey || '-' || l_linenumber AS task_id, any_value(l_orderkey) AS run_id, any_value(l_linenumber) AS sequence_number, max(l_linestatus) AS status,
        max(CASE WHEN l_returnflag = 'R' THEN l_linestatus END) AS error FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS run_id, o_custkey AS document_id, o_orderstatus AS status, substr(o_orderpriority, 1, 1)::INT AS attempt, v.status AS verification_status, v.issues AS verification_issues,
      k.task_id, 'agent-' || (k.sequence_number % 5) AS agent_name, k.sequence_number, k.status AS task_status, k.error AS task_error, x.result, x.confidence
    FROM orders LEFT JOIN tasks k ON k.run_id = o_orderkey
      LEFT JOIN (SELECT l_orderkey, CASE WHEN l_tax > 0.04 THEN 'NEEDS_REVIEW' ELSE 'VERIFIED' END AS status, l_partkey AS issues FROM lineitem WHERE l_discount > 0.05
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_tax > 0.04, l_partkey DESC) = 1) v ON v.l_orderkey = o_orderkey
      LEFT JOIN (SELECT l_orderkey || '-' || l_linenumber AS task_id, 'r' || l_partkey AS result, l_discount AS confidence FROM lineitem WHERE l_returnflag <> 'R'
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, 'r' || l_partkey DESC, l_discount DESC) = 1) x ON x.task_id = k.task_id""")
def _(t):
    task = "concat(l_orderkey, '-', l_linenumber) task_id"
    lines = t.lineitem
    tasks = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("status"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))).alias("error_message"))
    return V.run_view(
        t.orders.selectExpr("o_orderkey run_id", "o_custkey document_id", "o_orderstatus status", "cast(substring(o_orderpriority, 1, 1) as int) attempt"),
        tasks.selectExpr("l_orderkey run_id", task, "concat('agent-', l_linenumber % 5) agent_name", "l_linenumber sequence_number", "status", "error_message"),
        lines.where("l_returnflag <> 'R'").selectExpr(task, "concat('r', l_partkey) result", "l_discount confidence", "l_shipdate created_at"),
        lines.where("l_discount > 0.05").selectExpr("l_orderkey run_id", "if(l_tax > 0.04, 'NEEDS_REVIEW', 'VERIFIED') status", "l_partkey issues", "l_shipdate created_at"),
    )


@query("C25_workflow_view", with_views("job_events", """
    SELECT c_custkey AS workflow_id, c_nationkey AS document_id, c_mktsegment AS status, part, position, name, part_status, error_message
    FROM customer LEFT JOIN (
      SELECT document_id, 'STEP' AS part, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS position, seq::VARCHAR AS name, status AS part_status, error_message FROM job_events
      UNION ALL SELECT user_id, 'EXECUTION', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), event_type, CASE WHEN event_id % 7 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END, NULL FROM events
    ) ON document_id = c_custkey"""))
def _(t):
    return V.workflow_view(
        t.customer.selectExpr("c_custkey workflow_id", "c_nationkey document_id", "c_mktsegment status"),
        views.job_events(t).selectExpr("document_id workflow_id", "seq step_id", "seq number", "status", "error_message"),
        t.events.selectExpr("user_id workflow_id", "event_type model", "ts started_at", "event_id attempt_number", "if(event_id % 7 = 0, 'FAILED', 'SUCCEEDED') status", "cast(null as string) error_message"),
    )
