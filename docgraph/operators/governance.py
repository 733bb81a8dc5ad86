"""Uploads, tenant visibility, policies, sessions and directory reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators.ordered import first_per_key, top_per_key
from docgraph.session import cut_lineage

# Accepted file types, unsafe suffixes and characters, size limit.
MIME = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DANGEROUS = (".bat", ".cmd", ".com", ".exe", ".jar", ".js", ".msi", ".php", ".ps1", ".scr", ".sh", ".vbs")
MAX_BYTES = 50 * 1024 * 1024
# Permissions of each role.
USER_PERMISSIONS = (
    "documents:create", "documents:read_own", "documents:read_granted", "documents:delete_own", "documents:ask_ai",
    "documents:read_legal_basis", "meetings:read_commune",
)
ADMIN_PERMISSIONS = USER_PERMISSIONS + (
    "users:create", "users:read_commune", "users:update_status", "users:reset_password", "staff_directory:read_province",
    "documents:read_commune", "documents:delete_commune", "documents:restore_commune", "documents:analyze_ai",
    "audit_logs:read_commune", "meetings:manage_commune",
)


def role_has(role: Column, permission: str) -> Column:
    """H37."""
    roles = [r for r, p in (("ADMIN", ADMIN_PERMISSIONS), ("USER", USER_PERMISSIONS)) if permission in p]
    return F.coalesce(role.isin(*roles), F.lit(False)) if roles else F.lit(False)


def upload_error(name: Column, content_type: Column, content: Column, *, unicode_form: bool = True) -> Column:
    """A4: code of the first check an upload fails, null when it passes."""
    safe = X.strip(X.nfkc(name) if unicode_form else name)
    suffix = X.name_suffix(safe)
    inner = F.slice(F.split(F.lower(safe), r"\."), 2, F.greatest(F.size(F.split(safe, r"\.")) - 2, F.lit(0)))
    risky = F.exists(inner, lambda s: F.concat(F.lit("."), s).isin(*DANGEROUS))
    unsafe = (
        (safe == "") | safe.isin(".", "..") | (F.length(safe) > 255) | safe.rlike(r"[. ]$")
        | safe.rlike(r"[\x00-\x1F]") | safe.rlike(r'[<>:"/\\|?*]') | risky
    )
    expected = X.lookup(suffix, MIME, F.lit(None).cast("string"))
    given = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    head = F.hex(F.substring(content, 1, 8))
    size = F.octet_length(content)
    signed = F.when(suffix == ".pdf", F.startswith(head, F.lit("255044462D"))).otherwise(F.startswith(head, F.lit("504B0304")))
    return (
        F.when(name.isNull(), "MISSING_FILENAME").when(unsafe, "UNSAFE_FILENAME")
        .when(expected.isNull(), "UNSUPPORTED_FILE_EXTENSION").when(given != expected, "MIME_TYPE_MISMATCH")
        .when(size > MAX_BYTES, "PAYLOAD_TOO_LARGE").when(size == 0, "EMPTY_FILE")
        .when(~signed, "INVALID_FILE_SIGNATURE")
    )


def reject_duplicates(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds DUPLICATE_DOCUMENT for content the workspace already holds.

    ``uploads``: upload_id, workspace_id, checksum, arrived.  Deleted documents
    do not count.  A checksum shared by very many uploads is reduced to its first
    one by a map-side combine.
    """
    key = ["workspace_id", "checksum"]
    first = uploads.groupBy(*key).agg(F.min_by("upload_id", F.struct("arrived", "upload_id")).alias("first_id"))
    out = uploads.join(first, key)
    dup = F.col("upload_id") != F.col("first_id")
    if existing is not None:
        held = existing.where("deleted_at is null and not is_deleted").select(*key).distinct().withColumn("held", F.lit(True))
        out = out.join(held, key, "left")
        dup = dup | F.coalesce("held", F.lit(False))
    return out.withColumn("error_code", F.when(dup, "DUPLICATE_DOCUMENT")).select(*uploads.columns, "error_code")


#: Pairs of an administrator and a document that one task writes.
PAIRS_PER_TASK = 32_000_000


def visible_documents(actors: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """Documents each actor may read, as rows (user_id, document_id).

    Owner, grant and commune each become an equi join; no actor meets a document
    he cannot see.
    """
    who = actors.where("is_active and status = 'ACTIVE'").select("user_id", "commune_id", "role")
    admins = who.where(F.col("role") == "ADMIN").where(role_has(F.col("role"), "documents:read_commune"))
    alive = documents.where("not is_deleted").select("document_id", "commune_id")
    return _own_documents(actors, documents, grants).unionByName(_commune_documents(admins.drop("role"), alive))


def _own_documents(actors: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """Documents that users own or are granted."""
    alive = documents.where("not is_deleted").select("document_id", "owner_id", "commune_id")
    who = actors.where("is_active and status = 'ACTIVE'").select("user_id", "commune_id", "role")
    users = who.where(role_has(F.col("role"), "documents:read_own") & (F.col("role") == "USER"))
    owned = users.join(alive, (users["user_id"] == alive["owner_id"]) & (users["commune_id"] == alive["commune_id"])).select("user_id", "document_id")
    # The grant carries the actor's commune, and so does the document.
    given = grants.where("permission in ('READ', 'ASK')").select("document_id", "user_id", "commune_id").distinct()
    shared = given.join(users, ["user_id", "commune_id"]).join(alive.drop("owner_id"), ["document_id", "commune_id"]).select("user_id", "document_id")
    return owned.unionByName(shared).distinct()


def _commune_documents(admins: DataFrame, alive: DataFrame) -> DataFrame:
    """Every administrator with every document of the commune.

    The documents of a commune are cut into parts by the pairs they make, and each part meets
    its administrators in the same order, document by document: rows that repeat so closely
    are stored in a fraction of the bytes of scattered ones.
    """
    counts = admins.groupBy("commune_id").agg(F.count("*").alias("_a")).join(alive.groupBy("commune_id").agg(F.count("*").alias("_d")), "commune_id")
    # A row per commune; the ceiling of pairs over the pairs of a task.
    parts = cut_lineage(counts.select("commune_id", F.ceil(F.col("_a") * F.col("_d") / PAIRS_PER_TASK).alias("_parts")))
    tasks = 2 * (parts.agg(F.sum("_parts")).first()[0] or 1)
    docs = alive.join(F.broadcast(parts), "commune_id").select("commune_id", "document_id", F.pmod(F.xxhash64("document_id"), F.col("_parts")).alias("_part"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part")
    readers = admins.join(F.broadcast(parts), "commune_id").select("commune_id", "user_id", every)
    met = docs.repartition(tasks, "commune_id", "_part").join(readers.hint("merge"), ["commune_id", "_part"])
    return met.select("user_id", "document_id")


def visible_counts(actors: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """Number of documents each actor may read, of those who may read any.

    An administrator reads what his commune holds, so each commune is counted once and
    no actor is paired with the documents of his commune.
    """
    admin = F.col("role") == "ADMIN"
    own = _own_documents(actors.where(~admin), documents, grants).groupBy("user_id").agg(F.count("*").alias("visible"))
    held = documents.where("not is_deleted").select("document_id", "commune_id").distinct().groupBy("commune_id").agg(F.count("*").alias("visible"))
    who = actors.where(admin & F.col("is_active") & (F.col("status") == "ACTIVE") & role_has(F.col("role"), "documents:read_commune"))
    return own.unionByName(who.join(held, "commune_id").select("user_id", "visible"))


def document_policy(pairs: DataFrame) -> DataFrame:
    """H36, B10.  ``pairs``: actor columns a_*, document columns, has_grant."""
    c = F.col
    live = c("a_is_active") & (c("a_status") == "ACTIVE")
    same = c("commune_id") == c("a_commune_id")
    gone = c("is_deleted") | c("deleted_at").isNotNull()
    admin, user = c("a_role") == "ADMIN", c("a_role") == "USER"
    own = c("owner_id") == c("a_user_id")
    read = live & same & ~c("is_deleted") & (
        (admin & role_has(c("a_role"), "documents:read_commune"))
        | (user & ((own & role_has(c("a_role"), "documents:read_own")) | (c("has_grant") & role_has(c("a_role"), "documents:read_granted"))))
    )
    settled = c("approval_status").isin("APPROVED", "PENDING_APPROVAL")
    delete = live & same & ~gone & (
        (admin & role_has(c("a_role"), "documents:delete_commune"))
        | (user & role_has(c("a_role"), "documents:delete_own") & own & c("meeting_id").isNull() & ~settled)
    )
    reason = (
        F.when(~same, "TENANT_MISMATCH").when(gone, "ALREADY_DELETED").when(user & ~own, "NOT_OWNER")
        .when(user & c("meeting_id").isNotNull(), "DOCUMENT_IN_MEETING")
        .when(user & settled, "APPROVAL_STATE_FORBIDS_DELETE").otherwise("MISSING_PERMISSION")
    )
    restore = live & admin & role_has(c("a_role"), "documents:restore_commune") & same & c("is_deleted") & c("deleted_at").isNotNull()
    return pairs.withColumns(
        {"can_read": read, "can_delete": delete, "can_restore": restore, "denial_reason": F.when(~delete, reason)}
    )


def lock_outcomes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Result of each request to lock an account.

    ``requests``: request_id, actor_id, target_id.
    """
    active = F.count_if((F.col("role") == "ADMIN") & F.col("is_active") & (F.col("status") == "ACTIVE"))
    admins = users.groupBy("commune_id").agg(active.alias("admins"))
    side = lambda p: users.select(*[F.col(c).alias(f"{p}_{c}" if c != "user_id" else f"{p}_id") for c in ("user_id", "commune_id", "role", "status", "is_active")])
    joined = requests.join(side("actor"), "actor_id", "left").join(side("target"), "target_id", "left")
    joined = joined.join(admins.withColumnRenamed("commune_id", "target_commune_id"), "target_commune_id", "left")
    c = F.col
    allowed = (
        c("actor_is_active") & (c("actor_status") == "ACTIVE") & (c("actor_role") == "ADMIN")
        & role_has(c("actor_role"), "users:update_status") & (c("actor_commune_id") == c("target_commune_id"))
    )
    code = (
        F.when(c("target_role").isNull(), "USER_NOT_FOUND").when(~F.coalesce(allowed, F.lit(False)), "FORBIDDEN")
        .when(c("target_id") == c("actor_id"), "SELF_LOCK_FORBIDDEN")
        .when(~c("target_is_active") | (c("target_status") == "LOCKED"), "USER_ALREADY_LOCKED")
        .when((c("target_role") == "ADMIN") & (c("admins") <= 1), "LAST_ADMIN_LOCK_FORBIDDEN").otherwise("LOCKED")
    )
    return joined.select("request_id", code.alias("outcome"))


def directory(users: DataFrame, communes: DataFrame, requesters: DataFrame) -> DataFrame:
    """Active staff of each requester's province, four columns."""
    home = requesters.join(users.select("user_id", "commune_id"), "user_id").join(communes, "commune_id")
    home = home.select(F.col("user_id").alias("requester_id"), "province_id")
    staff = users.where("status = 'ACTIVE' and is_active").join(communes, "commune_id")
    return home.join(staff, "province_id").select("requester_id", "full_name", "position", "commune_name", "email")


def token_reuse(presented: DataFrame, sessions: DataFrame, history: DataFrame) -> DataFrame:
    """Families to revoke, because a rotated hash of a session came back."""
    reused = presented.join(history, ["session_id", "token_hash"], "left_semi").select("session_id").distinct()
    families = sessions.join(reused, "session_id", "left_semi").select("token_family_id").distinct()
    return sessions.where("revoked_at is null").join(families, "token_family_id", "left_semi").select(
        "session_id", "token_family_id", F.lit("REFRESH_TOKEN_REUSE").alias("revoke_reason")
    )


def valid_sessions(claims: DataFrame, sessions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Claims whose session stands and that agree with the account at ``as_of``."""
    joined = claims.join(sessions.select("session_id", "user_id", "revoked_at", "expires_at"), ["session_id", "user_id"], "left")
    account = users.select("user_id", *[F.col(c).alias(f"u_{c}") for c in ("token_version", "role", "commune_id")])
    joined = joined.join(account, "user_id", "left")
    ok = (
        F.col("expires_at").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > F.to_timestamp(F.lit(as_of)))
        & (F.col("token_version") == F.col("u_token_version")) & (F.col("role") == F.col("u_role"))
        & (F.col("commune_id") == F.col("u_commune_id"))
    )
    return joined.select("session_id", "user_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def by_identifier(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Accounts whose username or email equals the identifier, letter case aside."""
    names = users.select("user_id", F.explode(F.array(F.lower("username"), F.lower("email"))).alias("identifier"))
    asked = wanted.select("login_id", F.lower("identifier").alias("identifier"))
    return asked.join(names, "identifier").select("login_id", "user_id").distinct()


def purge_keys(documents: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored objects of deleted documents."""
    gone = documents.where("deleted_at is not null").select("document_id")
    keys = files.select("document_id", "object_key").unionByName(
        pages.where("object_key <> ''").select("document_id", "object_key")
    )
    return keys.join(gone, "document_id", "left_semi")


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key is free; the first of equal new keys."""
    return first_per_key(new.join(existing.select(*keys), keys, "left_anti"), keys, order)


def pending_jobs(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Uploaded jobs that wait; with ``limit`` the oldest ones of them."""
    waiting = jobs.where("status = 'UPLOADED'")
    return waiting if limit is None else waiting.orderBy("created_at", "job_id").limit(limit)


def latest_by_attempt(jobs: DataFrame) -> DataFrame:
    """The newest job of every document: document_id, status.  ``jobs``: document_id, attempt, seq, status."""
    newest = F.max_by("status", F.struct("attempt", "seq"))
    return jobs.groupBy("document_id").agg(newest.alias("status"))


def workspace_dashboard(documents: DataFrame, jobs: DataFrame, index_jobs: DataFrame) -> DataFrame:
    """Documents of each workspace, and how many are being processed, done and indexed by their newest jobs."""
    state = latest_by_attempt(jobs)
    indexed = latest_by_attempt(index_jobs).select("document_id", F.col("status").alias("index_status"))
    joined = documents.select("workspace_id", "document_id").join(state, "document_id", "left").join(indexed, "document_id", "left")
    return joined.groupBy("workspace_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status").isin("QUEUED", "PROCESSING")).alias("processing"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("index_status") == "COMPLETED").alias("indexed"),
    )
