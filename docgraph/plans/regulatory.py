"""Queries over regulation versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import regulatory as R
from docgraph.operators import structure
from docgraph.plans.registry import query
from docgraph.session import cut_lineage
from docgraph.sources import views
from docgraph.sources.views import with_views


def _stored(t):
    return t.stored("reg_versions", views.reg_versions)


def _versions(t):
    return R.previous_versions(_stored(t))


def _located(t):
    return R.located_facts(_stored(t))


def _changes(t, located=True):
    # Written once: a fact stands on the old side of one pair of versions and on the new side of another.
    found = _located(t) if located else R.facts(_stored(t)).withColumn("location", F.lit(R.WHOLE_TEXT))
    return R.diff(_versions(t), cut_lineage(found))


def _impacts(t):
    # Locations do not enter the score, and of a change only its type does.
    return R.impacts(_stored(t), _changes(t, False), views.projects(t))


@query("C10_previous_version", with_views("reg_facts", """
    SELECT version_id, prev_id AS previous_id FROM reg_facts"""))
def _(t):
    return _versions(t).select("version_id", "previous_id")


@query("C2_version_family_document", with_views("reg_versions", """
    SELECT v.version_id, v.family_id, f.versions, p_size AS document_rows FROM reg_versions v
    JOIN (SELECT family_id, count(*) AS versions FROM reg_versions GROUP BY 1) f USING (family_id)
    JOIN part ON p_partkey = v.family_id"""))
def _(t):
    documents = t.part.selectExpr("p_partkey family_id", "p_size document_rows")
    return R.versions_with_documents(views.reg_versions(t), documents).select("version_id", "family_id", "versions", "document_rows")


_FACT_SQL = """SELECT version_id, 'approval_threshold' AS fact_key, threshold AS value, 'Điều 1' AS location FROM reg_facts
    UNION ALL SELECT version_id, 'reporting_deadline', deadline, 'Điều 2' FROM reg_facts WHERE deadline IS NOT NULL
    UNION ALL SELECT version_id, 'approving_authority', authority, 'Khoản 1, Điều 2' FROM reg_facts"""


@query("H28_fact_extraction", with_views("reg_facts", f"SELECT version_id, fact_key, value FROM ({_FACT_SQL})"))
def _(t):
    return R.facts(views.reg_versions(t)).select("version_id", "fact_key", "value")


@query("H29_fact_location", with_views("reg_facts", _FACT_SQL))
def _(t):
    return _located(t).select("version_id", "fact_key", "value", "location")


@query("D15_current_values", with_views("reg_facts", f"""
    SELECT version_id, string_agg(fact_key || '=' || value, ';' ORDER BY fact_key) AS facts FROM ({_FACT_SQL}) GROUP BY 1"""))
def _(t):
    m = R.current_values(R.facts(views.reg_versions(t)))
    pairs = F.transform(F.map_entries("fact_values"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("version_id", F.array_join(pairs, ";").alias("facts"))


@query("C12_fact_keys_of_both_versions", with_views("changes", """
    SELECT version_id, fact_key, old_value, new_value FROM changes"""))
def _(t):
    return _changes(t, False).select("version_id", "fact_key", "old_value", "new_value")


@query("G2_union_of_fact_keys", with_views("changes", """
    SELECT version_id, count(DISTINCT fact_key) AS keys FROM changes GROUP BY 1"""))
def _(t):
    f = R.facts(views.reg_versions(t)).select("version_id", "fact_key")
    pairs = _versions(t).where("previous_id is not null").select("version_id", "previous_id")
    old = pairs.join(f.withColumnRenamed("version_id", "previous_id"), "previous_id").select("version_id", "fact_key")
    new = f.join(pairs, "version_id", "left_semi")
    return old.union(new).distinct().groupBy("version_id").agg(F.count("*").alias("keys"))


@query("I1_regulatory_diff", with_views("changes", """
    SELECT version_id, old_version_id, fact_key, change_type, CASE WHEN change_type = 'UNCHANGED' THEN 'KEEP_CURRENT_VALUE' END AS status,
      old_value, new_value, CASE WHEN change_type <> 'UNCHANGED' THEN year END AS effective_year,
      CASE WHEN change_type IN ('ADDED', 'REMOVED') THEN 0.94 ELSE 0.99 END AS confidence,
      CASE WHEN old_value IS NOT NULL THEN loc END AS old_location, CASE WHEN new_value IS NOT NULL THEN loc END AS new_location,
      CASE change_type WHEN 'UNCHANGED' THEN label || ' giữ nguyên ở mức ' || new_value WHEN 'ADDED' THEN 'Bổ sung ' || lower(label) || ': ' || new_value
        WHEN 'REMOVED' THEN 'Bãi bỏ ' || lower(label) || ': ' || old_value ELSE label || ' thay đổi từ ' || old_value || ' thành ' || new_value END AS summary,
      CASE WHEN change_type IN ('ADDED', 'REMOVED') THEN 1 ELSE 2 END AS evidence_count
    FROM changes JOIN (VALUES ('approval_threshold', 'Ngưỡng phê duyệt', 'Điều 1'), ('reporting_deadline', 'Thời hạn báo cáo', 'Điều 2'),
      ('approving_authority', 'Đơn vị phê duyệt', 'Khoản 1, Điều 2')) n(fact_key, label, loc) USING (fact_key)"""))
def _(t):
    return _changes(t).select(
        "version_id", "old_version_id", "fact_key", "change_type", "status", "old_value", "new_value", "effective_year",
        "confidence", "old_location", "new_location", "summary", F.size("evidence").alias("evidence_count"),
    )


@query("H30_same_value", with_views("changes", """
    SELECT version_id, fact_key, old_value = new_value AS same FROM changes WHERE old_value IS NOT NULL AND new_value IS NOT NULL"""))
def _(t):
    c = _changes(t, False).where("old_value is not null and new_value is not null")
    noisy = F.upper(F.concat(F.lit(" "), F.replace("new_value", F.lit(" "), F.lit("  "))))
    return c.select("version_id", "fact_key", X.same_value(F.col("old_value"), noisy).alias("same"))


@query("H39_effective_year", with_views("reg_versions", "SELECT version_id, year AS effective_year FROM reg_versions"))
def _(t):
    return views.reg_versions(t).select("version_id", F.year("effective_date").alias("effective_year"))


@query("H12_family_key", with_views("reg_versions", """
    SELECT version_id, CASE WHEN family_id BETWEEN 1900 AND 2099 THEN 'qd-ubnd-quy-dinh-so-nam'
      ELSE family_id || '-qd-ubnd-quy-dinh-so-' || family_id || '-nam' END AS family_key FROM reg_versions"""))
def _(t):
    v = views.reg_versions(t)
    key = X.family_key(F.col("title"), F.col("document_number"), F.lit(None).cast("string"))
    return v.select("version_id", key.alias("family_key"))


@query("C11_changes_by_workspace_projects", with_views("impacts", """
    SELECT workspace_id, count(*) AS pairs, count(DISTINCT version_id) AS versions FROM impacts GROUP BY 1"""))
def _(t):
    return _impacts(t).groupBy("workspace_id").agg(
        F.count("*").alias("pairs"), F.count_distinct("version_id").alias("versions")
    )


_LEVEL = "CASE WHEN score >= 0.95 THEN 'CRITICAL' WHEN score >= 0.70 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END"


@query("I2_impact_scores", with_views("impacts", f"""
    SELECT version_id, project_id, CAST(score AS DOUBLE) AS score, {_LEVEL} AS level FROM impacts"""))
def _(t):
    return _impacts(t).select("version_id", "project_id", "score", "level")


@query("H34_levels", with_views("impacts", f"SELECT {_LEVEL} AS level, count(*) AS n FROM impacts GROUP BY 1"))
def _(t):
    return _impacts(t).groupBy(X.level_of(F.col("score")).alias("level")).agg(F.count("*").alias("n"))


@query("I3_department_actions", with_views("impacts", """
    SELECT i.version_id, i.project_id, d.name AS department, a.nth, a.action
    FROM impacts i, LATERAL (SELECT DISTINCT unnest(list_prepend(i.lead_department, i.coordinating_departments)) AS name) d,
    LATERAL (SELECT * FROM (VALUES
      ('Phòng Kế hoạch', 0, 'Rà soát lại hồ sơ trình duyệt.'),
      ('Phòng Kế hoạch', 1, CASE WHEN i.hr THEN 'Cập nhật quy trình và đơn vị nhận hồ sơ.' ELSE 'Rà soát tiến độ thực hiện.' END),
      ('Phòng Tài chính', 0, CASE WHEN i.hv THEN 'Kiểm tra ngưỡng ngân sách mới.' ELSE 'Rà soát nguồn vốn.' END),
      ('Phòng Tài chính', 1, CASE WHEN i.hr THEN 'Cập nhật đơn vị có thẩm quyền phê duyệt.' ELSE 'Kiểm tra biểu mẫu tài chính.' END),
      ('Văn phòng', 0, 'Rà soát phần việc thuộc trách nhiệm của đơn vị.')) v(dep, nth, action) WHERE v.dep = d.name) a"""))
def _(t):
    return R.advice(R.departments(_impacts(t), views.projects(t))).select("version_id", "project_id", "department", "nth", "action")


@query("I4_affected_areas", with_views("impacts", """
    SELECT i.version_id, i.project_id, c.fact_key, c.change_type,
      CASE c.change_type WHEN 'VALUE_CHANGED' THEN 'Kiểm tra ngưỡng ngân sách mới trong hồ sơ trình duyệt.'
        WHEN 'RESPONSIBILITY_CHANGED' THEN 'Cập nhật đơn vị nhận và phê duyệt hồ sơ.'
        WHEN 'DEADLINE_CHANGED' THEN 'Điều chỉnh mốc tiến độ và lịch báo cáo.' ELSE 'Rà soát nội dung đề án liên quan.' END AS action,
      CASE WHEN i.project_id % 4 = 0 THEN 'Mục đầu tư' ELSE 'Thông tin đề án' END AS project_section
    FROM impacts i JOIN changes c USING (version_id) WHERE c.change_type <> 'UNCHANGED'"""))
def _(t):
    # Written once, without what stays as it was: neither impacts nor areas look at that.
    changes, p = cut_lineage(_changes(t, False).where("change_type <> 'UNCHANGED'")), views.projects(t)
    areas = R.affected_areas(R.impacts(_stored(t), changes, p), changes, p)
    return areas.select("version_id", "project_id", "fact_key", "change_type", "action", "project_section")


@query("H42_change_reasons", with_views("changes", """
    SELECT version_id, fact_key, CASE change_type WHEN 'VALUE_CHANGED' THEN 'Ngưỡng ngân sách của hồ sơ có thể không còn phù hợp.'
        WHEN 'RESPONSIBILITY_CHANGED' THEN 'Đơn vị có thẩm quyền phê duyệt đã thay đổi.'
        WHEN 'DEADLINE_CHANGED' THEN 'Tiến độ hiện tại có thể không đáp ứng thời hạn mới.' ELSE 'khác' END AS reason FROM changes"""))
def _(t):
    return _changes(t, False).select(
        "version_id", "fact_key", X.lookup(F.col("change_type"), R.REASONS, F.lit("khác")).alias("reason")
    )


@query("I5_cited_laws", with_views("reg_versions", """
    SELECT version_id, CASE WHEN family_id % 4 = 0 THEN 'Luật số ' || (family_id % 50) || '/' || year || ';Nghị định ' || year || '.' ELSE '' END AS refs,
      CASE WHEN family_id % 4 = 0 THEN 0.65 ELSE 1.0 END AS confidence FROM reg_versions"""))
def _(t):
    return R.cited_laws(views.reg_versions(t)).select(
        "version_id", F.array_join("refs", ";").alias("refs"), "confidence"
    )


@query("I6_change_graph", with_views("changes", """
    SELECT c.version_id AS source, 'HAS_CHANGE' AS type, count(*) AS targets FROM changes c GROUP BY 1"""))
def _(t):
    _, edges = R.change_graph(views.reg_versions(t), _changes(t, False))
    return edges.groupBy("source", "type").agg(F.count("*").alias("targets"))


@query("I7_verification", with_views("impacts reg_facts", """
    SELECT v.version_id, coalesce(c.n, 0) + coalesce(i.n, 0) AS checked, 0 AS rejected,
      CASE WHEN v.prev_id IS NULL THEN 0.0 ELSE 1.0 END AS confidence,
      CASE WHEN v.prev_id IS NULL THEN 'NEEDS_HUMAN_REVIEW' ELSE 'COMPLETED' END AS status
    FROM reg_facts v LEFT JOIN (SELECT version_id, count(*) AS n FROM changes GROUP BY 1) c USING (version_id)
    LEFT JOIN (SELECT version_id, count(*) AS n FROM impacts GROUP BY 1) i USING (version_id)"""))
def _(t):
    # Both are read several times.  Digests and sentences enter no count and are not made.
    none, p = F.lit(None).cast("string"), views.projects(t)
    changes = _changes(t, False).select("version_id", "fact_key", "change_type", "evidence")
    changes = cut_lineage(changes).select("*", *[none.alias(c) for c in ("change_id", "new_location", "summary")])
    found = cut_lineage(R.impacts(_stored(t), changes, p).select("version_id", "project_id")).withColumn("impact_id", none)
    evidence = R.impact_evidence(R.affected_areas(found, changes, p), found, p)
    return R.verify(_versions(t), changes, evidence, found)


@query("D8_minimum_confidence", with_views("changes impacts reg_facts", """
    SELECT v.version_id, coalesce(c.m, 0.0) AS diff_confidence, CAST(coalesce(i.m, 0.0) AS DOUBLE) AS impact_confidence
    FROM reg_facts v LEFT JOIN (SELECT version_id, min(CASE WHEN change_type IN ('ADDED', 'REMOVED') THEN 0.94 ELSE 0.99 END) AS m FROM changes GROUP BY 1) c USING (version_id)
    LEFT JOIN (SELECT version_id, min(score) AS m FROM impacts GROUP BY 1) i USING (version_id)"""))
def _(t):
    changes = cut_lineage(_changes(t, False))
    found = R.impacts(_stored(t), changes, views.projects(t))
    low = lambda df, c, n: df.groupBy("version_id").agg(F.min(c).alias(n))
    joined = _stored(t).select("version_id").join(low(changes, "confidence", "a"), "version_id", "left").join(
        low(found, "score", "b"), "version_id", "left")
    return joined.select(
        "version_id", F.coalesce("a", F.lit(0.0)).alias("diff_confidence"), F.coalesce("b", F.lit(0.0)).alias("impact_confidence")
    )


@query("D9_run_status", with_views("reg_facts", """
    SELECT CASE WHEN prev_id IS NULL THEN 'NEEDS_HUMAN_REVIEW' ELSE 'ANALYZED' END AS version_status, count(*) AS n FROM reg_facts GROUP BY 1"""))
def _(t):
    v = _versions(t)
    nothing = _changes(t, False)
    none = nothing.select(F.lit("x").alias("impact_id"), F.lit("x").alias("source_type"), "version_id").where(F.lit(False))
    done = R.verify(v, nothing, none, none)
    status = F.when(F.col("status") == "COMPLETED", "ANALYZED").otherwise("NEEDS_HUMAN_REVIEW")
    return done.groupBy(status.alias("version_status")).agg(F.count("*").alias("n"))


@query("I8_run_idempotency", with_views("reg_versions", """
    SELECT version_id || ':p1' AS idempotency_key, CASE WHEN year % 2 = 0 THEN 3 ELSE 1 END AS attempt
    FROM reg_versions WHERE year % 2 = 1 OR family_id % 3 = 0"""))
def _(t):
    v = views.reg_versions(t)
    runs = v.where("year % 2 = 0").selectExpr("concat(version_id, ':p1') idempotency_key", "explode(array(1, 2)) attempt")
    return R.new_runs(v.selectExpr("version_id", "family_id % 3 = 0 force"), runs, "p1").select("idempotency_key", "attempt")


@query("B5_impacts_by_department", with_views("impacts", """
    SELECT version_id, project_id FROM impacts
    WHERE lead_department = 'Phòng Kế hoạch' OR list_contains(coordinating_departments, 'Phòng Kế hoạch')"""))
def _(t):
    found, p = _impacts(t), views.projects(t)
    return R.impacts_of(found, R.departments(found, p), department="PHÒNG KẾ HOẠCH").select("version_id", "project_id")


@query("B14_impact_review", with_views("impacts", """
    SELECT version_id, project_id, CASE WHEN project_id % 3 = 0 THEN 'APPROVED' WHEN project_id % 3 = 1 THEN 'REJECTED' ELSE 'PENDING' END AS review_status,
      CASE WHEN project_id % 3 < 2 THEN 'note 2' END AS note FROM impacts"""))
def _(t):
    found = cut_lineage(_impacts(t))
    events = found.where("project_id % 3 < 2").selectExpr(
        "impact_id", "explode(array(struct(1 at, 'PENDING' s, 'note 1' n),"
        " struct(2 at, if(project_id % 3 = 0, 'APPROVED', 'REJECTED') s, 'note 2' n))) e",
    ).selectExpr("impact_id", "e.at reviewed_at", "e.s status", "'u1' reviewer", "e.n note")
    return R.review(found, events).select("version_id", "project_id", "review_status", "note")


@query("B15_intake_integrity", with_views("reg_versions", """
    SELECT version_id, CASE WHEN family_id % 5 = 0 THEN 'DOCUMENT_FAMILY_TYPE_MISMATCH'
      WHEN family_id % 2 = 0 THEN 'DOCUMENT_VERSION_EFFECTIVE_DATE_EXISTS' END AS error_code FROM reg_versions"""))
def _(t):
    v = views.reg_versions(t)
    families = v.selectExpr("family_id", "if(family_id % 5 = 0, 'LUAT', document_type) document_type").distinct()
    return R.intake_issues(v, families, v.where("family_id % 2 = 0")).select("version_id", "error_code")


@query("E15_version_numbers", with_views("reg_versions", """
    SELECT version_id, row_number() OVER w AS version_number, lead(version_id) OVER w IS NULL AS is_current,
      CASE WHEN lead(version_id) OVER w IS NULL THEN 'COMPLETED' ELSE 'SUPERSEDED' END AS status
    FROM reg_versions WINDOW w AS (PARTITION BY family_id ORDER BY effective_date)"""))
def _(t):
    from docgraph.operators.ops import number_versions

    v = views.reg_versions(t).withColumn("status", F.lit("COMPLETED"))
    return number_versions(v, "family_id", "effective_date").select("version_id", "version_number", "is_current", "status")


@query("E16_timeline", with_views("reg_facts", f"""
    SELECT v.family_id, v.version_id, row_number() OVER (PARTITION BY v.family_id ORDER BY v.effective_date) AS nth, f.facts
    FROM reg_facts v JOIN (SELECT version_id, string_agg(fact_key || '=' || value, ';' ORDER BY fact_key) AS facts FROM ({_FACT_SQL}) GROUP BY 1) f USING (version_id)"""))
def _(t):
    from docgraph.operators.ops import number_versions

    v = views.reg_versions(t).withColumn("status", F.lit("COMPLETED"))
    m = R.current_values(R.facts(v))
    pairs = F.transform(F.map_entries("fact_values"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return number_versions(v, "family_id", "effective_date").join(m, "version_id").select(
        "family_id", "version_id", F.col("version_number").alias("nth"), F.array_join(pairs, ";").alias("facts")
    )


@query("E17_first_sections_as_evidence", with_views("reg_versions", """
    WITH sections AS (SELECT version_id, 0 AS n, 'Mở đầu' AS location, 'Phần mở đầu của văn bản' AS content FROM reg_versions
    UNION ALL SELECT version_id, 1, 'Điều 1', regexp_extract(raw_text, '\\n(Ngưỡng phê[^\\n]*)', 1) FROM reg_versions
    UNION ALL SELECT version_id, 2, 'Điều 2', coalesce(nullif(regexp_extract(raw_text, '\\n(Thời hạn báo cáo[^\\n]*)', 1), ''), 'Điều 2') FROM reg_versions
    UNION ALL SELECT version_id, 3, 'Khoản 1, Điều 2', regexp_extract(raw_text, 'Khoản 1. Thẩm quyền\\n((?s:.)*)$', 1) FROM reg_versions)
    SELECT version_id, location, substr(content, 1, 300) AS quote FROM sections QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY n) <= 5"""))
def _(t):
    return R.first_sections(structure.legal_locations(views.reg_versions(t)), keep=5, quote_chars=300).select("version_id", "location", "quote")
