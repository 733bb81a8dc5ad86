"""Two versions of a regulation and one project, end to end."""

import datetime as dt

from docgraph.operators import regulatory as R
from docgraph.operators import structure

TEXT = {
    "v24": "Điều 10. Thẩm quyền\nKhoản 2. Ngưỡng\nNgưỡng phê duyệt: 500 triệu đồng\nThời hạn báo cáo: 30 ngày\nĐơn vị phê duyệt: UBND tỉnh",
    "v26": "Điều 12. Thẩm quyền\nKhoản 3. Ngưỡng\nNgưỡng phê duyệt: 800 triệu đồng\nThời hạn báo cáo: 30  NGÀY\nĐơn vị phê duyệt: Sở Tài chính",
}


def data(spark):
    rows = [("v24", 1, 1, "doc24", "12/2024/NĐ-CP", dt.date(2024, 1, 1), "Đầu tư công", TEXT["v24"]),
            ("v26", 1, 1, "doc26", "15/2026/NĐ-CP", dt.date(2026, 1, 1), "Đầu tư công", TEXT["v26"])]
    versions = spark.createDataFrame(rows, "version_id string, family_id long, workspace_id long, document_id string, document_number string, effective_date date, domain string, raw_text string")
    project = [("p", 1, "Dự án", "Chờ thẩm định", "dau tu cong", ["Ngân sách địa phương"], "Phòng Kế hoạch", ["Phòng Tài chính"], ["Luật Đầu tư công"], ["Nguồn vốn"])]
    projects = spark.createDataFrame(project, "project_id string, workspace_id long, name string, status string, domain string, budget_sources array<string>, lead_department string, coordinating_departments array<string>, legal_bases array<string>, sections array<string>")
    return R.previous_versions(versions), projects


def test_vertical_slice(spark):
    versions, projects = data(spark)
    changes = R.diff(versions, R.locate(R.facts(versions), structure.legal_locations(versions))).cache()
    by = {r.fact_key: r for r in changes.collect()}
    threshold = by["approval_threshold"]
    assert (threshold.change_type, threshold.old_location, threshold.new_location) == ("VALUE_CHANGED", "Khoản 2, Điều 10", "Khoản 3, Điều 12")
    assert threshold.effective_year == 2026 and len(threshold.evidence) == 2
    assert (by["reporting_deadline"].change_type, by["reporting_deadline"].status, by["reporting_deadline"].effective_year) == ("UNCHANGED", "KEEP_CURRENT_VALUE", None)
    assert by["approving_authority"].change_type == "RESPONSIBILITY_CHANGED"
    found = R.impacts(versions, changes, projects).cache()
    (impact,) = found.collect()
    assert (impact.level, impact.score) == ("HIGH", 0.9)
    listed = R.departments(found, projects)
    assert [r.department for r in listed.orderBy("rank").collect()] == ["Phòng Kế hoạch", "Phòng Tài chính"]
    assert R.advice(listed).count() == 4
    areas = R.affected_areas(found, changes, projects)
    done = {r.version_id: r for r in R.verify(versions, changes, R.impact_evidence(areas, found, projects), found).collect()}
    assert (done["v26"].status, done["v26"].rejected, done["v26"].confidence) == ("COMPLETED", 0, 1.0)
    assert (done["v24"].status, done["v24"].confidence) == ("NEEDS_HUMAN_REVIEW", 0.0)


def test_number_cited_inside_a_reference(spark):
    versions, projects = data(spark)
    changes = R.diff(versions, R.locate(R.facts(versions), structure.legal_locations(versions)))
    from pyspark.sql import functions as F

    citing = projects.withColumn("legal_bases", F.array(F.lit("Nghị định 115/2026/NĐ-CP")))
    (impact,) = R.impacts(versions, changes, citing).collect()
    assert (impact.level, impact.score, impact.legalReferenceMatch) == ("CRITICAL", 1.0, 0.10)


def test_forced_run_counts_up(spark):
    asked = spark.createDataFrame([("v1", False), ("v2", True), ("v3", False)], "version_id string, force boolean")
    runs = spark.createDataFrame([("v1:p", 1), ("v2:p", 1)], "idempotency_key string, attempt int")
    assert {(r.version_id, r.attempt) for r in R.new_runs(asked, runs, "p").collect()} == {("v2", 2), ("v3", 1)}


def test_versions_and_projects_of_the_impacts_are_read_once(spark, monkeypatch):
    versions, projects = data(spark)
    changes = R.diff(versions, R.located_facts(versions))
    written = []
    monkeypatch.setattr(R, "cut_lineage", lambda df: written.append(df.columns) or df.cache())
    (impact,) = R.impacts(versions, changes, projects).collect()
    assert impact.score == 0.9
    assert [c for columns in written for c in columns if c in ("raw_text", "evidence", "summary")] == [] and len(written) == 2


def test_areas_name_their_version_and_project(spark):
    """The keys come with the area, so that no impact or change has to be met again for them."""
    versions, projects = data(spark)
    changes = R.diff(versions, R.located_facts(versions)).cache()
    areas = R.affected_areas(R.impacts(versions, changes, projects), changes, projects)
    got = {(r.version_id, r.project_id, r.fact_key, r.change_type) for r in areas.collect()}
    assert got == {("v26", "p", "approval_threshold", "VALUE_CHANGED"), ("v26", "p", "approving_authority", "RESPONSIBILITY_CHANGED")}
