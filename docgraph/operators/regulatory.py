"""Regulation versions: previous version, fact diff, impact on projects, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators.ordered import carry_last, exploded
from docgraph.session import cut_lineage

# Fact patterns, the change each fact means, and its shown name.
FACTS = {
    "approval_threshold": (
        r"(?iu)ngưỡng\s+phê\s+duyệt\s*[:\-]?\s*(\p{Nd}+(?:[.,]\p{Nd}+)?\s*(?:triệu|tỷ)\s*đồng)",
        "VALUE_CHANGED", "Ngưỡng phê duyệt",
    ),
    "reporting_deadline": (
        r"(?iu)thời\s+hạn\s+báo\s+cáo\s*[:\-]?\s*(\p{Nd}+\s*(?:ngày|tháng|năm))",
        "DEADLINE_CHANGED", "Thời hạn báo cáo",
    ),
    "approving_authority": (
        r"(?iu)(?:đơn\s+vị|cơ\s+quan)\s+phê\s+duyệt\s*[:\-]?\s*([^\n.;]+)",
        "RESPONSIBILITY_CHANGED", "Đơn vị phê duyệt",
    ),
}
WHOLE_TEXT = "Toàn văn"
# Sentences of the output; so are those in ``departments`` and ``advice`` below.
REASONS = {
    "VALUE_CHANGED": "Ngưỡng ngân sách của hồ sơ có thể không còn phù hợp.",
    "RESPONSIBILITY_CHANGED": "Đơn vị có thẩm quyền phê duyệt đã thay đổi.",
    "DEADLINE_CHANGED": "Tiến độ hiện tại có thể không đáp ứng thời hạn mới.",
}
ACTIONS = {
    "VALUE_CHANGED": "Kiểm tra ngưỡng ngân sách mới trong hồ sơ trình duyệt.",
    "RESPONSIBILITY_CHANGED": "Cập nhật đơn vị nhận và phê duyệt hồ sơ.",
    "DEADLINE_CHANGED": "Điều chỉnh mốc tiến độ và lịch báo cáo.",
}
OTHER_ACTION = "Rà soát nội dung đề án liên quan."


def previous_versions(versions: DataFrame) -> DataFrame:
    """Adds the id of the family's latest version with a smaller effective date."""
    dated = versions.withColumns(
        {"_day": F.unix_date("effective_date"), "_seg": F.expr("unix_date(effective_date) div 3650")}
    )
    rest = carry_last(
        dated.select("family_id", "version_id", "_day", "_seg"), ["family_id"], "_seg", "_day",
        {"previous_id": F.col("version_id")}, inclusive=False,
    )
    return versions.join(rest.select("version_id", "previous_id"), "version_id", "left")


def duplicate_dates(versions: DataFrame) -> DataFrame:
    """The assumption behind ``previous_versions``: no date twice in a family."""
    return versions.groupBy("family_id", "effective_date").count().where("count > 1")


def facts(versions: DataFrame) -> DataFrame:
    """One row per version and fact found in its text."""
    found = _with_facts(versions.select("version_id", "document_id", "raw_text"))
    return exploded(found, ["version_id", "document_id"], "facts", "f").select("version_id", "document_id", "f.*")


def _with_facts(versions: DataFrame) -> DataFrame:
    """``versions`` with the facts of each text as an array.

    A text is searched once per pattern; the value is taken from the part that matched.
    """
    matched = versions.withColumns({f"_{key}": F.regexp_extract("raw_text", pattern, 0) for key, (pattern, _, _) in FACTS.items()})
    found = F.array(
        *[
            F.struct(
                F.lit(key).alias("fact_key"), X.strip(F.regexp_extract(f"_{key}", pattern, 1)).alias("value"),
                X.strip(F.col(f"_{key}")).alias("quote"),
            )
            for key, (pattern, _, _) in FACTS.items()
        ]
    )
    return matched.select(*versions.columns, F.filter(found, lambda f: f["quote"] != "").alias("facts"))


def located_facts(versions: DataFrame) -> DataFrame:
    """H28 and H29 in the row of the text: rows of ``facts`` with the location of the first
    section holding the quote or the value.  Nothing is shuffled; of given facts and
    sections ``locate`` makes the same."""
    from docgraph.operators.structure import with_sections

    rows = with_sections(_with_facts(versions.select("version_id", "document_id", "raw_text")))
    folded = F.transform("sections", lambda s: F.struct(s["legal_location"].alias("location"), X.fold(s["content"]).alias("content")))
    sought = F.transform("facts", lambda f: F.struct(f.alias("f"), X.fold(f["quote"]).alias("quote"), X.fold(f["value"]).alias("value")))
    rows = exploded(rows, ["version_id", "document_id", folded.alias("sections")], sought, "x")
    holds = lambda s: s["content"].contains(F.col("x.quote")) | s["content"].contains(F.col("x.value"))
    location = F.coalesce(F.get(F.filter("sections", holds), F.lit(0))["location"], F.lit(WHOLE_TEXT))
    return rows.select("version_id", "x.f.fact_key", "document_id", "x.f.value", "x.f.quote", location.alias("location"))


def locate(found: DataFrame, sections: DataFrame) -> DataFrame:
    """Location of the first section holding the quote or the value."""
    content = X.fold(F.col("content"))
    holds = content.contains(X.fold(F.col("quote"))) | content.contains(X.fold(F.col("value")))
    first = (
        found.join(sections.select("version_id", "ord", "legal_location", "content"), "version_id")
        .where(holds).groupBy("version_id", "fact_key")
        .agg(F.min_by("legal_location", "ord").alias("location"))
    )
    return found.join(first, ["version_id", "fact_key"], "left").withColumn(
        "location", F.coalesce("location", F.lit(WHOLE_TEXT))
    )


def current_values(found: DataFrame) -> DataFrame:
    """At most one entry per known fact, so the map stays small."""
    return found.groupBy("version_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("fact_key", "value")))).alias("fact_values")
    )


def diff(versions: DataFrame, located: DataFrame) -> DataFrame:
    """Versions with a previous one against it, fact by fact (a full outer join)."""
    pairs = versions.where("previous_id is not null").select(
        F.col("version_id"), F.col("previous_id"), F.year("effective_date").alias("year")
    )
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("value", "location", "quote", "document_id")]
    old = pairs.join(
        located.select(F.col("version_id").alias("previous_id"), "fact_key", *side("old")), "previous_id"
    ).drop("year", "previous_id")
    new = located.select("version_id", "fact_key", *side("new")).join(pairs.select("version_id"), "version_id")
    both = old.join(new, ["version_id", "fact_key"], "full_outer").join(pairs, "version_id")
    has_old, has_new = F.col("old_value").isNotNull(), F.col("new_value").isNotNull()
    same = has_old & has_new & X.same_value(F.col("old_value"), F.col("new_value"))
    kind = X.lookup(F.col("fact_key"), {k: v[1] for k, v in FACTS.items()}, F.lit(None).cast("string"))
    label = X.lookup(F.col("fact_key"), {k: v[2] for k, v in FACTS.items()}, F.lit(None).cast("string"))
    change = F.when(same, "UNCHANGED").when(has_old & has_new, kind).when(has_new, "ADDED").otherwise("REMOVED")
    summary = (
        F.when(same, F.concat(label, F.lit(" giữ nguyên ở mức "), "new_value"))
        .when(has_old & has_new, F.concat(label, F.lit(" thay đổi từ "), "old_value", F.lit(" thành "), "new_value"))
        .when(has_new, F.concat(F.lit("Bổ sung "), F.lower(label), F.lit(": "), "new_value"))
        .otherwise(F.concat(F.lit("Bãi bỏ "), F.lower(label), F.lit(": "), "old_value"))
    )

    def evidence(role: str, version: str, p: str) -> Column:
        return F.when(
            F.col(f"{p}_value").isNotNull(),
            F.struct(
                F.lit(role).alias("sourceRole"), F.col(f"{p}_document_id").alias("documentId"),
                F.col(version).alias("documentVersionId"), F.col(f"{p}_location").alias("location"),
                F.col(f"{p}_quote").alias("quote"), F.col(f"{p}_value").alias("value"),
            ),
        )

    return both.select(
        X.stable_id("change", F.col("version_id"), F.col("fact_key")).alias("change_id"),
        "version_id", F.col("previous_id").alias("old_version_id"), "fact_key", change.alias("change_type"),
        F.when(same, "KEEP_CURRENT_VALUE").alias("status"), "old_value", "new_value",
        F.when(~F.coalesce(same, F.lit(False)), F.col("year")).alias("effective_year"),
        "old_location", "new_location", summary.alias("summary"),
        F.when(has_old & has_new, 0.99).otherwise(0.94).alias("confidence"),
        F.array_compact(
            F.array(evidence("OLD", "previous_id", "old"), evidence("NEW", "version_id", "new"))
        ).alias("evidence"),
    )


def material(changes: DataFrame) -> DataFrame:
    """Versions with a change that matters, and what kinds of it."""
    return changes.where("change_type <> 'UNCHANGED'").groupBy("version_id").agg(
        F.bool_or(F.col("change_type") == "VALUE_CHANGED").alias("has_value"),
        F.bool_or(F.col("change_type") == "RESPONSIBILITY_CHANGED").alias("has_responsibility"),
    )


def _legal_pairs(versions: DataFrame, projects: DataFrame) -> DataFrame:
    """Version and project pairs whose legal bases name the version's number.

    The number may start anywhere in a reference.  Every reference yields its
    substrings of the lengths that numbers of its workspace have, which meet the
    numbers in an equi join; an empty number is part of any reference.
    """
    numbers = versions.select("workspace_id", "version_id", X.slug(F.col("document_number")).alias("number"))
    lengths = numbers.select("workspace_id", F.length("number").alias("len")).distinct()
    refs = projects.select("workspace_id", "project_id", F.explode(F.transform("legal_bases", lambda r: X.slug(r))).alias("ref"))
    refs = refs.join(lengths, "workspace_id").where("len <= length(ref)")
    pieces = refs.select(
        "workspace_id", "project_id",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length("ref") - F.col("len") + 1),
                    lambda i: F.substring(F.col("ref"), i, F.col("len")),
                )
            )
        ).alias("number"),
    )
    return pieces.join(numbers, ["workspace_id", "number"]).select("version_id", "project_id").distinct()


BASE_FLAGS = ("dom", "has_value", "has_responsibility")
PROJECT_FLAGS = ("p_dom", "budget", "stage", "dept")


def impacts(versions: DataFrame, changes: DataFrame, projects: DataFrame, minimum: float = 0.20) -> DataFrame:
    """Scored version and project pairs of a workspace, from ``minimum`` up.

    A score depends only on a few flags of each side.  Flag combinations are
    scored first; only the ones that pass are expanded to pairs, so no pair is
    built that is not a result.  Pairs that cite the version's number are
    few and joined on their own.
    """
    sources = F.array_join("budget_sources", " ")
    names = X.slug(F.concat_ws(" ", F.array("lead_department"), "coordinating_departments"))
    status = X.slug(F.col("status"))
    p = projects.withColumns(
        {
            "p_dom": X.slug(F.col("domain")),
            "budget": X.slug(sources).contains("ngan sach"),
            "stage": status.contains("cho tham dinh") | status.contains("in progress"),
            "dept": names.contains("tai chinh") | names.contains("ke hoach"),
        }
    )
    v = versions.join(material(changes), "version_id").withColumn("dom", X.slug(F.col("domain")))
    # Written once, narrow: both are read by the flag combinations, the pairs and the citations.
    v = cut_lineage(v.select("version_id", "workspace_id", "document_number", *BASE_FLAGS))
    p = cut_lineage(p.select("workspace_id", "project_id", "legal_bases", *PROJECT_FLAGS))
    p_flags = p.drop("legal_bases")
    kinds = v.select("workspace_id", *BASE_FLAGS).distinct().join(
        p_flags.select("workspace_id", *PROJECT_FLAGS).distinct(), "workspace_id"
    )
    on = lambda cond, w: F.when(cond, w).otherwise(0.0)
    signals = F.struct(
        on(F.col("dom") == F.col("p_dom"), 0.15).alias("domainMatch"),
        on(F.col("has_value") & F.col("budget"), 0.25).alias("budgetSourceMatch"),
        on(F.col("stage"), 0.20).alias("projectStageMatch"),
        on(F.col("has_responsibility") & F.col("dept"), 0.20).alias("departmentResponsibilityMatch"),
    )
    kinds = kinds.withColumn("s", signals)
    base = sum((F.col(f"s.{n}") for n in (
        "budgetSourceMatch", "projectStageMatch", "departmentResponsibilityMatch")), F.col("s.domainMatch"))
    kinds = kinds.withColumn("base", base)
    passing = kinds.where(F.round(F.col("base") + 0.10, 2) >= minimum)
    pairs = v.join(passing, ["workspace_id", *BASE_FLAGS]).join(p_flags, ["workspace_id", *PROJECT_FLAGS])
    cited = _legal_pairs(v, p)
    keys = ["version_id", "project_id"]
    by_citation = (
        cited.join(v, "version_id").join(p_flags.drop("workspace_id"), "project_id")
        .join(kinds, ["workspace_id", *BASE_FLAGS, *PROJECT_FLAGS])
        .where(F.round(F.col("base") + 0.20, 2) >= minimum)
    )
    columns = [*keys, "workspace_id", "has_value", "has_responsibility", "s", "base"]
    plain = pairs.select(*columns).join(cited, keys, "left_anti").withColumn("cites", F.lit(0.0))
    scored = plain.unionByName(by_citation.select(*columns).withColumn("cites", F.lit(0.10)))
    score = F.round(F.least(F.lit(1.0), F.col("base") + F.col("cites") + 0.10), 2)
    return scored.select(
        X.stable_id("impact", *[F.col(k) for k in keys]).alias("impact_id"), *keys, "workspace_id",
        "has_value", "has_responsibility", score.alias("score"), X.level_of(score).alias("level"), "s.*",
        F.col("cites").alias("legalReferenceMatch"), F.lit(0.10).alias("effectiveDateMatch"),
    )


def departments(found: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per impact and department, the leading one first, with its signals."""
    names = F.array_distinct(F.concat(F.array("lead_department"), "coordinating_departments"))
    listed = projects.select("project_id", "lead_department", F.posexplode(names).alias("rank", "department"))
    lead = F.col("department") == F.col("lead_department")
    return found.join(listed, "project_id").select(
        "impact_id", "version_id", "project_id", "rank", "department", "has_value", "has_responsibility",
        F.when(lead, "Đơn vị chủ trì cần cập nhật hồ sơ và quy trình.")
        .otherwise("Đơn vị phối hợp cần rà soát nguồn vốn và thẩm quyền.").alias("reason"),
        F.array_compact(
            F.array(
                F.when(F.col("has_value"), "VALUE_CHANGED"),
                F.when(F.col("has_responsibility"), "RESPONSIBILITY_CHANGED"),
            )
        ).alias("matched_signals"),
    )


def advice(listed: DataFrame) -> DataFrame:
    """Actions by kind of department, with the columns that name its impact."""
    name = X.slug(F.col("department"))
    pick = lambda cond, a, b: F.when(F.col(cond), a).otherwise(b)
    actions = (
        F.when(
            name.contains("ke hoach"),
            F.array(
                F.lit("Rà soát lại hồ sơ trình duyệt."),
                pick("has_responsibility", "Cập nhật quy trình và đơn vị nhận hồ sơ.", "Rà soát tiến độ thực hiện."),
            ),
        )
        .when(
            name.contains("tai chinh"),
            F.array(
                pick("has_value", "Kiểm tra ngưỡng ngân sách mới.", "Rà soát nguồn vốn."),
                pick("has_responsibility", "Cập nhật đơn vị có thẩm quyền phê duyệt.", "Kiểm tra biểu mẫu tài chính."),
            ),
        )
        .otherwise(F.array(F.lit("Rà soát phần việc thuộc trách nhiệm của đơn vị.")))
    )
    keys = [c for c in ("impact_id", "version_id", "project_id") if c in listed.columns]
    each = F.transform(actions, lambda a, i: F.struct(i.alias("nth"), a.alias("action")))
    rows = exploded(listed, [*keys, "department"], each, "a")
    return rows.select(*keys, "department", "a.nth", "a.action", F.lit("HIGH").alias("priority"))


def affected_areas(found: DataFrame, changes: DataFrame, projects: DataFrame) -> DataFrame:
    """I4: one row per impact and material change, with the keys of both."""
    first = F.get("sections", 0)
    part = F.coalesce(F.nullif(first, F.lit("")), F.lit("Thông tin đề án"))
    moved = changes.where("change_type <> 'UNCHANGED'")
    kind = F.col("change_type")
    return (
        found.join(moved, "version_id").join(projects.select("project_id", part.alias("project_section")), "project_id")
        .select(
            "impact_id", "change_id", "version_id", "project_id", "fact_key", "project_section", F.col("new_location").alias("document_clause"), "change_type",
            X.lookup(kind, REASONS, F.col("summary")).alias("reason"),
            X.lookup(kind, ACTIONS, F.lit(OTHER_ACTION)).alias("action"),
            F.coalesce("new_location", F.lit(WHOLE_TEXT)).alias("location"),
            F.element_at("evidence", -1)["quote"].alias("quote"),
        )
    )


def impact_evidence(areas: DataFrame, found: DataFrame, projects: DataFrame) -> DataFrame:
    keys = ["impact_id", "version_id", "project_id"]
    regulation = areas.select(
        *keys, F.lit("REGULATION").alias("source_type"), F.col("change_id").alias("source_id"), "location", "quote"
    )
    status = F.concat(
        F.lit("Trạng thái: "), "status", F.lit("; nguồn vốn: "), F.array_join("budget_sources", ", "),
        F.lit("; chủ trì: "), "lead_department",
    )
    part = F.coalesce(F.nullif(F.get("sections", 0), F.lit("")), F.lit("Thông tin đề án"))
    project = found.join(projects, "project_id").select(
        *keys, F.lit("PROJECT").alias("source_type"), F.col("project_id").cast("string").alias("source_id"),
        part.alias("location"), status.alias("quote"),
    )
    return regulation.unionByName(project)


def cited_laws(versions: DataFrame) -> DataFrame:
    """I5."""
    refs = X.legal_references(F.col("raw_text"))
    return versions.select("version_id", "document_id", refs.alias("refs")).withColumn(
        "confidence", F.when(F.size("refs") > 0, 0.65).otherwise(1.0)
    )


def change_graph(versions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from each version to its changes."""
    nodes = versions.select(F.col("version_id").alias("node_id"), F.lit("DOCUMENT_VERSION").alias("type")).unionByName(
        changes.select(F.col("change_id").alias("node_id"), F.lit("CHANGE").alias("type"))
    )
    edges = changes.select(
        F.col("version_id").alias("source"), F.col("change_id").alias("target"), F.lit("HAS_CHANGE").alias("type")
    )
    return nodes, edges


def verify(versions: DataFrame, changes: DataFrame, evidence: DataFrame, found: DataFrame) -> DataFrame:
    """Claims checked and rejected per version, and the resulting status."""
    needed = F.when(F.col("change_type").isin("ADDED", "REMOVED"), 1).otherwise(2)
    per_change = changes.groupBy("version_id").agg(
        F.count("*").alias("n_changes"), F.count_if(F.size("evidence") < needed).alias("bad_changes")
    )
    # An impact is a pair of a version and a project; its digest is longer than both.
    pair = ["version_id", "project_id"]
    keys = pair if all(c in evidence.columns and c in found.columns for c in pair) else ["impact_id"]
    sided = evidence.groupBy(*keys).agg(
        (F.bool_or(F.col("source_type") == "REGULATION") & F.bool_or(F.col("source_type") == "PROJECT")).alias("ok")
    )
    per_impact = found.join(sided, keys, "left").groupBy("version_id").agg(
        F.count("*").alias("n_impacts"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("bad_impacts")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = versions.join(per_change, "version_id", "left").join(per_impact, "version_id", "left").withColumns(
        {
            "checked": zero("n_changes") + zero("n_impacts"),
            "rejected": zero("bad_changes") + zero("bad_impacts"),
        }
    )
    first = F.col("previous_id").isNull()
    share = F.greatest(F.lit(0.0), 1 - F.col("rejected") / F.greatest("checked", F.lit(1)))
    return joined.select(
        "version_id", "checked", "rejected",
        F.when(first, 0.0).otherwise(share).alias("confidence"),
        F.when(first | (F.col("rejected") > 0), "NEEDS_HUMAN_REVIEW").otherwise("COMPLETED").alias("status"),
    )


def new_runs(requests: DataFrame, runs: DataFrame, pipeline: str) -> DataFrame:
    """I8: runs to start.  A known key is skipped unless forced; then attempt rises.

    ``requests``: version_id, force.  ``runs``: idempotency_key, attempt.
    """
    keyed = requests.withColumn("idempotency_key", F.concat("version_id", F.lit(":" + pipeline)))
    last = runs.groupBy("idempotency_key").agg(F.max("attempt").alias("last_attempt"))
    return keyed.join(last, "idempotency_key", "left").where("force or last_attempt is null").select(
        "idempotency_key", "version_id", (F.coalesce("last_attempt", F.lit(0)) + 1).alias("attempt")
    )


def intake_issues(incoming: DataFrame, families: DataFrame, versions: DataFrame) -> DataFrame:
    """Type mismatch with the family, else an effective date it already has."""
    known = families.select("family_id", F.col("document_type").alias("family_type"))
    taken = versions.select("family_id", "effective_date", F.lit(True).alias("taken")).distinct()
    joined = incoming.join(known, "family_id", "left").join(taken, ["family_id", "effective_date"], "left")
    return joined.withColumn(
        "error_code",
        F.when(F.col("family_type") != F.col("document_type"), "DOCUMENT_FAMILY_TYPE_MISMATCH")
        .when(F.col("taken"), "DOCUMENT_VERSION_EFFECTIVE_DATE_EXISTS"),
    )


def review(found: DataFrame, events: DataFrame) -> DataFrame:
    """Latest review event of each impact, else PENDING."""
    last = events.groupBy("impact_id").agg(F.max_by(F.struct("status", "reviewer", "note"), "reviewed_at").alias("r"))
    return found.join(last, "impact_id", "left").withColumns(
        {"review_status": F.coalesce("r.status", F.lit("PENDING")), "reviewer": F.col("r.reviewer"), "note": F.col("r.note")}
    ).drop("r")


def impacts_of(found: DataFrame, listed: DataFrame, *, version_id=None, project_id=None, department=None) -> DataFrame:
    """Impacts by version, project and department (letter case aside)."""
    if version_id is not None:
        found = found.where(F.col("version_id") == version_id)
    if project_id is not None:
        found = found.where(F.col("project_id") == project_id)
    if department:
        wanted = listed.where(X.fold(F.col("department")) == X.fold(F.lit(department)))
        found = found.join(wanted.select("impact_id"), "impact_id", "left_semi")
    return found


def versions_with_documents(versions: DataFrame, documents: DataFrame, workspaces: list | None = None) -> DataFrame:
    """Versions with the number of versions of their family and the columns of its document.

    ``documents``: family_id and more.  With ``workspaces`` only versions of those tenants
    are returned; a family is still counted whole.
    """
    families = versions.groupBy("family_id").agg(F.count("*").alias("versions"))
    asked = versions if workspaces is None else versions.where(F.col("workspace_id").isin(workspaces))
    return asked.join(families, "family_id").join(documents, "family_id")


def first_sections(sections: DataFrame, keep: int | None = None, quote_chars: int | None = None) -> DataFrame:
    """The sections of a version as its evidence, ``location`` and ``quote``; with ``keep`` only the first ones."""
    from docgraph.operators.ordered import top_per_key

    first = sections if keep is None else top_per_key(sections, ["version_id"], [F.col("ord"), F.col("part")], keep)
    quote = F.col("content") if quote_chars is None else F.substring("content", 1, quote_chars)
    return first.select("version_id", "ord", "part", F.col("legal_location").alias("location"), quote.alias("quote"))
