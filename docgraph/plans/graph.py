"""Queries over the knowledge graph, red flags and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import citations as C
from docgraph.operators import graph as G
from docgraph.operators import rules as R
from docgraph.plans.registry import query
from docgraph.session import cut_lineage
from docgraph.sources import views
from docgraph.sources.tables import spread
from docgraph.sources.views import with_views


def _rule(key: str, rule: str, fn, sql: str):
    severity = R.SEVERITY[rule]

    @query(f"{key}_{rule.lower()}", with_views("kg_nodes kg_edges", f"""
        SELECT '{severity}' AS severity, anchor_id FROM ({sql})"""))
    def _(t):
        return fn(views.kg_nodes(t), views.kg_edges(t)).select("severity", "anchor_id")


_NO_IN = "SELECT node_id AS anchor_id FROM kg_nodes WHERE type = '{t}' AND node_id NOT IN (SELECT target_node_id FROM kg_edges WHERE type = '{e}')"
_NO_OUT = "SELECT node_id AS anchor_id FROM kg_nodes WHERE type = '{t}' AND node_id NOT IN (SELECT source_node_id FROM kg_edges WHERE type = '{e}')"
_rule("R1", "MISSING_RESPONSIBLE_ACTOR", lambda n, e: R.absent(n, e, "MISSING_RESPONSIBLE_ACTOR"), _NO_IN.format(t="TASK", e="ASSIGNS_RESPONSIBILITY"))
_rule("R2", "MISSING_LEAD_AGENCY", lambda n, e: R.absent(n, e, "MISSING_LEAD_AGENCY"), _NO_IN.format(t="TASK", e="LEADS"))
_rule("R3", "MISSING_DEADLINE", lambda n, e: R.absent(n, e, "MISSING_DEADLINE"), _NO_OUT.format(t="TASK", e="HAS_DEADLINE"))
_rule("R4", "DOSSIER_WITHOUT_RECEIVING_AUTHORITY", lambda n, e: R.absent(n, e, "DOSSIER_WITHOUT_RECEIVING_AUTHORITY"), _NO_OUT.format(t="DOSSIER", e="SUBMITS"))
_rule("R5", "MISSING_BUDGET_AMOUNT", lambda n, e: R.missing_amount(n), "SELECT node_id AS anchor_id FROM kg_nodes WHERE type = 'BUDGET' AND coalesce(amount, '') = ''")
_rule("R6", "MISSING_FUNDING_SOURCE", lambda n, e: R.absent(n, e, "MISSING_FUNDING_SOURCE"), """
    SELECT node_id AS anchor_id FROM kg_nodes WHERE type = 'BUDGET' AND node_id NOT IN
      (SELECT source_node_id FROM kg_edges WHERE type = 'HAS_FUNDING_SOURCE' UNION SELECT target_node_id FROM kg_edges WHERE type = 'HAS_FUNDING_SOURCE')""")
_rule("R7", "BROKEN_LEGAL_REFERENCE", R.broken_reference, """
    SELECT node_id AS anchor_id FROM kg_nodes WHERE type = 'LEGAL_REFERENCE' AND (resolved = 'false' OR node_id NOT IN
      (SELECT source_node_id FROM kg_edges WHERE type = 'REFERENCES' UNION SELECT target_node_id FROM kg_edges WHERE type = 'REFERENCES'))""")
_rule("R8", "MISSING_REFERENCED_FORM", lambda n, e: R.missing_form(n), "SELECT node_id AS anchor_id FROM kg_nodes WHERE type = 'LEGAL_REFERENCE' AND target_type = 'FORM' AND resolved = 'false'")
_rule("R9", "LOW_CONFIDENCE_CRITICAL_TEXT", R.low_confidence, """
    SELECT node_id AS anchor_id FROM kg_nodes WHERE importance = 'CRITICAL' AND confidence < 0.75
    UNION ALL SELECT edge_id FROM kg_edges WHERE importance = 'CRITICAL' AND confidence < 0.75""")
_MANY = "SELECT target_node_id AS anchor_id FROM kg_edges WHERE type = '{e}' GROUP BY 1 HAVING count(*) > 1"
_rule("R10", "MULTIPLE_LEAD_AGENCIES", lambda n, e: R.crowded(e, "MULTIPLE_LEAD_AGENCIES", "LEADS"), _MANY.format(e="LEADS"))
_rule("R11", "CONFLICTING_RESPONSIBILITY", lambda n, e: R.crowded(e, "CONFLICTING_RESPONSIBILITY", "ASSIGNS_RESPONSIBILITY"), _MANY.format(e="ASSIGNS_RESPONSIBILITY"))
_rule("R12", "DEADLINE_WITHOUT_OUTPUT", lambda n, e: R.deadline_without_output(e), """
    SELECT DISTINCT source_node_id AS anchor_id FROM kg_edges WHERE type = 'HAS_DEADLINE'
      AND source_node_id NOT IN (SELECT source_node_id FROM kg_edges WHERE type = 'PRODUCES')""")
_DIFFER = """SELECT e.source_node_id AS anchor_id FROM kg_edges e LEFT JOIN kg_nodes n ON n.node_id = e.target_node_id WHERE e.type = '{e}'
    GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT lower(coalesce(nullif(n.amount, ''), nullif(n.value, ''), n.name, e.target_node_id))) > 1"""
_rule("R13", "CONFLICTING_DEADLINE", lambda n, e: R.differing(n, e, "CONFLICTING_DEADLINE", "HAS_DEADLINE"), _DIFFER.format(e="HAS_DEADLINE"))
_rule("R14", "CONFLICTING_BUDGET", lambda n, e: R.differing(n, e, "CONFLICTING_BUDGET", "HAS_BUDGET"), _DIFFER.format(e="HAS_BUDGET"))


@query("R15_flag_dedup", with_views("kg_edges", """
    SELECT type AS issue_type, min(edge_id) AS flag_id, count(*) AS merged FROM kg_edges GROUP BY type, source_node_id, target_node_id"""))
def _(t):
    e = cut_lineage(views.kg_edges(t).select("edge_id", "type", "source_node_id", "target_node_id"))
    drafts = e.selectExpr("edge_id flag_id", "type issue_type")
    links = e.selectExpr("edge_id flag_id", "explode(array(struct('SOURCE' kind, source_node_id element_id), struct('TARGET' kind, target_node_id element_id))) l").select("flag_id", "l.*")
    return R.dedup_drafts(drafts, links, "flag_id").select("issue_type", "flag_id", "merged")


def _count_sql() -> str:
    from docgraph.plans.registry import SQL  # the rules above, each with its own SQL

    bodies = []
    for name, sql in SQL.items():
        if name[0] == "R" and name[1].isdigit() and not name.startswith("R15"):
            rule = name.split("_", 1)[1].upper()
            bodies.append(f"SELECT '{rule}' AS issue_type, count(*) AS n FROM ({sql[sql.index('SELECT ' + chr(39) + R.SEVERITY[rule]):]})")
    return with_views("kg_nodes kg_edges", " UNION ALL ".join(bodies))


@query("R15_all_flags", _count_sql())
def _(t):
    flags = R.evaluate(t.stored("kg_nodes", views.kg_nodes), t.stored("kg_edges", views.kg_edges))
    return flags.groupBy("issue_type").agg(F.count("*").alias("n"))


@query("D20_flag_counters", with_views("kg_nodes kg_edges", """
    SELECT 'MULTIPLE_LEAD_AGENCIES' AS issue_type, count(*) AS flags, CAST(sum(n) AS BIGINT) AS edges FROM
      (SELECT count(*) AS n FROM kg_edges WHERE type = 'LEADS' GROUP BY target_node_id HAVING count(*) > 1)
    UNION ALL SELECT 'CONFLICTING_RESPONSIBILITY', count(*), CAST(sum(n) AS BIGINT) FROM
      (SELECT count(*) AS n FROM kg_edges WHERE type = 'ASSIGNS_RESPONSIBILITY' GROUP BY target_node_id HAVING count(*) > 1)"""))
def _(t):
    e = views.kg_edges(t)
    flags = R.crowded(e, "MULTIPLE_LEAD_AGENCIES", "LEADS").unionByName(
        R.crowded(e, "CONFLICTING_RESPONSIBILITY", "ASSIGNS_RESPONSIBILITY")
    ).withColumn("flag_id", F.concat_ws("|", "anchor_kind", "anchor_id"))
    per_flag = R.flag_edges(flags, e).groupBy("flag_id").agg(F.count("*").alias("n"))
    return flags.join(per_flag, "flag_id").groupBy("issue_type").agg(F.count("*").alias("flags"), F.sum("n").alias("edges"))


@query("C14_missing_relations", with_views("kg_nodes kg_edges", f"""
    SELECT 'MISSING_LEAD_AGENCY' AS issue_type, count(*) AS n FROM ({_NO_IN.format(t='TASK', e='LEADS')})
    UNION ALL SELECT 'DOSSIER_WITHOUT_RECEIVING_AUTHORITY', count(*) FROM ({_NO_OUT.format(t='DOSSIER', e='SUBMITS')})"""))
def _(t):
    n, e = views.kg_nodes(t), views.kg_edges(t)
    found = R.absent(n, e, "MISSING_LEAD_AGENCY").unionByName(R.absent(n, e, "DOSSIER_WITHOUT_RECEIVING_AUTHORITY"))
    return found.groupBy("issue_type").agg(F.count("*").alias("n"))


@query("C13_edge_endpoints", with_views("kg_nodes kg_edges", """
    SELECT 'MISSING_SOURCE_NODE' AS code, edge_id AS element_id FROM kg_edges WHERE source_node_id NOT IN (SELECT node_id FROM kg_nodes)
    UNION ALL SELECT 'MISSING_TARGET_NODE', edge_id FROM kg_edges WHERE target_node_id NOT IN (SELECT node_id FROM kg_nodes)"""))
def _(t):
    return G.endpoint_issues(views.kg_nodes(t), views.kg_edges(t)).select("code", "element_id")


@query("B4_graph_view", with_views("kg_nodes kg_edges", """
    WITH shown AS MATERIALIZED (SELECT DISTINCT node_id FROM kg_nodes WHERE contains(lower(name), '9'))
    SELECT e.edge_id FROM kg_edges e SEMI JOIN shown s ON e.source_node_id = s.node_id SEMI JOIN shown d ON e.target_node_id = d.node_id"""))
def _(t):
    _, e = G.visible(views.kg_nodes(t), views.kg_edges(t), None, "9")
    return e.select("edge_id")


@query("I12_complex_edges", with_views("kg_edges", """
    SELECT edge_id FROM kg_edges WHERE type IN ('ASSIGNS_RESPONSIBILITY', 'GRANTS_AUTHORITY', 'HAS_BUDGET', 'HAS_DEADLINE', 'REFERENCES', 'REPEALS', 'REPLACES')
      OR (target_node_id, type) IN (SELECT target_node_id, type FROM kg_edges GROUP BY 1, 2 HAVING count(*) > 1)"""))
def _(t):
    return G.complex_edges(views.kg_edges(t)).select("edge_id")


@query("C19_verification_decisions", with_views("kg_edges", """
    SELECT edge_id, CASE WHEN type NOT IN ('ASSIGNS_RESPONSIBILITY', 'HAS_BUDGET', 'HAS_DEADLINE', 'REFERENCES')
        AND count(*) OVER (PARTITION BY target_node_id, type) = 1 THEN 'NOT_REQUIRED'
      WHEN importance = 'HIGH' AND confidence > 0.7 THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS verification_status FROM kg_edges"""))
def _(t):
    e = views.kg_edges(t)
    decisions = e.where("importance <> 'MEDIUM'").selectExpr(
        "edge_id", "importance = 'HIGH' verified", "confidence > 0.7 evidence_sufficient"
    )
    return G.apply_decisions(e, G.complex_edges(e), decisions).select("edge_id", "verification_status")


_KEY = "trim(regexp_replace(replace(lower(strip_accents(name)), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


@query("H5_canonical_keys", with_views("kg_nodes", f"""
    SELECT node_id, name AS canonical_name, type || ':' || {_KEY} AS normalized_key FROM kg_nodes"""))
def _(t):
    noisy = views.kg_nodes(t).withColumn("name", F.concat(F.lit(" ;"), F.replace("name", F.lit(" "), F.lit("  ")), F.lit(" (ABC)")))
    return G.normalize_nodes(noisy).select("node_id", "canonical_name", "normalized_key")


_MERGED = f"""
    keyed AS (SELECT *, type || ':' || {_KEY} AS k FROM kg_nodes),
    merged AS (SELECT document_id, k, min(node_id) AS node_id, max(confidence) AS confidence, max(
        CASE importance WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END) AS r, count(*) AS merged FROM keyed GROUP BY 1, 2),
    mapping AS (SELECT n.document_id, n.node_id, m.node_id AS kept_id FROM keyed n JOIN merged m USING (document_id, k))"""


@query("D11_node_merge", with_views("kg_nodes", f"""WITH {_MERGED}
    SELECT document_id, k AS normalized_key, node_id, round(confidence, 6) AS confidence, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][r + 1] AS importance, merged FROM merged"""))
def _(t):
    m, _ = G.merge_nodes(G.normalize_nodes(views.kg_nodes(t)), ["document_id"])
    return m.select("document_id", "normalized_key", "node_id", F.round("confidence", 6).alias("confidence"), "importance", "merged")


_REMAPPED = _MERGED + """,
    remapped AS (SELECT e.document_id, e.edge_id, e.type, e.importance, e.confidence, coalesce(s.kept_id, e.source_node_id) AS source_node_id,
        coalesce(d.kept_id, e.target_node_id) AS target_node_id FROM kg_edges e
      LEFT JOIN mapping s ON s.document_id = e.document_id AND s.node_id = e.source_node_id
      LEFT JOIN mapping d ON d.document_id = e.document_id AND d.node_id = e.target_node_id)"""


def _remapped(t):
    nodes = cut_lineage(G.normalize_nodes(views.kg_nodes(t)).select("document_id", "node_id", "name", "type", "normalized_key", "confidence", "importance"))
    _, mapping = G.merge_nodes(nodes, ["document_id"])
    return G.remap_edges(views.kg_edges(t), mapping, ["document_id"])


@query("C18_edge_remap", with_views("kg_nodes kg_edges", f"WITH {_REMAPPED} SELECT edge_id, source_node_id, target_node_id FROM remapped"))
def _(t):
    return _remapped(t).select("edge_id", "source_node_id", "target_node_id")


@query("D10_edge_merge", with_views("kg_nodes kg_edges", f"""WITH {_REMAPPED}
    SELECT document_id, source_node_id, target_node_id, type, min(edge_id) AS edge_id, round(max(confidence), 6) AS confidence,
      ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(CASE importance WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END) + 1] AS importance,
      count(*) AS merged FROM remapped GROUP BY 1, 2, 3, 4"""))
def _(t):
    return G.merge_edges(_remapped(t), ["document_id"]).withColumn("confidence", F.round("confidence", 6))


@query("H35_rank_maximum", with_views("kg_edges", """
    SELECT target_node_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(CASE importance WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END) + 1] AS worst
    FROM kg_edges GROUP BY 1"""))
def _(t):
    worst = X.rank_name(F.max(X.rank_of(F.col("importance")))).alias("worst")
    return views.kg_edges(t).groupBy("target_node_id").agg(worst)


@query("D10_property_merge", with_views("kg_edges", """
    SELECT source_node_id, type, CAST(arg_max(confidence, edge_id) AS VARCHAR) AS value FROM kg_edges GROUP BY 1, 2"""))
def _(t):
    e = views.kg_edges(t).withColumn("properties", F.create_map(F.lit("confidence"), F.col("confidence").cast("string")))
    m = G.merged_properties(e, ["source_node_id", "type"], "edge_id", first_wins=False)
    return m.select("source_node_id", "type", "value")


@query("D11_properties_first_wins", with_views("kg_nodes", f"""WITH {_MERGED}
    SELECT document_id, k AS normalized_key, CAST(arg_min(confidence, node_id) AS VARCHAR) AS value FROM keyed GROUP BY 1, 2"""))
def _(t):
    n = G.normalize_nodes(views.kg_nodes(t)).withColumn("properties", F.create_map(F.lit("confidence"), F.col("confidence").cast("string")))
    return G.merged_properties(n, ["document_id", "normalized_key"], "node_id", first_wins=True).select("document_id", "normalized_key", "value")


@query("D11_citation_union", with_views("citations", """
    SELECT owner_id, document_id, chunk_id, page, min(citation_id) AS citation_id FROM citations GROUP BY owner_id, document_id, chunk_id, quote, page"""))
def _(t):
    return G.merge_citations(views.citations(t), ["owner_id"], "citation_id", best=False).drop("quote")


# ------------------------------------------------------------------ extraction

_CHUNKS = """cks AS (
    SELECT o_custkey AS document_id, o_orderkey AS chunk_order, 'Điều ' || (o_orderkey % 100) || '. ' || o_orderpriority || chr(10)
      || CASE WHEN o_orderkey % 3 = 0 THEN 'Bộ số ' || (o_orderkey % 9) || ' chủ trì công việc ' || o_orderkey || '; ' ELSE '' END
      || CASE WHEN o_orderkey % 4 = 0 THEN 'theo Luật Đầu tư số ' || (o_orderkey % 50) || '/2019. ' ELSE '' END
      || CASE WHEN o_orderkey % 2 = 0 THEN 'Thời hạn là ' || (o_orderkey % 90 + 1) || ' ngày' ELSE 'Không áp dụng' END
      || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'Người ký: Ông ' || (o_orderkey % 7) ELSE '' END AS content FROM orders)"""


def _graph_chunks(t):
    return spread(t.orders).selectExpr(
        "o_custkey document_id", "o_orderkey chunk_order", "concat('k-', o_orderkey) chunk_id", "cast(null as string) article",
        "concat('Điều ', o_orderkey % 100, '. ', o_orderpriority, '\n',"
        " if(o_orderkey % 3 = 0, concat('Bộ số ', o_orderkey % 9, ' chủ trì công việc ', o_orderkey, '; '), ''),"
        " if(o_orderkey % 4 = 0, concat('theo Luật Đầu tư số ', o_orderkey % 50, '/2019. '), ''),"
        " if(o_orderkey % 2 = 0, concat('Thời hạn là ', o_orderkey % 90 + 1, ' ngày'), 'Không áp dụng'),"
        " if(o_orderkey % 5 = 0, concat('\nNgười ký: Ông ', o_orderkey % 7), '')) content",
    )


def _extracted(t):
    docs = t.customer.selectExpr("c_custkey document_id", "c_name name")
    return G.merge_mentions(*G.extract(_graph_chunks(t), docs))


@query("I9_extracted_nodes", with_views("lines", "WITH " + _CHUNKS + """,
    facts AS (SELECT *, coalesce(sum(a + r + d) OVER (PARTITION BY document_id ORDER BY chunk_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT document_id, chunk_order, (chunk_order % 3 = 0)::INT AS a, (chunk_order % 4 = 0)::INT AS r, (chunk_order % 2 = 0)::INT AS d FROM cks)),
    names AS (
      SELECT c_custkey AS document_id, 'LEGAL_DOCUMENT' AS type, c_name AS name FROM customer
      UNION SELECT document_id, 'LEGAL_PROVISION', name FROM (
        SELECT document_id, min_by(split_part(content, chr(10), 1), chunk_order) AS name, min(chunk_order) AS o FROM cks GROUP BY document_id, chunk_order % 100)
      UNION SELECT document_id, 'PERSON', 'Ông ' || (chunk_order % 7) FROM cks WHERE chunk_order % 5 = 0
      UNION SELECT document_id, 'AGENCY', 'Bộ số' FROM facts WHERE a = 1
      UNION SELECT document_id, 'TASK', 'chủ trì công việc ' || chunk_order FROM facts WHERE a = 1
      UNION SELECT document_id, 'LEGAL_REFERENCE', 'Luật Đầu tư số ' || (chunk_order % 50) || '/2019' FROM facts WHERE r = 1
      UNION SELECT document_id, 'DEADLINE', (chunk_order % 90 + 1) || ' ngày' FROM facts WHERE d = 1)
    SELECT document_id, type, min(name) AS name FROM names GROUP BY document_id, type, lower(name)"""))
def _(t):
    n, _ = _extracted(t)
    return n.select("document_id", "type", "name")


@query("I9_extracted_edges", with_views("lines", "WITH " + _CHUNKS + """,
    facts AS (SELECT *, coalesce(sum(a + r + d) OVER (PARTITION BY document_id ORDER BY chunk_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT document_id, chunk_order, (chunk_order % 3 = 0)::INT AS a, (chunk_order % 4 = 0)::INT AS r, (chunk_order % 2 = 0)::INT AS d FROM cks)),
    provisions AS (SELECT document_id, p, name, o FROM (
        SELECT document_id, chunk_order % 100 AS p, min_by(split_part(content, chr(10), 1), chunk_order) AS name, min(chunk_order) AS o FROM cks GROUP BY 1, 2)),
    parented AS (SELECT f.*, p.name IS NOT NULL AS has_p, p.p FROM facts f LEFT JOIN provisions p ON p.document_id = f.document_id AND p.p = f.chunk_order % 100),
    edges AS (
      SELECT document_id, 'CONTAINS' AS type, name AS a, '' AS b FROM provisions
      UNION SELECT document_id, 'APPROVES', 'Ông ' || (chunk_order % 7), '' FROM cks WHERE chunk_order % 5 = 0
      UNION SELECT document_id, unnest(['ASSIGNS_RESPONSIBILITY', 'LEADS']), 'công việc', CAST(chunk_order AS VARCHAR) FROM facts WHERE a = 1
      UNION SELECT document_id, 'REFERENCES', CAST(CASE WHEN has_p THEN p END AS VARCHAR), CAST(chunk_order % 50 AS VARCHAR)
        FROM parented WHERE r = 1
      UNION SELECT document_id, 'HAS_DEADLINE', CAST(CASE WHEN has_p THEN p END AS VARCHAR), CAST(chunk_order % 90 AS VARCHAR)
        FROM parented WHERE d = 1)
    SELECT document_id, type, count(*) AS n FROM edges GROUP BY 1, 2"""))
def _(t):
    _, e = _extracted(t)
    return e.groupBy("document_id", "type").agg(F.count("*").alias("n"))


@query("E19_capped_facts", with_views("lines", "WITH " + _CHUNKS + """
    SELECT document_id, CAST(least(sum((chunk_order % 3 = 0)::INT + (chunk_order % 4 = 0)::INT + (chunk_order % 2 = 0)::INT), 7) AS BIGINT) AS facts FROM cks
    WHERE chunk_order % 2 = 0 OR chunk_order % 3 = 0 GROUP BY 1"""))
def _(t):
    c = _graph_chunks(t).withColumn("parent_id", F.lit("root"))
    return G.sentence_facts(c, 7).groupBy("document_id").agg(F.count("*").alias("facts"))


@query("H32_sentence_facts", with_views("lines", "WITH " + _CHUNKS + """
    SELECT 'ASSIGN' AS kind, 'Bộ số ' || (chunk_order % 9) AS value, chunk_order FROM cks WHERE chunk_order % 3 = 0
    UNION ALL SELECT 'REFERENCE', 'Luật Đầu tư số ' || (chunk_order % 50) || '/2019', chunk_order FROM cks WHERE chunk_order % 4 = 0
    UNION ALL SELECT 'DURATION', (chunk_order % 90 + 1) || ' ngày', chunk_order FROM cks WHERE chunk_order % 2 = 0"""))
def _(t):
    c = _graph_chunks(t).withColumn("parent_id", F.lit("root"))
    f = G.sentence_facts(c)
    number = F.regexp_extract("sentence", r"^Bộ số \d+", 0)
    return f.select("kind", F.when(F.col("kind") == "ASSIGN", number).otherwise(F.col("a")).alias("value"), "chunk_order")


# ------------------------------------------------------------------ citations


def _checks(t):
    c = views.citations(t).withColumn(
        "bounding_box", F.expr("struct(x1, 10.0D y1, x1 + 10 x2, 20.0D y2)")
    )
    docs = t.documents.select(F.col("doc_id").alias("document_id"))
    return C.validate(c, views.doc_chunks(t), docs)


@query("I10_citation_checks", with_views("citation_checks", """
    SELECT citation_id, document_id, chunk_id, issues FROM citation_checks"""))
def _(t):
    return _checks(t).select("citation_id", "document_id", "chunk_id", F.array_join("issues", ",").alias("issues"))


@query("C6_citation_joins", with_views("citation_checks", """
    SELECT code, count(*) AS n FROM (SELECT unnest(string_split(issues, ',')) AS code FROM citation_checks WHERE issues <> '') GROUP BY 1"""))
def _(t):
    return _checks(t).select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("C15_box_containment", with_views("citations", """
    SELECT citation_id, page = 0 AND x1 + 10 <= 601 AS inside FROM citations"""))
def _(t):
    c = views.citations(t).selectExpr(
        "citation_id", "page", "struct(x1, 10.0D y1, x1 + 10 x2, 20.0D y2) box",
        "array(struct(0L pageIndex, struct(0.0D x1, 0.0D y1, 600.0D x2, 800.0D y2) bbox)) anchors",
    )
    return c.select("citation_id", C.bbox_inside(F.col("page"), F.col("box"), F.col("anchors")).alias("inside"))


# A flag per cited document (modulo 50) and kind of copy, and some without any citation.
_FLAGS = """flags AS (SELECT 'flag-' || (n % 50) || '-' || copy AS flag_id, CASE WHEN n % 3 = 0 THEN 'MEDIUM' WHEN n % 3 = 1 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
    FROM (SELECT DISTINCT expected_document_id % 50 AS n, copy FROM citations)
    UNION ALL SELECT DISTINCT 'bare-' || (item_id % 9), 'HIGH' FROM benchmark)"""


def _flags(t):
    cited = views.citations(t).selectExpr("expected_document_id % 50 n", "copy").distinct().selectExpr(
        "concat('flag-', n, '-', copy) flag_id", "case n % 3 when 0 then 'MEDIUM' when 1 then 'HIGH' else 'CRITICAL' end severity", "'OPEN' status"
    )
    return cited.unionByName(t.benchmark.selectExpr("concat('bare-', item_id % 9) flag_id", "'HIGH' severity", "'OPEN' status").distinct())


@query("I13_publication_gate", with_views("citation_checks", "WITH " + _FLAGS + """
    SELECT f.flag_id, CASE WHEN severity = 'MEDIUM' THEN 'OPEN' WHEN ok AND severity = 'HIGH' THEN 'VERIFIED' ELSE 'SUPPRESSED' END AS status,
      CASE WHEN severity = 'MEDIUM' THEN NULL WHEN NOT coalesce(ok, false) THEN 'Insufficient or invalid citation evidence'
        WHEN severity = 'HIGH' THEN 'checked' ELSE 'Verifier omitted this flag' END AS verification_reason
    FROM flags f LEFT JOIN (SELECT 'flag-' || (expected_document_id % 50) || '-' || copy AS flag_id, bool_and(issues = '') AS ok FROM citation_checks GROUP BY 1) c USING (flag_id)"""))
def _(t):
    checks = _checks(t).withColumn("owner_id", F.expr("concat('flag-', expected_document_id % 50, '-', copy)"))
    decisions = _flags(t).where("severity = 'HIGH'").selectExpr(
        "flag_id", "true verified", "true evidence_sufficient", "'checked' reason"
    )
    return C.publication_gate(_flags(t), checks, decisions).select("flag_id", "status", "verification_reason")


# A question per citation, wrong copies too.
_QUESTIONS = """qs AS (
    SELECT item_id % 13 AS document_id, citation_id AS question_id, item_id * 5 + copy AS nth, 'flag-' || (item_id % 7) AS issue_type,
      CASE WHEN item_id % 4 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity,
      CASE WHEN item_id % 11 = 0 THEN 'Nội dung' ELSE 'thời hạn ' || item_id END AS subject, 'Vì sao thời gian ' || item_id AS question FROM citations)"""


def _questions(t):
    return views.citations(t).selectExpr(
        "item_id % 13 document_id", "citation_id question_id", "item_id * 5 + copy nth",
        "concat('flag-', item_id % 7) issue_type", "if(item_id % 4 = 0, 'HIGH', 'LOW') severity",
        "if(item_id % 11 = 0, 'Nội dung', concat('thời hạn ', item_id)) related_subject",
        "concat('Vì sao thời gian ', item_id) question", "'thời' reason",
    )


def _question_flags(t):
    return t.benchmark.select("item_id").distinct().selectExpr(
        "item_id % 13 document_id", "concat('flag-', item_id % 7) issue_type", "concat('f-', item_id) flag_id",
        "if(item_id % 4 = 0, 'HIGH', 'LOW') severity", "item_id",
    )


@query("I14_valid_questions", with_views("citation_checks", "WITH " + _QUESTIONS + """,
    worst AS (SELECT item_id % 13 AS document_id, 'flag-' || (item_id % 7) AS issue_type, bool_or(item_id % 4 = 0) AS high FROM benchmark GROUP BY 1, 2)
    SELECT p.document_id, p.question_id, p.severity FROM qs p JOIN worst w USING (document_id, issue_type) JOIN citation_checks c ON c.citation_id = p.question_id
    WHERE p.severity = CASE WHEN w.high THEN 'HIGH' ELSE 'LOW' END AND c.issues = '' AND p.subject <> 'Nội dung' """))
def _(t):
    checks, flags = _checks(t), _question_flags(t)
    backed = flags.join(checks.select("item_id", "chunk_id"), "item_id").select("flag_id", "chunk_id")
    own = checks.withColumn("owner_id", F.col("citation_id"))
    return C.valid_questions(_questions(t), flags.drop("item_id"), backed, own).select("document_id", "question_id", "severity")


@query("F11_first_questions", with_views("citations", "WITH " + _QUESTIONS + """
    SELECT document_id, question_id FROM qs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY nth) <= 5"""))
def _(t):
    from docgraph.operators.ordered import top_per_key

    return top_per_key(_questions(t), ["document_id"], ["nth"], 5).select("document_id", "question_id")


@query("C21_question_flag_severity", with_views("citations", "WITH " + _QUESTIONS + """,
    worst AS (SELECT item_id % 13 AS document_id, 'flag-' || (item_id % 7) AS issue_type, bool_or(item_id % 4 = 0) AS high FROM benchmark GROUP BY 1, 2)
    SELECT question_id, severity = CASE WHEN high THEN 'HIGH' ELSE 'LOW' END AS agrees FROM qs JOIN worst USING (document_id, issue_type)"""))
def _(t):
    q, f = _questions(t), _question_flags(t)
    worst = f.groupBy("document_id", "issue_type").agg(F.max(X.rank_of(F.col("severity"))).alias("w"))
    return q.join(worst, ["document_id", "issue_type"]).select(
        "question_id", (X.rank_of(F.col("severity")) == F.col("w")).alias("agrees")
    )


@query("G5_evidence_subset", with_views("citations", """
    SELECT owner_id, count(*) FILTER (WHERE page <> 0) = 0 AS all_on_first_page FROM citations GROUP BY 1"""))
def _(t):
    # Set difference as an anti join: owners with a citation outside the allowed set.
    c = views.citations(t)
    outside = c.join(c.where("page = 0").select("citation_id"), "citation_id", "left_anti").select("owner_id").distinct()
    return c.select("owner_id").distinct().join(outside.withColumn("bad", F.lit(True)), "owner_id", "left").select(
        "owner_id", F.col("bad").isNull().alias("all_on_first_page")
    )


@query("I15_summary_gate", with_views("citation_checks", """
    SELECT 'flag-' || i AS item_id, CASE WHEN i = 8 THEN NULL WHEN c.codes IS NULL THEN 'SUMMARY_ITEM_REQUIRES_CITATION' WHEN c.codes = '' THEN NULL ELSE c.codes END AS rejected_reason
    FROM range(10) r(i) LEFT JOIN (SELECT owner_id, coalesce(string_agg(DISTINCT code, '; ' ORDER BY code) FILTER (code <> ''), '') AS codes
      FROM (SELECT owner_id, unnest(string_split(issues, ',')) AS code FROM citation_checks) GROUP BY 1) c ON c.owner_id = 'flag-' || i
    WHERE i IN (SELECT item_id % 10 FROM benchmark)"""))
def _(t):
    items = t.benchmark.selectExpr("item_id % 10 i").distinct().selectExpr(
        "concat('flag-', i) item_id", "i = 8 system_metadata", "'DOCUMENT_INFORMATION' category"
    )
    return C.summary_gate(items, _checks(t)).select("item_id", "rejected_reason")


@query("D18_rejected_items", with_views("citation_checks", """
    SELECT document_id % 4 AS summary_id, count(*) FILTER (issues <> '') AS rejected,
      CASE WHEN count(*) FILTER (issues <> '') > 0 THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS status FROM citation_checks GROUP BY 1"""))
def _(t):
    bad = F.count_if(F.size("issues") > 0)
    return _checks(t).groupBy((F.col("document_id") % 4).alias("summary_id")).agg(bad.alias("rejected")).withColumn(
        "status", F.when(F.col("rejected") > 0, "NEEDS_REVIEW").otherwise("COMPLETED")
    )


@query("D19_citation_kpis", with_views("citation_checks", """
    SELECT count(*) AS citations, round(avg(CASE WHEN issues = '' THEN 1.0 ELSE 0.0 END), 6) AS valid_share,
      (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND n_chars >= 500) AS tp,
      (SELECT round(2.0 * count(*) FILTER (quality = 1 AND n_chars >= 500) / (count(*) FILTER (quality = 1) + count(*) FILTER (n_chars >= 500)), 6)
        FROM labels JOIN documents USING (doc_id)) AS f1 FROM citation_checks"""))
def _(t):
    rated = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").agg(
        F.count_if(F.expr("quality = 1 and n_chars >= 500")).alias("tp"), F.count_if(F.expr("quality = 1")).alias("p"),
        F.count_if(F.expr("n_chars >= 500")).alias("c"),
    )
    kpi = _checks(t).agg(
        F.count("*").alias("citations"), F.round(F.avg(F.when(F.size("issues") == 0, 1.0).otherwise(0.0)), 6).alias("valid_share")
    )
    # Both sides are one row each.
    both = kpi.withColumn("one", F.lit(1)).join(rated.withColumn("one", F.lit(1)), "one")
    return both.selectExpr("citations", "valid_share", "tp", "round(2.0D * tp / (p + c), 6) f1")


@query("G3_citation_union", with_views("citations", """
    SELECT owner_id, document_id, chunk_id, page, min_by(citation_id, (-source_confidence, citation_id)) AS citation_id
    FROM citations GROUP BY owner_id, document_id, chunk_id, quote, page"""))
def _(t):
    return G.merge_citations(views.citations(t), ["owner_id"], "citation_id", best=True).drop("quote")


@query("C24_citations_of_owners", with_views("citations", """
    SELECT citation_id, owner_id FROM citations WHERE owner_id IN ('flag-1', 'flag-3', 'flag-5')"""))
def _(t):
    c = views.citations(t).withColumn("owner_type", F.lit("RED_FLAG"))
    owners = c.where("cast(split(owner_id, '-')[1] as int) % 2 = 1").select("owner_type", "owner_id")
    return C.citations_of(c, owners).select("citation_id", "owner_id")


@query("C17_evidence_chunks", with_views("citations blocks", """
    SELECT document_id, order_index FROM blocks b WHERE document_id IN (SELECT document_id FROM citations) AND page_index = 0
    UNION ALL SELECT document_id, order_index FROM blocks WHERE document_id NOT IN (SELECT b.document_id FROM blocks b JOIN citations c ON b.document_id = c.document_id AND b.page_index = 0)"""))
def _(t):
    chunks = views.blocks(t).select("document_id", "order_index", F.concat_ws("-", "document_id", "order_index").alias("chunk_id"), "page_index")
    cited = chunks.join(views.citations(t).select("document_id").distinct(), "document_id", "left_semi").where("page_index = 0")
    return C.evidence_chunks(chunks, cited).select("document_id", "order_index")


@query("C16_region_text", with_views("legal_blocks", """
    SELECT 'r-' || r.document_id || '-' || r.page_index AS region_id, coalesce(t.txt, '') AS text, round(coalesce(t.c, 0), 9) AS average_confidence
    FROM (SELECT DISTINCT document_id, page_index FROM legal_blocks) r
    LEFT JOIN (SELECT document_id, page_index, string_agg(text, chr(10) ORDER BY order_index) AS txt, avg(confidence) AS c
      FROM legal_blocks WHERE y1 + 12 >= 100 AND y1 <= 300 GROUP BY 1, 2) t USING (document_id, page_index)"""))
def _(t):
    b = views.legal_blocks(t)
    regions = b.select("document_id", "page_index").distinct().selectExpr(
        "document_id", "page_index", "concat('r-', document_id, '-', page_index) region_id",
        "struct(0.0D x1, 100.0D y1, 50.0D x2, 300.0D y2) region",
    )
    out = C.region_summary(C.region_text(b, regions), regions)
    return out.select("region_id", "text", F.round("average_confidence", 9).alias("average_confidence"))


@query("C5_flags_of_current_graph", with_views("kg_edges", """
    SELECT e.target_node_id AS anchor_id, count(*) AS n FROM kg_edges e WHERE type = 'LEADS' AND document_id % 2 = 0 GROUP BY 1 HAVING count(*) > 1"""))
def _(t):
    e = views.kg_edges(t)
    versions = e.select("document_id").distinct().selectExpr("document_id", "document_id % 2 = 0 is_current").where("is_current")
    flags = e.where("type = 'LEADS'").groupBy("document_id", F.col("target_node_id").alias("anchor_id")).agg(F.count("*").alias("n"))
    shown = flags.withColumn("status", F.when(F.col("n") > 1, "OPEN").otherwise("SUPPRESSED")).where("status <> 'SUPPRESSED'")
    return shown.join(versions, "document_id").select("anchor_id", "n")


@query("I11_graph_validation", with_views("kg_nodes kg_edges", """
    WITH good AS MATERIALIZED (SELECT node_id FROM kg_nodes WHERE importance NOT IN ('HIGH', 'CRITICAL') OR confidence >= 0.7)
    SELECT edge_id FROM kg_edges e SEMI JOIN good s ON e.source_node_id = s.node_id SEMI JOIN good d ON e.target_node_id = d.node_id
    WHERE e.importance NOT IN ('HIGH', 'CRITICAL') OR e.confidence >= 0.7"""))
def _(t):
    n, e = t.stored("kg_nodes", views.kg_nodes), t.stored("kg_edges", views.kg_edges)
    elements = n.selectExpr("'NODE' element_type", "node_id element_id", "importance", "confidence").unionByName(
        e.selectExpr("'EDGE' element_type", "edge_id element_id", "importance", "confidence")
    )
    # Elements of some confidence carry one valid citation, the others none.
    checks = elements.where("confidence >= 0.7").selectExpr("element_id owner_id", "cast(array() as array<string>) issues")
    # Edges without an end (C13) are left out by the ends of the kept ones, without a join of their own.
    _, kept = G.keep_valid(n, e, G.citation_issues(elements, checks))
    return kept.select("edge_id")
