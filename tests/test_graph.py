"""Graph, rules, citations and answers on the small given examples."""

from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import citations as C
from docgraph.operators import graph as G
from docgraph.operators import retrieval as Q
from docgraph.operators import rules as R

NODE = "node_id string, type string, name string, amount string, value string, resolved string, target_type string, importance string, confidence double"
EDGE = "edge_id string, source_node_id string, target_node_id string, type string, importance string, confidence double"


def node(i, kind, name="n", **kw):
    return (i, kind, name, kw.get("amount"), kw.get("value"), kw.get("resolved"), kw.get("target"), kw.get("importance", "MEDIUM"), kw.get("confidence", 0.9))


def flags(spark, nodes, edges):
    found = R.evaluate(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    return sorted(r.issue_type for r in found.collect())


def test_rules(spark):
    assert flags(spark, [node("t", "TASK")], []) == ["MISSING_DEADLINE", "MISSING_LEAD_AGENCY", "MISSING_RESPONSIBLE_ACTOR"]
    assert flags(spark, [node("b", "BUDGET", amount="10")], []) == ["MISSING_FUNDING_SOURCE"]
    assert flags(spark, [node("r", "LEGAL_REFERENCE", resolved="false")], [("e", "x", "r", "REFERENCES", "LOW", 0.9)]) == ["BROKEN_LEGAL_REFERENCE"]
    led = [("e1", "a", "t", "LEADS", "LOW", 0.9), ("e2", "b", "t", "LEADS", "LOW", 0.9), ("e3", "t", "d", "HAS_DEADLINE", "LOW", 0.9)]
    got = flags(spark, [node("t", "TASK"), node("d", "DEADLINE")], led)
    assert got == ["DEADLINE_WITHOUT_OUTPUT", "MISSING_RESPONSIBLE_ACTOR", "MULTIPLE_LEAD_AGENCIES"]
    assert flags(spark, [], led[:2]) == ["MULTIPLE_LEAD_AGENCIES"]  # the target may be missing


def test_names_merge(spark):
    df = spark.createDataFrame([("1", "AGENCY", "BỘ TÀI CHÍNH (BTC)", 0.8, "LOW"), ("2", "AGENCY", "Bo Tai Chinh", 0.9, "HIGH")], "node_id string, type string, name string, confidence double, importance string").withColumn("g", F.lit(1))
    merged, mapping = G.merge_nodes(G.normalize_nodes(df), ["g"])
    (m,) = merged.collect()
    assert (m.node_id, m.confidence, m.importance, m.merged) == ("1", 0.9, "HIGH", 2)
    assert {(r.node_id, r.kept_id) for r in mapping.collect()} == {("1", "1"), ("2", "1")}


def test_missing_endpoint(spark):
    n = spark.createDataFrame([node("a", "AGENCY")], NODE)
    e = spark.createDataFrame([("e", "a", "gone", "LEADS", "LOW", 0.9)], EDGE)
    assert [r.code for r in G.endpoint_issues(n, e).collect()] == ["MISSING_TARGET_NODE"]


def test_extraction_and_cap(spark):
    text = "Điều 1. Phạm vi\nBộ Tài chính chủ trì lập báo cáo trong vòng 30 ngày theo Luật Đầu tư số 12/2019.\nNgười ký: Ông A"
    chunks = spark.createDataFrame([("d", "k1", 0, text, None)], "document_id string, chunk_id string, chunk_order long, content string, article string")
    docs = spark.createDataFrame([("d", "Tên")], "document_id string, name string")
    nodes, edges = G.merge_mentions(*G.extract(chunks, docs))
    assert sorted(r.type for r in nodes.collect()) == ["AGENCY", "DEADLINE", "LEGAL_DOCUMENT", "LEGAL_PROVISION", "LEGAL_REFERENCE", "PERSON", "TASK"]
    kinds = sorted(r.type for r in edges.collect())
    assert kinds == ["APPROVES", "ASSIGNS_RESPONSIBILITY", "CONTAINS", "HAS_DEADLINE", "LEADS", "REFERENCES"]
    held = G.sentence_facts(chunks.withColumn("parent_id", F.lit("p")), 2).collect()
    assert [r.kind for r in held] == ["ASSIGN", "REFERENCE"]


def test_citations(spark):
    chunk = spark.createDataFrame(
        [("chunk-a", "doc-a", "Bộ  Tài chính\nchủ trì “việc”", "x", "Điều 7", "Khoản 1", None, 2, 2, [(2, (0.0, 0.0, 10.0, 10.0))])],
        "chunk_id string, document_id string, content string, normalized_content string, article string, clause string, point string, pdf_page_start int, pdf_page_end int, bounding_boxes array<struct<pageIndex:int,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>")
    rows = [("ok", "doc-a", "bộ tài chính chủ trì", 2, "ĐIỀU 7"), ("cross", "doc-b", "Bộ Tài chính", 2, None), ("quote", "doc-a", "không có", 2, None), ("page", "doc-a", "Bộ Tài chính", 5, "Điều 8")]
    cited = spark.createDataFrame([(i, d, "chunk-a", q, p, a, "doc-a") for i, d, q, p, a in rows], "id string, document_id string, chunk_id string, quote string, page int, article string, expected_document_id string")
    docs = spark.createDataFrame([("doc-a",), ("doc-b",)], "document_id string")
    got = {r.id: r.issues for r in C.validate(cited, chunk, docs).collect()}
    assert got == {"ok": [], "cross": ["CROSS_DOCUMENT_CITATION", "CHUNK_DOCUMENT_MISMATCH"], "quote": ["QUOTE_NOT_FOUND"], "page": ["ARTICLE_MISMATCH", "PAGE_OUT_OF_RANGE"]}


def test_rerank_falls_back_and_status(spark):
    hits = spark.createDataFrame([("q", f"c{i}", 0.9 - i / 10, i + 1) for i in range(3)], "question_id string, chunk_id string, score double, rank int")
    asked = spark.createDataFrame([("q", "thời hạn", "FACTUAL"), ("none", "x", "FACTUAL")], "question_id string, question string, intent string")
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", f"Thời hạn {30 + 15 * i} ngày là") for i in range(3)], "chunk_id string, document_id string, content string")
    nothing = spark.createDataFrame([], "question_id string, chunk_id string, rerank_score double")
    kept = Q.rerank(hits, chunks, asked, nothing)
    assert [r.chunk_id for r in kept.orderBy("rank").collect()] == ["c0", "c1", "c2"] and not kept.first().available
    items = kept.join(chunks, "chunk_id").withColumn("topic", F.lit("Điều 3"))
    clash = Q.conflicts(items, asked)
    assert clash.first()["values"] == ["30 ngày", "45 ngày", "60 ngày"]
    got = {r.question_id: r for r in Q.answer_status(items, clash, asked).collect()}
    assert (got["q"].answer_status, got["q"].confidence) == ("CONFLICTING", 0.56)
    assert got["none"].answer_status == "NOT_FOUND"


def test_zero_scores_fill_the_top_k(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", i, t) for i, t in enumerate(["x y", "thời hạn", "z"])], "chunk_id string, document_id string, order_index int, content string")
    asked = spark.createDataFrame([("q", "THỜI HẠN")], "question_id string, question string")
    got = Q.lexical_top_k(chunks, asked, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1", "c0", "c2"] and got[0].score > 1.1 and got[1].score == 0


def test_text_functions(spark):
    row = spark.createDataFrame([("  Á b\t c ", "Máy [Nguồn 2] tốt .", "a.b.docx")], "a string, b string, c string").select(
        X.normalize_content(F.col("a")), X.strip_markers(F.col("b")), X.cited_numbers(F.col("b")), X.display_stem(F.col("c")),
        X.slug(F.lit("Đường  Ớt-1"), "-")).first()
    assert tuple(row) == ("Á b c", "Máy tốt.", [2], "a.b", "duong-ot-1")


def test_facts_are_found_before_their_parents(spark, monkeypatch):
    """Nodes need no parent: what is written for them carries the key of the article, and edges find the parent by it."""
    from docgraph.operators import graph as G

    chunks = spark.createDataFrame(
        [("d", 1, "k1", None, "Điều 1. Mở đầu\nBộ Tài chính chủ trì lập báo cáo; theo Luật Đầu tư số 5/2019. Thời hạn là 30 ngày"), ("d", 2, "k2", None, "theo luật đầu tư SỐ 5/2019."), ("none", 3, "k3", None, "Thời hạn là 9 ngày")],
        "document_id string, chunk_order long, chunk_id string, article string, content string",
    )
    docs = spark.createDataFrame([("d", "Tên")], "document_id string, name string")
    written = []
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(df.columns) or df.cache())
    nodes, edges = G.extract(chunks, docs)
    merged, _ = G.merge_mentions(nodes, edges)
    assert not any("root_id" in columns for columns in written)
    ids = {r.node_id: r.type for r in nodes.collect()}
    assert {r.node_id: r.type for r in merged.collect()} == ids and "none" not in {r.document_id for r in merged.collect()}
    refs = [(ids[r.source_node_id], r.chunk_id) for r in edges.where("type = 'REFERENCES'").collect()]
    assert sorted(refs) == [("LEGAL_DOCUMENT", "k2"), ("LEGAL_PROVISION", "k1")]
    source = [ids[r.source_node_id] for r in edges.where("type = 'HAS_DEADLINE'").collect()]
    assert source == ["LEGAL_PROVISION"]
    assert "node_key" in nodes.columns


def test_edges_without_an_end_need_no_join_of_their_own(spark, monkeypatch):
    """I11 keeps the edges that it keeps with the issues of both ends."""
    from docgraph.operators import graph as G
    from docgraph.plans import all_queries
    from docgraph.sources import views
    from docgraph.sources.tables import Tables

    n, e = views.kg_nodes(Tables(spark, "/root/testdata/sf0.001")), views.kg_edges(Tables(spark, "/root/testdata/sf0.001"))
    low = n.selectExpr("'NODE' element_type", "node_id element_id", "importance", "confidence").unionByName(e.selectExpr("'EDGE' element_type", "edge_id element_id", "importance", "confidence"))
    low = low.where("importance in ('HIGH', 'CRITICAL') and confidence < 0.7").selectExpr("'IMPORTANT_ELEMENT_REQUIRES_CITATION' code", "element_type", "element_id")
    _, want = G.keep_valid(n, e, G.endpoint_issues(n, e).drop("message").unionByName(low))
    want = sorted(r.edge_id for r in want.collect())
    monkeypatch.setattr(G, "endpoint_issues", None)
    got = all_queries()[0]["I11_graph_validation"](spark, "/root/testdata/sf0.001")
    assert sorted(r.edge_id for r in got.collect()) == want and want
