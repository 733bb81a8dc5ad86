"""Derived inputs: document-domain tables computed from the given Parquet tables.

``VIEWS_SQL`` states the same tables in plain SQL for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.sources.tables import Tables

PAGE_LINES = 20


def blocks(t: Tables) -> DataFrame:
    """V1: one row per text line; 20 lines make a page."""
    lines = t.documents.select(
        F.col("doc_id").alias("document_id"), "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text")
    )
    return lines.selectExpr(
        "document_id", "lang", f"cast(pos div {PAGE_LINES} as bigint) page_index",
        "cast(pos as bigint) order_index", "text",
        "0.5 + (document_id * 7 + pos * 13) % 50 / 100.0D confidence",
    )


#: Bytes of line items, as stored, that one task takes: some 200,000 rows.
LINES_PER_TASK = 4 << 20


def tasks_of(t: Tables) -> int:
    """Tasks among which line items are dealt: by their size, and at least the session's."""
    size = int(str(t.lineitem._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(-(-size // LINES_PER_TASK), int(t.spark.conf.get("spark.sql.shuffle.partitions")))


def lines(t: Tables) -> DataFrame:
    """Line items, one row per order and line number (the given key repeats).

    Dealt out by order alone, which serves the joins with orders too.
    """
    return t.lineitem.repartition(tasks_of(t), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("l_quantity"),
        *[F.max(c).alias(c) for c in (
            "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")],
    )


def legal_blocks(t: Tables) -> DataFrame:
    """V2: a regulation text per customer; orders are articles, line items clauses."""
    head = t.customer.selectExpr(
        "c_custkey",
        "0L page_index",
        "explode(array("
        " struct(0L o, concat('QUY ĐỊNH VỀ ', c_mktsegment) text),"
        " struct(1L o, concat('Căn cứ Luật số ', c_custkey, '/2019') text),"
        " struct(2L o, concat('CHƯƠNG ', c_nationkey + 1, '. Quy định chung') text),"
        " struct(3L o, if(c_custkey % 2 = 0, '   ', 'Lời dẫn của chương') text))) b",
    ).selectExpr("c_custkey", "page_index", "b.o order_index", "b.text text")
    tail = t.customer.where("c_custkey % 5 = 0").selectExpr(
        "c_custkey", "1000000L page_index",
        "explode(array(struct(0L o, 'PHỤ LỤC I' text), struct(1L o, 'MẪU SỐ 01/BC Báo cáo' text),"
        " struct(2L o, concat('1) Nội dung mẫu ', c_custkey) text), struct(3L o, 'Nơi nhận: như trên' text))) b",
    ).selectExpr("c_custkey", "page_index", "b.o order_index", "b.text text")
    articles = t.orders.selectExpr(
        "o_custkey c_custkey", "1 + o_orderkey div 1000 page_index",
        "(o_orderkey % 1000) * 64 order_index", "concat('Điều ', o_orderkey, '. ', o_orderpriority) text",
    )
    items = (
        lines(t).join(t.orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(
            "o_custkey c_custkey", "1 + o_orderkey div 1000 page_index",
            "(o_orderkey % 1000) * 64 + 4 * l_linenumber base",
            "explode(filter(array("
            " struct(0L o, concat(l_linenumber, '. Số lượng ', cast(l_quantity as int),"
            "   ' đơn vị, thời hạn ', cast(l_quantity as int), ' ngày') text),"
            " if(l_returnflag = 'R', struct(1L o, 'a) Hoàn trả cho bên giao' text), null),"
            " if(l_linestatus = 'O', struct(2L o, concat('Nội dung tiếp theo của lô ', l_partkey) text), null)"
            "), b -> b is not null)) b",
        )
        .selectExpr("c_custkey", "page_index", "base + b.o order_index", "b.text text")
    )
    rows = head.unionByName(articles).unionByName(items).unionByName(tail)
    return rows.selectExpr(
        "c_custkey document_id",
        "page_index", "order_index", "concat_ws('-', 'b', c_custkey, page_index, order_index) block_id",
        "'PARAGRAPH' block_type", "text",
        "if(order_index % 7 = 3, null, 0.5 + (order_index % 50) / 100.0D) confidence",
        "struct(10.0D x1, cast(order_index % 700 as double) y1, 500.0D x2,"
        " cast(order_index % 700 + 12 as double) y2) bbox",
    )


def reg_versions(t: Tables) -> DataFrame:
    """V3: yearly versions of a regulation per part; families of ten share a workspace."""
    facts = (
        t.lineitem.selectExpr("l_partkey", "l_suppkey", "l_quantity", "year(l_shipdate) y")
        .join(t.supplier.select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey"))
        .groupBy("l_partkey", "y")
        .agg(F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("n"), F.min("s_name").alias("s"))
    )
    return facts.selectExpr(
        "concat('v-', l_partkey, '-', y) version_id", "l_partkey family_id", "l_partkey div 10 workspace_id",
        "concat('doc-', l_partkey, '-', y) document_id", "concat('Quy định số ', l_partkey, ' năm ', y) title",
        "concat(l_partkey, '/', y, '/QĐ-UBND') document_number", "'QUYET_DINH' document_type",
        "make_date(y, 1, 1) effective_date", "make_date(y - 1, 12, 1) issued_date", "cast(y as int) year",
        "case l_partkey % 3 when 0 then 'Tài chính' when 1 then 'Đầu tư công' else 'Đất đai' end domain",
        "concat_ws('\n', 'Phần mở đầu của văn bản', 'Điều 1. Ngưỡng',"
        " concat('Ngưỡng phê duyệt: ', 10 * (q div 10), ' triệu đồng'), 'Điều 2: Thực hiện',"
        " if(n > 1, concat('Thời hạn báo cáo: ', n, ' ngày'), null),"
        " 'Khoản 1. Thẩm quyền', concat('Đơn vị phê duyệt: ', s),"
        " if(l_partkey % 4 = 0, concat('Theo Luật số ', l_partkey % 50, '/', y, ' và Nghị định ', y, '.'), null)"
        ") raw_text",
    )


def projects(t: Tables) -> DataFrame:
    """V4: a project per customer."""
    return t.customer.selectExpr(
        "c_custkey project_id", "c_custkey div 10 workspace_id", "concat('Dự án ', c_custkey) name",
        "case c_mktsegment when 'BUILDING' then 'Chờ thẩm định' when 'MACHINERY' then 'In progress'"
        " else 'Hoàn thành' end status",
        "case c_custkey % 3 when 0 then 'Tai chinh' when 1 then 'Đầu tư công' else 'Y tế' end domain",
        "if(c_acctbal > 3000, array('Ngân sách địa phương', 'Vốn vay'), array('Vốn vay')) budget_sources",
        "case c_nationkey % 3 when 0 then 'Phòng Kế hoạch' when 1 then 'Phòng Tài chính' else 'Văn phòng' end lead_department",
        "if(c_custkey % 2 = 0, array('Phòng Tài chính', 'Phòng Tài chính'), array('Văn phòng')) coordinating_departments",
        "array(concat('Quyết định ', c_custkey, '/1997/QĐ-UBND'), concat('Luật ', c_nationkey)) legal_bases",
        "if(c_custkey % 4 = 0, array('Mục đầu tư'), array()) sections",
    )


def kg_nodes(t: Tables) -> DataFrame:
    """V5: task, agency, deadline, budget, funding and reference nodes."""
    none = "cast(null as string)"
    tasks = t.orders.selectExpr(
        "concat('task-', o_orderkey) node_id", "'TASK' type", "concat('Nhiệm vụ ', o_orderkey) name",
        f"{none} amount", f"{none} value", f"{none} resolved", f"{none} target_type",
        "case o_orderkey % 5 when 0 then 'CRITICAL' when 1 then 'HIGH' else 'MEDIUM' end importance",
        "0.5 + (o_orderkey % 50) / 100.0D confidence", "o_custkey document_id",
    )
    parties = t.customer.selectExpr(
        "explode(array(struct('agency' p, 'AGENCY' type, 'Cơ quan ' n),"
        " struct('dossier' p, 'DOSSIER' type, 'Hồ sơ ' n))) k", "c_custkey",
    ).selectExpr(
        "concat(k.p, '-', c_custkey) node_id", "k.type type", "concat(k.n, c_custkey) name",
        f"{none} amount", f"{none} value", f"{none} resolved", f"{none} target_type",
        "'MEDIUM' importance", "0.9D confidence", "c_custkey document_id",
    )
    pairs = lines(t).join(t.orders, F.expr("l_orderkey = o_orderkey"))
    deadlines = pairs.selectExpr(
        "l_orderkey", "date_format(l_shipdate, 'yyyy-MM') m", "o_custkey"
    ).distinct().selectExpr(
        "concat('deadline-', l_orderkey, '-', m) node_id", "'DEADLINE' type", "concat('Tháng ', m) name",
        f"{none} amount", "if(l_orderkey % 2 = 0, m, '') value", f"{none} resolved", f"{none} target_type",
        "'MEDIUM' importance", "0.82D confidence", "o_custkey document_id",
    )
    budgets = t.part.selectExpr(
        "concat('budget-', p_partkey) node_id", "'BUDGET' type", "concat('Ngân sách ', p_partkey % 50) name",
        "case when p_partkey % 10 = 0 then null when p_partkey % 10 = 1 then ''"
        " else cast(cast(p_retailprice as int) as string) end amount",
        f"{none} value", f"{none} resolved", f"{none} target_type",
        "if(p_size > 40, 'CRITICAL', 'LOW') importance", "0.6 + (p_size % 40) / 100.0D confidence", "-1L document_id",
    )
    funds = t.supplier.selectExpr(
        "concat('fund-', s_suppkey) node_id", "'FUNDING_SOURCE' type", "s_name name",
        f"{none} amount", f"{none} value", f"{none} resolved", f"{none} target_type",
        "'LOW' importance", "0.7D confidence", "-1L document_id",
    )
    refs = pairs.where("l_returnflag = 'R'").selectExpr(
        "concat('ref-', l_orderkey, '-', l_linenumber) node_id", "'LEGAL_REFERENCE' type",
        "concat('Luật số ', l_partkey % 20) name", f"{none} amount", f"{none} value",
        "if(l_partkey % 3 = 0, 'false', 'true') resolved", "if(l_partkey % 2 = 0, 'FORM', 'LAW') target_type",
        "'MEDIUM' importance", "0.9D confidence", "o_custkey document_id",
    )
    out = tasks
    for part in (parties, deadlines, budgets, funds, refs):
        out = out.unionByName(part)
    return out


def kg_edges(t: Tables) -> DataFrame:
    lead = t.orders.where("substring(o_orderpriority, 1, 1) in ('1', '2')").selectExpr(
        "concat('e-lead-', o_orderkey) edge_id", "concat('agency-', o_custkey) source_node_id",
        "concat('task-', o_orderkey) target_node_id", "'LEADS' type", "'HIGH' importance",
        "0.78D confidence", "o_custkey document_id",
    )
    assign = t.orders.where("substring(o_orderpriority, 1, 1) in ('2', '3')").selectExpr(
        "concat('e-assign-', o_orderkey) edge_id", "concat('agency-', o_custkey) source_node_id",
        "concat('task-', o_orderkey) target_node_id", "'ASSIGNS_RESPONSIBILITY' type", "'MEDIUM' importance",
        "0.72D confidence", "o_custkey document_id",
    )
    produce = t.orders.where("o_orderstatus = 'F'").selectExpr(
        "concat('e-produce-', o_orderkey) edge_id", "concat('task-', o_orderkey) source_node_id",
        "concat('output-', o_orderkey) target_node_id", "'PRODUCES' type", "'MEDIUM' importance",
        "0.8D confidence", "o_custkey document_id",
    )
    submit = t.customer.where("c_acctbal > 0").selectExpr(
        "concat('e-submit-', c_custkey) edge_id", "concat('dossier-', c_custkey) source_node_id",
        "concat('agency-', c_custkey) target_node_id", "'SUBMITS' type", "'MEDIUM' importance",
        "0.8D confidence", "c_custkey document_id",
    )
    fund = t.part.where("p_partkey % 4 <> 0").selectExpr(
        "concat('e-fund-', p_partkey) edge_id", "concat('budget-', p_partkey) source_node_id",
        "concat('fund-', p_size) target_node_id", "'HAS_FUNDING_SOURCE' type", "'LOW' importance",
        "0.7D confidence", "-1L document_id",
    )
    pairs = lines(t).join(t.orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "o_custkey", "explode(filter(array("
        " struct('HAS_DEADLINE' type, concat('task-', l_orderkey) s, concat('deadline-', l_orderkey, '-',"
        "   date_format(l_shipdate, 'yyyy-MM')) d, 'dl' k),"
        " if(l_linenumber <= 2, struct('HAS_BUDGET' type, concat('task-', l_orderkey) s,"
        "   concat('budget-', l_partkey) d, 'bg' k), null),"
        " if(l_returnflag = 'R' and l_tax > 0.02, struct('REFERENCES' type, concat('task-', l_orderkey) s,"
        "   concat('ref-', l_orderkey, '-', l_linenumber) d, 'rf' k), null),"
        " if(l_returnflag = 'R' and l_linenumber = 1, struct('LEADS' type, concat('agency-s', l_suppkey) s,"
        "   concat('task-', l_orderkey) d, 'ld' k), null),"
        " if(l_linestatus = 'F' and l_linenumber = 2, struct('ASSIGNS_RESPONSIBILITY' type,"
        "   concat('agency-', l_suppkey) s, concat('task-', l_orderkey) d, 'as' k), null)"
        "), e -> e is not null)) e",
        "l_orderkey", "l_linenumber", "l_discount",
    )
    items = pairs.selectExpr(
        "concat('e-', e.k, '-', l_orderkey, '-', l_linenumber) edge_id", "e.s source_node_id",
        "e.d target_node_id", "e.type type",
        "case when l_discount > 0.085 then 'CRITICAL' when l_discount > 0.065 then 'HIGH' else 'MEDIUM' end importance",
        "round(1 - 4 * l_discount, 4) confidence", "o_custkey document_id",
    )
    out = lead
    for part in (assign, produce, submit, fund, items):
        out = out.unionByName(part)
    return out


def job_events(t: Tables) -> DataFrame:
    """V6: a processing job per user and day; events are its transitions."""
    return t.events.selectExpr(
        "concat('job-', user_id, '-', date_format(ts, 'MMdd')) job_id", "user_id document_id", "event_id seq", "ts",
        "case event_type when 'signup' then 'QUEUED' when 'view' then 'PROCESSING' when 'click' then 'PROCESSING'"
        " when 'purchase' then 'COMPLETED' else 'FAILED' end status",
        "cast(get_json_object(props, '$.k') as int) + if(event_id % 50 = 0, 60, 0) progress",
        "case event_type when 'view' then 'EXTRACTING_TEXT' when 'click' then 'CREATING_CHUNKS'"
        " when 'purchase' then 'COMPLETED' else 'UPLOADED' end current_step",
        "cast(value as int) current_page", "if(event_id % 3 = 0, 30, null) total_pages",
        "if(event_type = 'error' and event_id % 4 <> 0, 'failure', null) error_message",
        "cast(date_format(ts, 'dd') as int) attempt",
    )


def login_events(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id", "user_id", "ts", "event_type in ('purchase') or event_id % 11 = 0 ok",
    )


def audit_events(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id", "ts created_at", "user_id actor_user_id", "user_id % 25 commune_id",
        "upper(event_type) action", "if(event_type = 'error', 'DENIED', 'SUCCESS') result",
        "map('k', get_json_object(props, '$.k'), 'Access_Token', concat('t-', event_id),"
        " 'note', repeat(concat(event_type, ' '), 300)) metadata",
    )


def citations(t: Tables) -> DataFrame:
    """V9: benchmark passages cited from documents; ``copy`` 0 is right where the passage is found, 1 to 4 name a wrong document, page, article or chunk."""
    total = t.documents.agg(F.count("*").alias("n_docs")).withColumn("one", F.lit(1))
    marked = t.benchmark.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    cited = marked.selectExpr(
        "item_id", "text quote", "explode(sequence(0L, 4L)) i", "n_docs",
    )
    found = (
        passage_hits(t).groupBy("item_id").agg(F.min("doc_id").alias("hit_id"))
    )
    return cited.join(found, "item_id", "left").selectExpr(
        "concat('c-', item_id, '-', i) citation_id", "item_id", "i copy", "concat('flag-', item_id % 7) owner_id", "quote",
        "coalesce(hit_id, item_id) + if(i = 1, 1, 0) document_id",
        "concat('ck-', coalesce(hit_id, item_id) + if(i = 4, n_docs, 0)) chunk_id",
        "coalesce(hit_id, item_id) expected_document_id",
        "if(i = 2, 7L, 0L) page", "if(i = 3, 'Điều 9', if(i = 0, 'ĐIỀU  1', null)) article",
        "if(i = 0, 100.0D, 1000.0D * i) x1", "1 - i * 0.1D source_confidence",
    )


SHINGLE = 6
#: Characters of a word that may be cut which enter a key.
EDGE = 8


def passage_hits(t: Tables) -> DataFrame:
    """Documents that hold a benchmark passage.

    The inner words of a passage are whole words of the document too, so up to six
    of them, as one shingle, meet the documents' shingles of as many words in an
    equi join.  Two words have none between them and meet neighbouring words by the
    end of the first and the beginning of the second; a single word meets pieces of
    words.  Only the shapes that occur are built; ``contains`` then decides.
    """
    words = F.split("text", r"\s+")
    item = t.benchmark.where("text is not null").select("item_id", F.col("text").alias("quote"), words.alias("w"))
    item = item.withColumn("kind", F.least(F.size("w"), F.lit(SHINGLE + 2)))
    first, second = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    item = item.withColumn("a", F.when(F.col("kind") <= 2, F.least(F.length(first), F.lit(EDGE))).otherwise(0))
    item = item.withColumn("b", F.when(F.col("kind") == 2, F.least(F.length(second), F.lit(EDGE))).otherwise(0))
    kind, a, b = F.col("kind"), F.col("a"), F.col("b")
    pair = lambda x, y: F.concat(F.right(x, a), F.lit(" "), F.left(y, b))
    run = lambda w, i: F.array_join(F.slice(w, i, kind - 2), " ")
    key = F.when(kind >= 3, run("w", F.lit(2))).when(kind == 2, pair(first, second)).otherwise(F.left(first, a))
    items = item.select("item_id", "quote", "kind", "a", "b", F.xxhash64("kind", key).alias("key"))

    def steps(last, of):
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), of)).otherwise(F.array().cast("array<string>"))

    shaped = t.documents.select("doc_id", words.alias("w")).crossJoin(F.broadcast(items.select("kind", "a", "b").distinct()))
    runs = steps(F.size("w") - kind + 3, lambda i: run("w", i))
    pairs = steps(F.size("w") - 1, lambda i: pair(F.get("w", i - 1), F.get("w", i)))
    pieces = F.flatten(F.transform("w", lambda x: steps(F.length(x) - a + 1, lambda i: F.substring(x, i, a))))
    keys = F.when(kind >= 3, runs).when(kind == 2, pairs).otherwise(pieces)
    keyed = shaped.select("doc_id", F.explode(F.array_distinct(F.transform(keys, lambda x: F.xxhash64(kind, x)))).alias("key"))
    found = keyed.join(items.select("item_id", "quote", "key"), "key")
    return (
        found.join(t.documents.select("doc_id", "text"), "doc_id")
        .where(F.col("text").contains(F.col("quote"))).select("item_id", "doc_id").distinct()
    )


def doc_chunks(t: Tables) -> DataFrame:
    """One chunk per document, with locators."""
    return t.documents.selectExpr(
        "concat('ck-', doc_id) chunk_id", "doc_id document_id", "text content", "text normalized_content",
        "concat('Điều ', 1 + doc_id % 2) article", "cast(null as string) clause", "cast(null as string) point",
        "0L pdf_page_start", "cast(length(text) div 2000 as bigint) pdf_page_end", "lang",
        "array(struct(0L pageIndex, struct(0.0D x1, 0.0D y1, 600.0D x2, 800.0D y2) bbox)) bounding_boxes",
        "0.5 + (doc_id % 50) / 100.0D ocr_confidence", "doc_id % 20 workspace_id",
    )


def users(t: Tables) -> DataFrame:
    """Customers are accounts; nations are communes; regions are provinces."""
    return t.customer.selectExpr(
        "c_custkey user_id", "c_nationkey commune_id", "c_name full_name", "c_name username",
        "concat(lower(c_name), '@example.org') email", "c_mktsegment position",
        "if(c_custkey % 10 = 0, 'ADMIN', 'USER') role",
        "if(c_custkey % 17 = 3, 'LOCKED', 'ACTIVE') status", "c_custkey % 17 <> 3 and c_custkey % 23 <> 5 is_active",
        "cast(c_custkey % 4 as int) token_version",
    )


def tenant_documents(t: Tables) -> DataFrame:
    """An order is a document of the commune of its customer."""
    return t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey document_id", "o_custkey owner_id", "c_nationkey commune_id", "o_orderdate created_at",
        "o_orderkey % 19 = 4 is_deleted", "if(o_orderkey % 19 = 4, o_orderdate, null) deleted_at",
        "case o_orderstatus when 'F' then 'APPROVED' when 'P' then 'PENDING_APPROVAL' else 'DRAFT' end approval_status",
        "if(o_orderkey % 13 = 2, o_orderkey div 13, null) meeting_id", "o_custkey div 10 workspace_id",
        "concat('files/', o_orderkey, '.pdf') object_key", "o_totalprice",
    )


def grants(t: Tables) -> DataFrame:
    """Every seventh order is shared with the customer numbered after its owner."""
    return t.orders.where("o_orderkey % 7 = 0").join(
        t.customer, F.expr("c_custkey = o_custkey + 1")
    ).selectExpr(
        "o_orderkey document_id", "c_custkey user_id", "c_nationkey commune_id",
        "if(o_orderkey % 2 = 0, 'READ', 'ASK') permission",
    )


def uploads(t: Tables) -> DataFrame:
    """Pages as uploaded files with good and bad names, types and first bytes."""
    return t.pages.selectExpr(
        "page_id", "page_id % 5 workspace_id",
        "case when page_id % 11 = 0 then 'báo cáo.exe.pdf' when page_id % 11 = 1 then 'a/b.pdf'"
        " when page_id % 11 = 2 then concat('t', page_id, '.txt') when page_id % 11 = 3 then ''"
        " when page_id % 2 = 0 then concat('van-ban-', page_id, '.pdf') else concat('VB', page_id, '.DOCX') end filename",
        "case when page_id % 13 = 0 then 'text/html' when page_id % 2 = 0 then 'application/pdf; charset=x' else"
        " 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end content_type",
        "encode(case when page_id % 17 = 0 then '' when page_id % 7 = 0 then html"
        " when page_id % 2 = 0 then concat('%PDF-1.4', html) else concat('PK', chr(3), chr(4), html) end, 'UTF-8') content",
    )


# --------------------------------------------------------------------------- SQL twins
_N = "CAST(NULL AS VARCHAR)"
VIEWS_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "blocks": ((), """
        SELECT document_id, lang, pos // 20 AS page_index, pos AS order_index, line AS text,
               0.5 + ((document_id * 7 + pos * 13) % 50) / 100.0 AS confidence
        FROM (SELECT doc_id AS document_id, lang, unnest(l) AS line, unnest(range(len(l))) AS pos
              FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"""),
    "lines": ((), """
        SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey,
          max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag,
          max(l_linestatus) AS l_linestatus, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2"""),
    "legal_blocks": (("lines",), """
        SELECT d AS document_id, p AS page_index, o AS order_index,
               'b-' || d || '-' || p || '-' || o AS block_id, t AS text,
               CASE WHEN o % 7 = 3 THEN NULL ELSE 0.5 + (o % 50) / 100.0 END AS confidence,
               CAST(o % 700 AS DOUBLE) AS y1
        FROM (
          SELECT c_custkey AS d, 0 AS p, 0 AS o, 'QUY ĐỊNH VỀ ' || c_mktsegment AS t FROM customer
          UNION ALL SELECT c_custkey, 0, 1, 'Căn cứ Luật số ' || c_custkey || '/2019' FROM customer
          UNION ALL SELECT c_custkey, 0, 2, 'CHƯƠNG ' || (c_nationkey + 1) || '. Quy định chung' FROM customer
          UNION ALL SELECT c_custkey, 0, 3, CASE WHEN c_custkey % 2 = 0 THEN '   ' ELSE 'Lời dẫn của chương' END FROM customer
          UNION ALL SELECT c_custkey, 1000000, 0, 'PHỤ LỤC I' FROM customer WHERE c_custkey % 5 = 0
          UNION ALL SELECT c_custkey, 1000000, 1, 'MẪU SỐ 01/BC Báo cáo' FROM customer WHERE c_custkey % 5 = 0
          UNION ALL SELECT c_custkey, 1000000, 2, '1) Nội dung mẫu ' || c_custkey FROM customer WHERE c_custkey % 5 = 0
          UNION ALL SELECT c_custkey, 1000000, 3, 'Nơi nhận: như trên' FROM customer WHERE c_custkey % 5 = 0
          UNION ALL SELECT o_custkey, 1 + o_orderkey // 1000, (o_orderkey % 1000) * 64,
                 'Điều ' || o_orderkey || '. ' || o_orderpriority FROM orders
          UNION ALL SELECT o_custkey, 1 + o_orderkey // 1000, (o_orderkey % 1000) * 64 + 4 * l_linenumber,
                 l_linenumber || '. Số lượng ' || CAST(l_quantity AS INT) || ' đơn vị, thời hạn '
                 || CAST(l_quantity AS INT) || ' ngày' FROM lines JOIN orders ON l_orderkey = o_orderkey
          UNION ALL SELECT o_custkey, 1 + o_orderkey // 1000, (o_orderkey % 1000) * 64 + 4 * l_linenumber + 1,
                 'a) Hoàn trả cho bên giao' FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
          UNION ALL SELECT o_custkey, 1 + o_orderkey // 1000, (o_orderkey % 1000) * 64 + 4 * l_linenumber + 2,
                 'Nội dung tiếp theo của lô ' || l_partkey FROM lines JOIN orders ON l_orderkey = o_orderkey
                 WHERE l_linestatus = 'O')"""),
    "headings": (("legal_blocks",), """
        SELECT *, page_index * 4294967296 + order_index AS ord,
          CASE WHEN trim(text) = '' THEN NULL
               WHEN text LIKE 'CHƯƠNG %' THEN 'CHAPTER' WHEN text LIKE 'Điều %' THEN 'ARTICLE'
               WHEN regexp_matches(text, '^\\d+[.)] ') THEN 'CLAUSE' WHEN text LIKE 'a) %' THEN 'POINT'
               WHEN text LIKE 'PHỤ LỤC%' THEN 'APPENDIX' WHEN text LIKE 'MẪU SỐ %' THEN 'FORM'
               WHEN text LIKE 'Căn cứ%' THEN 'LEGAL_BASIS' WHEN text LIKE 'Nơi nhận:%' THEN 'RECIPIENT_LIST'
               WHEN text LIKE 'QUY ĐỊNH%' THEN 'DOCUMENT_TITLE' END AS section_type,
          CASE WHEN trim(text) = '' THEN NULL
               WHEN text LIKE 'CHƯƠNG %' THEN 1 WHEN text LIKE 'Điều %' THEN 3
               WHEN regexp_matches(text, '^\\d+[.)] ') THEN 4 WHEN text LIKE 'a) %' THEN 5
               WHEN text LIKE 'PHỤ LỤC%' THEN 1 WHEN text LIKE 'MẪU SỐ %' THEN 2
               WHEN text LIKE 'Căn cứ%' THEN 0 WHEN text LIKE 'Nơi nhận:%' THEN 1
               WHEN text LIKE 'QUY ĐỊNH%' THEN 0 END AS level,
          CASE WHEN text LIKE 'CHƯƠNG %' THEN 'Chương ' || regexp_extract(text, '^CHƯƠNG (\\d+)', 1)
               WHEN text LIKE 'Điều %' THEN regexp_extract(text, '^(Điều \\d+)', 1)
               WHEN regexp_matches(text, '^\\d+[.)] ') THEN 'Khoản ' || regexp_extract(text, '^(\\d+)', 1)
               WHEN text LIKE 'a) %' THEN 'Điểm a' WHEN text LIKE 'PHỤ LỤC%' THEN 'Phụ lục I'
               WHEN text LIKE 'MẪU SỐ %' THEN 'Mẫu số 01/BC' WHEN text LIKE 'Căn cứ%' THEN 'Căn cứ'
               WHEN text LIKE 'Nơi nhận:%' THEN 'Nơi nhận' WHEN text LIKE 'QUY ĐỊNH%' THEN text END AS label,
          CASE WHEN text LIKE 'CHƯƠNG %' THEN 'Quy định chung'
               WHEN text LIKE 'Điều %' THEN regexp_extract(text, '^Điều \\d+\\. (.*)$', 1)
               WHEN regexp_matches(text, '^\\d+[.)] ') THEN regexp_extract(text, '^\\d+[.)] (.*)$', 1)
               WHEN text LIKE 'a) %' THEN substr(text, 4) WHEN text LIKE 'MẪU SỐ %' THEN 'Báo cáo'
               WHEN text LIKE 'Căn cứ%' THEN text END AS title
        FROM legal_blocks"""),
    "sections": (("headings",), """
        SELECT h.*,
          (SELECT max(p.ord) FROM headings p WHERE p.document_id = h.document_id AND p.ord < h.ord
             AND p.level < h.level) AS parent_ord,
          coalesce((SELECT min(n.ord) FROM headings n WHERE n.document_id = h.document_id AND n.ord > h.ord
             AND n.level <= h.level), 9223372036854775807) AS next_ord
        FROM headings h WHERE h.level IS NOT NULL"""),
    "reg_versions": ((), """
        SELECT 'v-' || k || '-' || y AS version_id, k AS family_id, k // 10 AS workspace_id,
          'doc-' || k || '-' || y AS document_id, 'Quy định số ' || k || ' năm ' || y AS title,
          k || '/' || y || '/QĐ-UBND' AS document_number, 'QUYET_DINH' AS document_type,
          make_date(y, 1, 1) AS effective_date, make_date(y - 1, 12, 1) AS issued_date, y AS year,
          CASE k % 3 WHEN 0 THEN 'Tài chính' WHEN 1 THEN 'Đầu tư công' ELSE 'Đất đai' END AS domain,
          concat_ws(chr(10), 'Phần mở đầu của văn bản', 'Điều 1. Ngưỡng',
            'Ngưỡng phê duyệt: ' || (10 * (q // 10)) || ' triệu đồng', 'Điều 2: Thực hiện',
            CASE WHEN n > 1 THEN 'Thời hạn báo cáo: ' || n || ' ngày' END,
            'Khoản 1. Thẩm quyền', 'Đơn vị phê duyệt: ' || s,
            CASE WHEN k % 4 = 0 THEN 'Theo Luật số ' || (k % 50) || '/' || y || ' và Nghị định ' || y || '.' END) AS raw_text
        FROM (SELECT l_partkey AS k, year(l_shipdate) AS y, CAST(sum(l_quantity) AS BIGINT) AS q,
                     count(*) AS n, min(s_name) AS s
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""),
    "reg_facts": (("reg_versions",), """
        SELECT v.*, CAST(regexp_extract(raw_text, 'phê duyệt: (\\d+ triệu đồng)', 1) AS VARCHAR) AS threshold,
          nullif(regexp_extract(raw_text, 'báo cáo: (\\d+ ngày)', 1), '') AS deadline,
          regexp_extract(raw_text, 'Đơn vị phê duyệt: ([^\\n.;]+)', 1) AS authority,
          lag(version_id) OVER w AS prev_id
        FROM reg_versions v WINDOW w AS (PARTITION BY family_id ORDER BY effective_date)"""),
    "changes": (("reg_facts",), """
        SELECT n.version_id, n.family_id, n.workspace_id, k.fact_key, o.v AS old_value, x.v AS new_value,
          CASE WHEN o.v = x.v THEN 'UNCHANGED' WHEN o.v IS NULL THEN 'ADDED' WHEN x.v IS NULL THEN 'REMOVED'
               WHEN k.fact_key = 'approval_threshold' THEN 'VALUE_CHANGED'
               WHEN k.fact_key = 'reporting_deadline' THEN 'DEADLINE_CHANGED' ELSE 'RESPONSIBILITY_CHANGED' END AS change_type,
          n.year, n.prev_id AS old_version_id
        FROM reg_facts n JOIN reg_facts p ON p.version_id = n.prev_id
        CROSS JOIN (VALUES ('approval_threshold'), ('reporting_deadline'), ('approving_authority')) k(fact_key)
        CROSS JOIN LATERAL (SELECT CASE k.fact_key WHEN 'approval_threshold' THEN p.threshold
            WHEN 'reporting_deadline' THEN p.deadline ELSE p.authority END AS v) o
        CROSS JOIN LATERAL (SELECT CASE k.fact_key WHEN 'approval_threshold' THEN n.threshold
            WHEN 'reporting_deadline' THEN n.deadline ELSE n.authority END AS v) x
        WHERE o.v IS NOT NULL OR x.v IS NOT NULL"""),
    "projects": ((), """
        SELECT c_custkey AS project_id, c_custkey // 10 AS workspace_id, 'Dự án ' || c_custkey AS name,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'Chờ thẩm định' WHEN 'MACHINERY' THEN 'In progress' ELSE 'Hoàn thành' END AS status,
          CASE c_custkey % 3 WHEN 0 THEN 'Tai chinh' WHEN 1 THEN 'Đầu tư công' ELSE 'Y tế' END AS domain,
          CASE WHEN c_acctbal > 3000 THEN ['Ngân sách địa phương', 'Vốn vay'] ELSE ['Vốn vay'] END AS budget_sources,
          CASE c_nationkey % 3 WHEN 0 THEN 'Phòng Kế hoạch' WHEN 1 THEN 'Phòng Tài chính' ELSE 'Văn phòng' END AS lead_department,
          CASE WHEN c_custkey % 2 = 0 THEN ['Phòng Tài chính', 'Phòng Tài chính'] ELSE ['Văn phòng'] END AS coordinating_departments,
          ['Quyết định ' || c_custkey || '/1997/QĐ-UBND', 'Luật ' || c_nationkey] AS legal_bases
        FROM customer"""),
    "impacts": (("changes", "reg_versions", "projects"), """
        SELECT * FROM (
          SELECT m.version_id, p.project_id, p.workspace_id, p.lead_department, p.coordinating_departments, m.hv, m.hr,
            round(CASE WHEN replace(replace(lower(strip_accents(v.domain)), 'đ', 'd'), 'Đ', 'd')
                     = replace(replace(lower(strip_accents(p.domain)), 'đ', 'd'), 'Đ', 'd') THEN 0.15 ELSE 0 END
              + CASE WHEN m.hv AND list_contains(p.budget_sources, 'Ngân sách địa phương') THEN 0.25 ELSE 0 END
              + CASE WHEN p.status IN ('Chờ thẩm định', 'In progress') THEN 0.20 ELSE 0 END
              + CASE WHEN m.hr AND (p.lead_department IN ('Phòng Kế hoạch', 'Phòng Tài chính')
                     OR list_contains(p.coordinating_departments, 'Phòng Tài chính')) THEN 0.20 ELSE 0 END
              + CASE WHEN contains(replace(lower(strip_accents(p.legal_bases[1])), 'đ', 'd'),
                     replace(lower(strip_accents(v.document_number)), 'đ', 'd')) THEN 0.10 ELSE 0 END
              + 0.10, 2) AS score
          FROM (SELECT version_id, bool_or(change_type = 'VALUE_CHANGED') AS hv,
                       bool_or(change_type = 'RESPONSIBILITY_CHANGED') AS hr
                FROM changes WHERE change_type <> 'UNCHANGED' GROUP BY 1) m
          JOIN reg_versions v USING (version_id) JOIN projects p ON p.workspace_id = v.workspace_id)
        WHERE score >= 0.20"""),
    "kg_nodes": (("lines",), f"""
        SELECT 'task-' || o_orderkey AS node_id, 'TASK' AS type, 'Nhiệm vụ ' || o_orderkey AS name, {_N} AS amount,
          {_N} AS value, {_N} AS resolved, {_N} AS target_type,
          CASE o_orderkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS importance,
          0.5 + (o_orderkey % 50) / 100.0 AS confidence, o_custkey AS document_id FROM orders
        UNION ALL SELECT 'agency-' || c_custkey, 'AGENCY', 'Cơ quan ' || c_custkey, NULL, NULL, NULL, NULL, 'MEDIUM', 0.9, c_custkey FROM customer
        UNION ALL SELECT 'dossier-' || c_custkey, 'DOSSIER', 'Hồ sơ ' || c_custkey, NULL, NULL, NULL, NULL, 'MEDIUM', 0.9, c_custkey FROM customer
        UNION ALL SELECT 'deadline-' || l_orderkey || '-' || m, 'DEADLINE', 'Tháng ' || m, NULL,
          CASE WHEN l_orderkey % 2 = 0 THEN m ELSE '' END, NULL, NULL, 'MEDIUM', 0.82, o_custkey
          FROM (SELECT DISTINCT l_orderkey, strftime(l_shipdate, '%Y-%m') AS m, o_custkey FROM lines JOIN orders ON l_orderkey = o_orderkey)
        UNION ALL SELECT 'budget-' || p_partkey, 'BUDGET', 'Ngân sách ' || (p_partkey % 50),
          CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '' ELSE CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR) END,
          NULL, NULL, NULL, CASE WHEN p_size > 40 THEN 'CRITICAL' ELSE 'LOW' END, 0.6 + (p_size % 40) / 100.0, -1 FROM part
        UNION ALL SELECT 'fund-' || s_suppkey, 'FUNDING_SOURCE', s_name, NULL, NULL, NULL, NULL, 'LOW', 0.7, -1 FROM supplier
        UNION ALL SELECT 'ref-' || l_orderkey || '-' || l_linenumber, 'LEGAL_REFERENCE', 'Luật số ' || (l_partkey % 20), NULL, NULL,
          CASE WHEN l_partkey % 3 = 0 THEN 'false' ELSE 'true' END, CASE WHEN l_partkey % 2 = 0 THEN 'FORM' ELSE 'LAW' END,
          'MEDIUM', 0.9, o_custkey FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""),
    "kg_edges": (("lines",), """
        SELECT 'e-lead-' || o_orderkey AS edge_id, 'agency-' || o_custkey AS source_node_id, 'task-' || o_orderkey AS target_node_id,
          'LEADS' AS type, 'HIGH' AS importance, 0.78 AS confidence, o_custkey AS document_id FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2')
        UNION ALL SELECT 'e-assign-' || o_orderkey, 'agency-' || o_custkey, 'task-' || o_orderkey, 'ASSIGNS_RESPONSIBILITY', 'MEDIUM', 0.72, o_custkey
          FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('2', '3')
        UNION ALL SELECT 'e-produce-' || o_orderkey, 'task-' || o_orderkey, 'output-' || o_orderkey, 'PRODUCES', 'MEDIUM', 0.8, o_custkey FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'e-submit-' || c_custkey, 'dossier-' || c_custkey, 'agency-' || c_custkey, 'SUBMITS', 'MEDIUM', 0.8, c_custkey FROM customer WHERE c_acctbal > 0
        UNION ALL SELECT 'e-fund-' || p_partkey, 'budget-' || p_partkey, 'fund-' || p_size, 'HAS_FUNDING_SOURCE', 'LOW', 0.7, -1 FROM part WHERE p_partkey % 4 <> 0
        UNION ALL SELECT 'e-' || k || '-' || l_orderkey || '-' || l_linenumber, s, d, type,
          CASE WHEN l_discount > 0.085 THEN 'CRITICAL' WHEN l_discount > 0.065 THEN 'HIGH' ELSE 'MEDIUM' END,
          round(1 - 4 * l_discount, 4), o_custkey
        FROM (
          SELECT 'HAS_DEADLINE' AS type, 'task-' || l_orderkey AS s, 'deadline-' || l_orderkey || '-' || strftime(l_shipdate, '%Y-%m') AS d, 'dl' AS k, * FROM lines
          UNION ALL SELECT 'HAS_BUDGET', 'task-' || l_orderkey, 'budget-' || l_partkey, 'bg', * FROM lines WHERE l_linenumber <= 2
          UNION ALL SELECT 'REFERENCES', 'task-' || l_orderkey, 'ref-' || l_orderkey || '-' || l_linenumber, 'rf', * FROM lines WHERE l_returnflag = 'R' AND l_tax > 0.02
          UNION ALL SELECT 'LEADS', 'agency-s' || l_suppkey, 'task-' || l_orderkey, 'ld', * FROM lines WHERE l_returnflag = 'R' AND l_linenumber = 1
          UNION ALL SELECT 'ASSIGNS_RESPONSIBILITY', 'agency-' || l_suppkey, 'task-' || l_orderkey, 'as', * FROM lines WHERE l_linestatus = 'F' AND l_linenumber = 2
        ) JOIN orders ON l_orderkey = o_orderkey"""),
    "job_events": ((), """
        SELECT 'job-' || user_id || '-' || strftime(ts, '%m%d') AS job_id, user_id AS document_id, event_id AS seq, ts,
          CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'PROCESSING'
            WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
          CAST(json_extract_string(props, '$.k') AS INT) + CASE WHEN event_id % 50 = 0 THEN 60 ELSE 0 END AS progress,
          CASE event_type WHEN 'view' THEN 'EXTRACTING_TEXT' WHEN 'click' THEN 'CREATING_CHUNKS' WHEN 'purchase' THEN 'COMPLETED' ELSE 'UPLOADED' END AS current_step,
          CAST(trunc(value) AS INT) AS current_page, CASE WHEN event_id % 3 = 0 THEN 30 END AS total_pages,
          CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN 'failure' END AS error_message, day(ts) AS attempt
        FROM events"""),
    "login_events": ((), """
        SELECT event_id, user_id, ts, event_type IN ('purchase') OR event_id % 11 = 0 AS ok FROM events"""),
    "audit_events": ((), """
        SELECT event_id, ts AS created_at, user_id AS actor_user_id, user_id % 25 AS commune_id, upper(event_type) AS action,
          CASE WHEN event_type = 'error' THEN 'DENIED' ELSE 'SUCCESS' END AS result,
          json_extract_string(props, '$.k') AS k, repeat(event_type || ' ', 300) AS note FROM events"""),
    "passage_hits": ((), """
        SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""),
    "citations": (("passage_hits",), """
        SELECT 'c-' || b.item_id || '-' || i AS citation_id, b.item_id, i AS copy, 'flag-' || (b.item_id % 7) AS owner_id, b.text AS quote,
          coalesce(hit_id, b.item_id) + CASE WHEN i = 1 THEN 1 ELSE 0 END AS document_id,
          'ck-' || (coalesce(hit_id, b.item_id) + CASE WHEN i = 4 THEN (SELECT count(*) FROM documents) ELSE 0 END) AS chunk_id,
          coalesce(hit_id, b.item_id) AS expected_document_id, CASE WHEN i = 2 THEN 7 ELSE 0 END AS page,
          CASE WHEN i = 3 THEN 'Điều 9' WHEN i = 0 THEN 'ĐIỀU  1' END AS article,
          CASE WHEN i = 0 THEN 100.0 ELSE 1000.0 * i END AS x1, 1 - i * 0.1 AS source_confidence
        FROM benchmark b LEFT JOIN (SELECT item_id, min(doc_id) AS hit_id FROM passage_hits GROUP BY 1) h USING (item_id)
        CROSS JOIN range(5) r(i)"""),
    "citation_checks": (("citations",), """
        SELECT c.*, concat_ws(',',
            CASE WHEN c.document_id <> c.expected_document_id THEN 'CROSS_DOCUMENT_CITATION' END,
            CASE WHEN d.doc_id IS NULL THEN 'DOCUMENT_NOT_FOUND' END,
            CASE WHEN k.doc_id IS NULL THEN 'CHUNK_NOT_FOUND' END,
            CASE WHEN k.doc_id <> c.document_id THEN 'CHUNK_DOCUMENT_MISMATCH' END,
            CASE WHEN NOT contains(trim(regexp_replace(lower(k.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(c.quote), '\\s+', ' ', 'g')))
                  AND NOT contains(regexp_replace(lower(k.text), '[^\\p{L}\\p{N}_]+', '', 'g'), regexp_replace(lower(c.quote), '[^\\p{L}\\p{N}_]+', '', 'g'))
                 THEN 'QUOTE_NOT_FOUND' END,
            CASE WHEN c.article IS NOT NULL AND k.doc_id IS NOT NULL
                  AND regexp_replace(lower(c.article), '\\s+', ' ', 'g') <> 'điều ' || (1 + k.doc_id % 2) THEN 'ARTICLE_MISMATCH' END,
            CASE WHEN c.page > length(k.text) // 2000 THEN 'PAGE_OUT_OF_RANGE' END,
            CASE WHEN k.doc_id IS NOT NULL AND (c.page <> 0 OR c.x1 + 10 > 601) THEN 'BOUNDING_BOX_PAGE_MISMATCH' END) AS issues
        FROM citations c LEFT JOIN documents d ON d.doc_id = c.document_id
        LEFT JOIN documents k ON 'ck-' || k.doc_id = c.chunk_id"""),
    "users": ((), """
        SELECT c_custkey AS user_id, c_nationkey AS commune_id, c_name AS full_name, c_mktsegment AS position,
          lower(c_name) || '@example.org' AS email, CASE WHEN c_custkey % 10 = 0 THEN 'ADMIN' ELSE 'USER' END AS role,
          CASE WHEN c_custkey % 17 = 3 THEN 'LOCKED' ELSE 'ACTIVE' END AS status,
          c_custkey % 17 <> 3 AND c_custkey % 23 <> 5 AS is_active, c_custkey % 4 AS token_version FROM customer"""),
    "tenant_documents": ((), """
        SELECT o_orderkey AS document_id, o_custkey AS owner_id, c_nationkey AS commune_id, o_orderdate AS created_at,
          o_orderkey % 19 = 4 AS is_deleted,
          CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'PENDING_APPROVAL' ELSE 'DRAFT' END AS approval_status,
          CASE WHEN o_orderkey % 13 = 2 THEN o_orderkey // 13 END AS meeting_id, o_custkey // 10 AS workspace_id,
          'files/' || o_orderkey || '.pdf' AS object_key, o_totalprice
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "grants": ((), """
        SELECT o_orderkey AS document_id, c_custkey AS user_id, c_nationkey AS commune_id
        FROM orders JOIN customer ON c_custkey = o_custkey + 1 WHERE o_orderkey % 7 = 0"""),
    "uploads": ((), """
        SELECT page_id, page_id % 5 AS workspace_id,
          CASE WHEN page_id % 11 = 0 THEN 'báo cáo.exe.pdf' WHEN page_id % 11 = 1 THEN 'a/b.pdf'
            WHEN page_id % 11 = 2 THEN 't' || page_id || '.txt' WHEN page_id % 11 = 3 THEN ''
            WHEN page_id % 2 = 0 THEN 'van-ban-' || page_id || '.pdf' ELSE 'VB' || page_id || '.DOCX' END AS filename,
          CASE WHEN page_id % 13 = 0 THEN 'text/html' WHEN page_id % 2 = 0 THEN 'application/pdf; charset=x'
            ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS content_type,
          CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 7 = 0 THEN html
            WHEN page_id % 2 = 0 THEN '%PDF-1.4' || html ELSE 'PK' || chr(3) || chr(4) || html END AS content
        FROM pages"""),
    "chunks": ((), """
        SELECT 'ck-' || doc_id AS chunk_id, doc_id AS document_id, text AS content, 'Điều ' || (1 + doc_id % 2) AS article,
          length(text) // 2000 AS pdf_page_end, lang, doc_id % 20 AS workspace_id, 0.5 + (doc_id % 50) / 100.0 AS ocr_confidence
        FROM documents"""),
}


def with_views(names: str, body: str) -> str:
    """Prefixes ``body`` with the views it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in VIEWS_SQL[name][0]:
                visit(dep)
            order.append(name)

    for name in names.split():
        visit(name)
    recursive = "RECURSIVE " if "RECURSIVE_BODY" in body else ""
    body = body.replace("RECURSIVE_BODY", "").strip()
    parts = ", ".join(f"{n} AS MATERIALIZED ({VIEWS_SQL[n][1]})" for n in order)
    if body.split()[0] == "WITH":
        return f"WITH {recursive}{parts}, {body[4:]}"
    return f"WITH {recursive}{parts} {body}"
