"""Knowledge graph: rule-based extraction, normalizing, merging, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.session import cut_lineage
from docgraph.operators.ordered import dealt, first_per_key, running_sum, top_per_key

# Relation types that need a second look.
COMPLEX_TYPES = (
    "ASSIGNS_RESPONSIBILITY", "GRANTS_AUTHORITY", "HAS_BUDGET", "HAS_DEADLINE", "REFERENCES", "REPEALS", "REPLACES",
)
# Patterns of the rule-based extraction.
END = rf"(?![{X.WORD}])"
START = rf"(?<![{X.WORD}])"
ARTICLE = rf"(?imu)^\s*(Điều\s+\p{{Nd}}+[a-zA-Z]?){END}"
METADATA = r"(?imu)^\s*(Người ký|Cơ quan)\s*:\s*([^\r\n]+)"
SENTENCE = r"(?m)[^.!?;\n]+(?:[.!?;]|$)"
ASSIGNMENT = (
    rf"(?iu)((?:Bộ|Sở|Ủy ban nhân dân|Uỷ ban nhân dân|UBND|Chính phủ|Thủ tướng Chính phủ|Văn phòng Chính phủ|"
    rf"Hội đồng nhân dân|HĐND){END}.*?)\s+(có trách nhiệm|chịu trách nhiệm|chủ trì|tổ chức thực hiện|thực hiện)"
    r"\s+(.{3,})$"
)
REFERENCE = (
    rf"(?iu){START}(Luật|Nghị định|Thông tư|Quyết định|Nghị quyết|Pháp lệnh)"
    rf"(?=\s)[\s{X.WORD}À-ỹĐđ-]*?\s+số\s+(\p{{Nd}}[{X.WORD}./-]*)"
)
# The words that a reference begins with, in lower case.
ACTS = ("luật", "nghị định", "thông tư", "quyết định", "nghị quyết", "pháp lệnh")
DURATION = rf"(?iu){START}\p{{Nd}}{{1,3}}(?:[.,]\p{{Nd}}+)?\s*(?:ngày|tháng|năm|giờ|phút){END}"
TEMPORAL = ("thời hạn", "thời hiệu", "trong vòng", "chậm nhất", "kể từ", "hoàn thành", "hết hạn")

# ---------------------------------------------------------------- extraction


def _facts_of(sentence: Column, folded: Column) -> Column:
    """Facts of a sentence in order of extraction: assignment, references, durations."""
    bare = F.regexp_replace(sentence, r"[ .;]+$", "")
    row = lambda kind, a, b, c: F.struct(
        F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c")
    )
    none = F.lit(None).cast("string")
    # A plain look for the words comes first; few sentences reach the long patterns.
    part = lambda g: F.regexp_extract(bare, ASSIGNMENT, g)
    assigned = F.when(
        X.contains_any(folded, ("trách nhiệm", "chủ trì", "thực hiện")) & bare.rlike(ASSIGNMENT),
        F.array(row("ASSIGN", F.trim(part(1), F.lit(" ,;:.0123456789)")), part(2), F.trim(part(3), F.lit(" ,;:.")))),
    )
    whole = lambda pattern: F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))
    refs = F.when(
        folded.contains("số") & X.contains_any(folded, ACTS),
        F.transform(
            whole(REFERENCE),
            lambda full: row(
                "REFERENCE", F.trim(full, F.lit(" ,.;")), F.regexp_extract(full, REFERENCE, 1), F.regexp_extract(full, REFERENCE, 2)
            ),
        ),
    )
    timed = X.contains_any(folded, TEMPORAL)
    spans = F.when(timed, F.transform(whole(DURATION), lambda d: row("DURATION", d, none, none)))
    empty = F.array().cast("array<struct<kind:string,a:string,b:string,c:string>>")
    return F.concat(*[F.coalesce(part, empty) for part in (assigned, refs, spans)])


def sentence_facts(chunks: DataFrame, cap: int | None = None) -> DataFrame:
    """Facts in reading order; all of them, or those within the cap of E19.

    With a cap, a sentence is read only while fewer than ``cap`` facts precede it; its
    assignment then always counts, each reference and duration only while the
    count is below ``cap``.  So with n facts before the sentence, its first fact
    is kept when n < cap, a later one when n plus its place is below cap.
    """
    found = chunks.select(
        "document_id", "chunk_order", "chunk_id", "parent_id",
        F.posexplode(F.regexp_extract_all(X.strip(F.col("content")), F.lit(SENTENCE), F.lit(0))).alias("s", "sentence"),
    ).withColumn("sentence", X.strip(F.col("sentence"))).where("sentence <> ''")
    # One-element transforms: a sentence is folded once for all looks at it, and the facts are found once, not again for the filter.
    bound = F.transform(F.array("sentence"), lambda x: F.struct(x.alias("text"), X.fold(x).alias("folded")))
    bound = F.transform(bound, lambda x: _facts_of(x["text"], x["folded"]))
    found = cut_lineage(found.withColumn("facts", F.get(bound, 0)).where("size(facts) > 0"))
    if cap is None:
        facts = found.select("*", F.posexplode("facts").alias("i", "f"))
    else:
        placed = found.withColumns(
            {"place": F.struct("chunk_order", "s"), "seg": F.expr("chunk_order div 256"), "n": F.size("facts")}
        )
        placed = running_sum(placed, ["document_id"], "seg", "place", {"before": F.col("n")}, inclusive=False)
        placed = placed.where(F.col("before") < cap)
        facts = placed.select("*", F.posexplode("facts").alias("i", "f")).where(
            (F.col("before") + F.col("i") < cap) | ((F.col("i") == 0) & (F.col("f.kind") == "ASSIGN"))
        )
    first = F.get("facts", 0)
    return facts.select(
        "document_id", "chunk_id", "parent_id", "chunk_order", "s", "i", "sentence", "f.kind", "f.a", "f.b", "f.c",
        F.when(first["kind"] == "ASSIGN", X.display(F.concat_ws(" ", first["b"], first["c"]), None)).alias("task"),
    )


def node_key(name: Column) -> Column:
    """What two names of one node have in common."""
    return X.collapse(X.fold(name))


def node_id(kind: Column, name: Column) -> Column:
    return X.stable_id("local-node", kind, node_key(name))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return X.stable_id("local-edge", source, target, kind)


def extract(
    chunks: DataFrame, documents: DataFrame, max_provisions: int | None = None, max_facts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """I9, with all provisions and facts unless limits are given; the confidences are fixed values.  ``chunks``: document_id, chunk_id, chunk_order, content, article, page.
    ``documents``: document_id, name.  Returns nodes and edges, one row per mention."""
    filled = chunks.where(X.strip(F.coalesce("content", F.lit(""))) != "")
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    root_name = F.coalesce("name", F.concat(F.lit("Tài liệu "), F.col("document_id").cast("string")))
    root = documents.join(counts, "document_id", "left").select(
        "document_id", F.lit("LEGAL_DOCUMENT").alias("type"), X.display(root_name, None).alias("name"),
        F.lit(1.0).alias("confidence"), F.struct(F.lit(-1).cast("long").alias("o"), F.lit(0).alias("s"), F.lit(0).alias("i")).alias("at"),
        F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("quote"),
        F.create_map(F.lit("sourceChunkCount"), F.coalesce("n_chunks", F.lit(0)).cast("string"), F.lit("documentId"), F.col("document_id").cast("string")).alias("properties"),
    )
    roots = root.select("document_id", node_id(F.col("type"), F.col("name")).alias("root_id"))

    line = X.first_line(F.col("content"))
    named = F.coalesce("article", F.nullif(F.regexp_extract("content", ARTICLE, 1), F.lit("")))
    articles = filled.withColumns({"line": line, "art": named}).withColumn("art_key", X.collapse(X.fold(F.col("art"))))
    firsts = first_per_key(
        articles.where("art is not null").select("document_id", "art_key", "chunk_order", "chunk_id", "line", "art", "content"),
        ["document_id", "art_key"], [F.col("chunk_order")],
    )
    if max_provisions is not None:
        firsts = top_per_key(firsts, ["document_id"], ["chunk_order"], max_provisions)
    provisions = cut_lineage(firsts)
    title = F.when(F.startswith(X.fold(F.col("line")), X.fold(F.col("art"))), F.col("line")).otherwise(F.col("art"))
    provisions = provisions.withColumn("title", X.display(title, None))
    provision_nodes = provisions.select(
        "document_id", F.lit("LEGAL_PROVISION").alias("type"), F.col("title").alias("name"), F.lit(0.98).alias("confidence"),
        F.struct(F.col("chunk_order").alias("o"), F.lit(-2).alias("s"), F.lit(0).alias("i")).alias("at"), "chunk_id",
        X.quote(F.col("line")).alias("quote"),
        F.create_map(F.lit("article"), F.col("art"), F.lit("excerpt"), X.quote(F.col("content"))).alias("properties"),
    )
    provision_ids = provisions.select("document_id", "art_key", node_id(F.lit("LEGAL_PROVISION"), F.col("title")).alias("provision_id"))
    known = articles.join(documents.select("document_id"), "document_id", "left_semi")

    whole = lambda g: F.regexp_extract_all(X.strip(F.col("content")), F.lit(METADATA), F.lit(g))
    signers = known.select(
        "document_id", "chunk_id", "chunk_order",
        F.posexplode(F.arrays_zip(whole(0).alias("full"), whole(1).alias("label"), whole(2).alias("value"))).alias("i", "m"),
    ).select(
        "document_id",
        F.when(X.fold(F.col("m.label")) == "cơ quan", "AGENCY").otherwise("PERSON").alias("type"),
        X.display(F.trim("m.value", F.lit(" ,.;")), None).alias("name"), F.lit(0.9).alias("confidence"),
        F.struct(F.col("chunk_order").alias("o"), F.lit(-1).alias("s"), F.col("i")).alias("at"), "chunk_id",
        X.quote(F.col("m.full")).alias("quote"), F.create_map(F.lit("sourceLabel"), F.col("m.label")).alias("properties"),
    )

    # Written once: six node and edge branches read the facts.  A fact goes with the key of its article; only edges look up the parent.
    facts = cut_lineage(sentence_facts(known.withColumn("parent_id", F.col("art_key")), max_facts)).withColumnRenamed("parent_id", "art_key")
    at = F.struct(F.col("chunk_order").alias("o"), F.col("s"), F.col("i")).alias("at")
    said = X.quote(F.col("sentence")).alias("quote")
    no_props = F.create_map().cast("map<string,string>").alias("properties")

    def fact_nodes(kind: str, node_type: str, name: Column, confidence: float, props: Column) -> DataFrame:
        return facts.where(F.col("kind") == kind).select(
            "document_id", F.lit(node_type).alias("type"), X.display(name, None).alias("name"),
            F.lit(confidence).alias("confidence"), at, "chunk_id", said, props.alias("properties"),
        )

    nodes = root.unionByName(provision_nodes).unionByName(signers)
    nodes = nodes.unionByName(fact_nodes("ASSIGN", "AGENCY", F.col("a"), 0.78, no_props))
    nodes = nodes.unionByName(fact_nodes("ASSIGN", "TASK", F.col("task"), 0.74, no_props))
    nodes = nodes.unionByName(
        fact_nodes(
            "REFERENCE", "LEGAL_REFERENCE", F.col("a"), 0.9,
            F.create_map(F.lit("documentType"), F.col("b"), F.lit("documentNumber"), F.col("c"), F.lit("resolved"), F.lit("false")),
        )
    )
    nodes = nodes.unionByName(
        fact_nodes("DURATION", "DEADLINE", F.col("a"), 0.82,
                   F.create_map(F.lit("value"), F.col("a"), F.lit("context"), X.display(F.col("sentence"))))
    )
    nodes = nodes.withColumns({"node_key": node_key(F.col("name")), "node_id": node_id(F.col("type"), F.col("name"))})

    def edge(df: DataFrame, source: Column, target: Column, kind: str, confidence: float, review: bool) -> DataFrame:
        return df.select(
            "document_id", source.alias("source_node_id"), target.alias("target_node_id"), F.lit(kind).alias("type"),
            F.lit(confidence).alias("confidence"), "at", "chunk_id", "quote",
            F.lit("NEEDS_REVIEW" if review else "NOT_REQUIRED").alias("verification_status"),
        )

    facts_at = facts.withColumns({"at": at, "quote": said})
    parented = facts_at.where("kind in ('REFERENCE', 'DURATION')").join(roots, "document_id").join(provision_ids, ["document_id", "art_key"], "left").withColumn(
        "parent_id", F.coalesce("provision_id", "root_id")
    )
    task_id = node_id(F.lit("TASK"), F.col("task"))
    actor_id = node_id(F.lit("AGENCY"), X.display(F.col("a"), None))
    source = F.coalesce(F.when(F.col("task").isNotNull(), task_id), F.col("parent_id"))
    assigned, led = F.col("kind") == "ASSIGN", X.fold(F.col("b")) == "chủ trì"
    edges = edge(
        provision_nodes.join(roots, "document_id"), F.col("root_id"), node_id(F.col("type"), F.col("name")), "CONTAINS", 0.98, False
    )
    edges = edges.unionByName(
        edge(signers.join(roots, "document_id"), node_id(F.col("type"), F.col("name")), F.col("root_id"), "APPROVES", 0.65, True)
    )
    edges = edges.unionByName(edge(facts_at.where(assigned), actor_id, task_id, "ASSIGNS_RESPONSIBILITY", 0.72, True))
    edges = edges.unionByName(edge(facts_at.where(assigned & led), actor_id, task_id, "LEADS", 0.78, True))
    edges = edges.unionByName(
        edge(parented.where("kind = 'REFERENCE'"), source, node_id(F.lit("LEGAL_REFERENCE"), X.display(F.col("a"), None)), "REFERENCES", 0.9, True)
    )
    edges = edges.unionByName(
        edge(parented.where("kind = 'DURATION'"), source, node_id(F.lit("DEADLINE"), X.display(F.col("a"), None)), "HAS_DEADLINE", 0.78, True)
    )
    return nodes, edges.withColumn("edge_id", edge_id(F.col("source_node_id"), F.col("target_node_id"), F.col("type")))


def merge_mentions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of a node or edge in one document become one row; the first names it."""
    # By what the id is made of: a digest per node, not per mention, and none where it is not asked for.
    n = nodes.groupBy("document_id", "type", "node_key").agg(
        F.min_by("name", "at").alias("name"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions"),
    ).select("document_id", X.stable_id("local-node", F.col("type"), F.col("node_key")).alias("node_id"), "type", "name", "confidence", "mentions")
    e = edges.groupBy("document_id", "edge_id").agg(
        F.min_by(F.struct("source_node_id", "target_node_id", "type", "confidence", "verification_status"), "at").alias("h"),
        F.count("*").alias("mentions"),
    ).select("document_id", "edge_id", "h.*", "mentions")
    return n, e


def merged_properties(items: DataFrame, keys: list[str], order: str, *, first_wins: bool) -> DataFrame:
    """Properties as rows (keys, name, value).  Extraction and edge merging keep the
    last value of a name, node merging the first."""
    pick = F.min_by if first_wins else F.max_by
    entries = items.select(*keys, order, F.explode("properties").alias("name", "value"))
    return dealt(entries, *keys, "name").groupBy(*keys, "name").agg(pick("value", order).alias("value"))


# ---------------------------------------------------------------- normalize, merge, validate


def normalize_nodes(nodes: DataFrame, *, unicode_form: bool = True) -> DataFrame:
    """H5: canonical name and normalized key."""
    named = nodes.withColumn("canonical_name", X.canonical_name(F.coalesce("canonical_name", "name"), unicode_form=unicode_form) if "canonical_name" in nodes.columns else X.canonical_name(F.col("name"), unicode_form=unicode_form))
    return named.withColumn("normalized_key", F.concat_ws(":", "type", X.normalized_name(F.col("canonical_name"))))


def merge_nodes(nodes: DataFrame, keys: list[str], order: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """One node per key.  Returns merged nodes and the id mapping."""
    merged = dealt(nodes, *keys, "normalized_key").groupBy(*keys, "normalized_key").agg(
        F.min_by(F.struct("node_id", "name", "type"), order).alias("h"), F.max("confidence").alias("confidence"),
        X.rank_name(F.max(X.rank_of(F.col("importance")))).alias("importance"), F.count("*").alias("merged"),
    )
    merged = merged.select(*keys, "normalized_key", "h.*", "confidence", "importance", "merged")
    kept = merged.select(*keys, "normalized_key", F.col("node_id").alias("kept_id"))
    mapping = nodes.join(kept, [*keys, "normalized_key"]).select(*keys, "node_id", "kept_id")
    return merged, mapping


def remap_edges(edges: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Both endpoints through the mapping; an unknown endpoint stays."""
    for end in ("source_node_id", "target_node_id"):
        m = mapping.select(*keys, F.col("node_id").alias(end), F.col("kept_id").alias("_kept"))
        edges = edges.join(m, [*keys, end], "left").withColumn(end, F.coalesce("_kept", end)).drop("_kept")
    return edges


def merge_edges(edges: DataFrame, keys: list[str], order: str = "edge_id") -> DataFrame:
    """D10."""
    ends = ["source_node_id", "target_node_id", "type"]
    return edges.groupBy(*keys, *ends).agg(
        F.min(order).alias("edge_id"), F.max("confidence").alias("confidence"),
        X.rank_name(F.max(X.rank_of(F.col("importance")))).alias("importance"), F.count("*").alias("merged"),
    )


def merge_citations(citations: DataFrame, keys: list[str], order: str, *, best: bool) -> DataFrame:
    """One citation per source place; the most trusted or simply the first."""
    same = [*keys, "document_id", "chunk_id", "quote", "page"]
    by = F.struct(-F.col("source_confidence"), F.col(order)) if best else F.col(order)
    return citations.groupBy(*same).agg(F.min_by("citation_id", by).alias("citation_id"))


def endpoint_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source or target does not exist."""
    ends = edges.select(
        F.col("edge_id").alias("element_id"),
        F.explode(F.array(
            F.struct(F.lit("MISSING_SOURCE_NODE").alias("code"), F.col("source_node_id").alias("message")),
            F.struct(F.lit("MISSING_TARGET_NODE").alias("code"), F.col("target_node_id").alias("message")),
        )).alias("end"),
    ).select("element_id", "end.*")
    # Both ends meet the nodes in one join; an anti join needs no distinct ids.
    ids = nodes.select(F.col("node_id").alias("message"))
    return dealt(ends, "message").join(ids, "message", "left_anti").select("code", F.lit("EDGE").alias("element_type"), "element_id", "message")


def citation_issues(elements: DataFrame, checks: DataFrame) -> DataFrame:
    """HIGH and CRITICAL elements need citations, all of them valid.

    ``elements``: element_type, element_id, importance.  ``checks``: owner_id, issues.
    """
    needy = elements.where("importance in ('HIGH', 'CRITICAL')").select("element_type", "element_id")
    owned = checks.select(F.col("owner_id").alias("element_id"), "issues")
    bare = needy.join(owned.select("element_id").distinct(), "element_id", "left_anti").select(
        F.lit("IMPORTANT_ELEMENT_REQUIRES_CITATION").alias("code"), "element_type", "element_id"
    )
    bad = needy.join(owned, "element_id").select(
        F.explode("issues").alias("issue"), "element_type", "element_id"
    ).select(F.concat(F.lit("CITATION_"), "issue").alias("code"), "element_type", "element_id")
    return bare.unionByName(bad)


def keep_valid(nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without issues, and of the edges those between kept nodes.

    ``endpoint_issues`` may be left out of ``issues``: an end that is no node is no kept node either.
    """
    # The rejected ids are written once; three joins below read them.
    bad = cut_lineage(issues.select("element_type", F.col("element_id").alias("bad_id")).distinct())
    good_nodes = nodes.join(bad.where("element_type = 'NODE'"), F.col("node_id") == F.col("bad_id"), "left_anti")
    good_edges = edges.join(bad.where("element_type = 'EDGE'"), F.col("edge_id") == F.col("bad_id"), "left_anti")
    return good_nodes, induced(good_nodes, good_edges)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # A semi join needs no distinct ids.
    ids = nodes.select(F.col("node_id").alias("_id"))
    for end in ("source_node_id", "target_node_id"):
        edges = edges.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return edges


def visible(nodes: DataFrame, edges: DataFrame, node_type: str | None, needle: str) -> tuple[DataFrame, DataFrame]:
    """B4."""
    from docgraph.operators.filters import contains_needle

    shown = nodes if node_type is None else nodes.where(F.col("type") == node_type)
    shown = contains_needle(shown, ("name", "type"), needle) if needle else shown
    return shown, induced(shown, edges)


def incident(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("source_node_id") == node) | (F.col("target_node_id") == node))


def complex_edges(edges: DataFrame) -> DataFrame:
    """A complex type, or a target reached more than once by the same type.

    Counts are pre-aggregated and joined, so a much cited target is no window of its own.
    """
    shared = edges.groupBy("target_node_id", "type").agg(F.count("*").alias("n")).where("n > 1")
    joined = edges.join(shared, ["target_node_id", "type"], "left")
    return joined.where(F.col("type").isin(*COMPLEX_TYPES) | F.col("n").isNotNull()).drop("n")


def apply_decisions(edges: DataFrame, complex_ids: DataFrame, decisions: DataFrame) -> DataFrame:
    """A complex edge is verified only by a decision with enough evidence."""
    chosen = complex_ids.select("edge_id", F.lit(True).alias("is_complex"))
    joined = edges.join(chosen, "edge_id", "left").join(decisions, "edge_id", "left")
    ok = F.coalesce(F.col("verified") & F.col("evidence_sufficient"), F.lit(False))
    return joined.withColumn(
        "verification_status",
        F.when(F.col("is_complex"), F.when(ok, "VERIFIED").otherwise("NEEDS_REVIEW")).otherwise("NOT_REQUIRED"),
    ).drop("is_complex", "verified", "evidence_sufficient")
