"""Citation checks and the gates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators.ordered import top_per_key

TOLERANCE = 1.0
# Subjects too general for a question.
GENERIC_SUBJECTS = ("vấn đề", "nội dung", "quy định", "tài liệu", "văn bản")


def bbox_inside(page: Column, box: Column, anchors: Column, tolerance: float = TOLERANCE) -> Column:
    """The box lies within an anchor of its page, give or take the tolerance."""
    return F.exists(
        anchors,
        lambda a: (a["pageIndex"] == page)
        & (box["x1"] >= a["bbox"]["x1"] - tolerance) & (box["y1"] >= a["bbox"]["y1"] - tolerance)
        & (box["x2"] <= a["bbox"]["x2"] + tolerance) & (box["y2"] <= a["bbox"]["y2"] + tolerance),
    )


def validate(citations: DataFrame, chunks: DataFrame, documents: DataFrame, *, unicode_form: bool = True) -> DataFrame:
    """Adds ``issues`` (codes, empty when valid) and ``normalized_quote``.

    Only cited chunks are normalized, once each: the citations' chunk ids
    reduce the chunk table before any text work.
    """
    cited_ids = citations.select("chunk_id").distinct()
    form = lambda c: X.normalize_source(F.col(c), unicode_form=unicode_form)
    cited = chunks.join(cited_ids, "chunk_id", "left_semi").select(
        "chunk_id", F.col("document_id").alias("k_doc"), F.array(form("content"), form("normalized_content")).alias("k_texts"),
        F.col("article").alias("k_article"), F.col("clause").alias("k_clause"), F.col("point").alias("k_point"),
        "pdf_page_start", "pdf_page_end", F.col("bounding_boxes").alias("anchors"), F.lit(True).alias("k"),
    )
    cited = cited.withColumn("k_compact", F.transform("k_texts", lambda s: X.search_form(s)))
    known = documents.select("document_id", F.lit(True).alias("d")).distinct()
    joined = (
        citations.withColumn("normalized_quote", form("quote"))
        .join(known, "document_id", "left").join(cited, "chunk_id", "left")
    )
    quote = F.col("normalized_quote")
    compact = X.search_form(quote)
    found = F.exists("k_texts", lambda s: s.contains(quote)) | (
        (compact != "") & F.exists("k_compact", lambda s: s.contains(compact))
    )

    def wrong(name: str) -> Column:
        if name not in citations.columns:
            return F.lit(False)
        differs = X.normalize_source(F.col(name), unicode_form=False) != X.normalize_source(F.col(f"k_{name}"), unicode_form=False)
        return F.col(name).isNotNull() & (F.col(f"k_{name}").isNull() | differs)

    k = F.col("k").isNotNull()
    boxed = F.lit(False)
    if "bounding_box" in citations.columns:
        boxed = F.col("bounding_box").isNotNull() & ~bbox_inside(F.col("page"), F.col("bounding_box"), F.col("anchors"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("document_id") != F.col("expected_document_id"), "CROSS_DOCUMENT_CITATION"),
            F.when(F.col("d").isNull(), "DOCUMENT_NOT_FOUND"),
            F.when(~k, "CHUNK_NOT_FOUND"),
            F.when(k & (F.col("k_doc") != F.col("document_id")), "CHUNK_DOCUMENT_MISMATCH"),
            F.when(k & ~found, "QUOTE_NOT_FOUND"),
            F.when(k & wrong("article"), "ARTICLE_MISMATCH"),
            F.when(k & wrong("clause"), "CLAUSE_MISMATCH"),
            F.when(k & wrong("point"), "POINT_MISMATCH"),
            F.when(k & ~F.col("page").between(F.col("pdf_page_start"), F.col("pdf_page_end")), "PAGE_OUT_OF_RANGE"),
            F.when(k & boxed, "BOUNDING_BOX_PAGE_MISMATCH"),
        )
    )
    return joined.withColumn("issues", issues).select(*citations.columns, "normalized_quote", "issues")


def publication_gate(flags: DataFrame, checks: DataFrame, decisions: DataFrame) -> DataFrame:
    """HIGH and CRITICAL flags need citations that all hold, then a decision."""
    evidence = checks.groupBy(F.col("owner_id").alias("flag_id")).agg(F.bool_and(F.size("issues") == 0).alias("all_valid"))
    joined = flags.join(evidence, "flag_id", "left").join(decisions, "flag_id", "left")
    strict = F.col("severity").isin("HIGH", "CRITICAL")
    valid = F.coalesce("all_valid", F.lit(False))
    agreed = F.coalesce(F.col("verified") & F.col("evidence_sufficient"), F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(~strict, F.col("status")).when(valid & agreed, "VERIFIED").otherwise("SUPPRESSED"),
            "verification_reason": F.when(~strict, None).when(~valid, "Insufficient or invalid citation evidence")
            .otherwise(F.coalesce("reason", F.lit("Verifier omitted this flag"))),
        }
    ).drop("all_valid", "verified", "evidence_sufficient", "reason")


def valid_questions(
    questions: DataFrame, flags: DataFrame, flag_citations: DataFrame, checks: DataFrame, keep: int | None = None
) -> DataFrame:
    """The questions of a document that hold; with ``keep`` only its first ones are looked at.

    ``questions``: document_id, question_id, nth, issue_type, severity, related_subject, question, reason.
    ``flag_citations``: flag_id, chunk_id.  ``checks``: owner_id, chunk_id, issues.
    """
    first = questions if keep is None else top_per_key(questions, ["document_id"], ["nth"], keep)
    issue = ["document_id", "issue_type"]
    worst = flags.groupBy(*issue).agg(X.rank_name(F.max(X.rank_of(F.col("severity")))).alias("worst"))
    backed = flags.join(flag_citations, "flag_id").select(*issue, "chunk_id").distinct().withColumn("known", F.lit(True))
    cited = checks.select(F.col("owner_id").alias("question_id"), "chunk_id", "issues")
    cited = cited.join(first.select("question_id", *issue), "question_id").join(backed, [*issue, "chunk_id"], "left")
    cited = cited.groupBy("question_id").agg(
        F.bool_and((F.size("issues") == 0) & F.col("known").isNotNull()).alias("cited_ok")
    )
    any_chunk = backed.select(*issue).distinct().withColumn("has_evidence", F.lit(True))
    joined = first.join(worst, issue).join(any_chunk, issue).join(cited, "question_id", "left")
    subject = F.col("related_subject")
    trimmed = lambda w: F.trim(w, F.lit(".,;:()"))
    words = F.filter(F.split(X.strip(subject), r"\s+"), lambda w: F.length(trimmed(w)) >= 4)
    text = X.fold(F.concat_ws(" ", "question", "reason"))
    named = F.exists(words, lambda w: text.contains(trimmed(X.fold(w))))
    return joined.where(
        (F.col("severity") == F.col("worst")) & F.coalesce("cited_ok", F.lit(True))
        & ~X.strip(X.fold(subject)).isin(*GENERIC_SUBJECTS) & named
    ).select(*questions.columns)


def summary_gate(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds the reason an item is rejected for, null when accepted.

    Codes are counted per item, and the distinct ones (ten at most) listed.
    """
    cited = checks.select(F.col("owner_id").alias("item_id"), F.explode_outer("issues").alias("issue"))
    summed = cited.groupBy("item_id").agg(F.collect_set("issue").alias("codes"))
    joined = items.join(summed, "item_id", "left")
    exempt = F.col("system_metadata") & (F.col("category") == "DOCUMENT_INFORMATION")
    reason = (
        F.when(exempt, None).when(F.col("codes").isNull(), "SUMMARY_ITEM_REQUIRES_CITATION")
        .when(F.size("codes") > 0, F.array_join(F.array_sort("codes"), "; "))
    )
    return joined.withColumn("rejected_reason", reason).drop("codes")


def region_text(blocks: DataFrame, regions: DataFrame, cell: float = 64.0) -> DataFrame:
    """Blocks that touch a region of their page, a row per block and region.

    A page is a grid of square cells.  Blocks and regions meet on the cells that they
    cover, so a page with many of both is many keys; a pair that shares several cells is
    taken in the first one only, and the boxes then decide.
    """

    def covered(df: DataFrame, box: str, prefix: str) -> DataFrame:
        first, last = (lambda c: F.floor(F.col(box)[c] / cell)), F.greatest
        lows = {f"{prefix}_x": first("x1"), f"{prefix}_y": first("y1")}
        xs = F.sequence(first("x1"), last(first("x1"), first("x2")))
        ys = F.sequence(first("y1"), last(first("y1"), first("y2")))
        return df.withColumns(lows).withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))

    met = covered(blocks, "bbox", "b").join(covered(regions, "region", "r"), ["document_id", "page_index", "cell_x", "cell_y"])
    once = (F.col("cell_x") == F.greatest("b_x", "r_x")) & (F.col("cell_y") == F.greatest("b_y", "r_y"))
    b, r = F.col("bbox"), F.col("region")
    apart = (b["x2"] < r["x1"]) | (b["x1"] > r["x2"]) | (b["y2"] < r["y1"]) | (b["y1"] > r["y2"])
    return met.where(once & ~apart).drop("cell_x", "cell_y", "b_x", "b_y", "r_x", "r_y")


def region_summary(touching: DataFrame, regions: DataFrame) -> DataFrame:
    """The text of a region joins the blocks of one page only."""
    line = F.array_sort(F.collect_list(F.struct("order_index", "text")))
    found = touching.groupBy("region_id").agg(
        F.array_join(F.transform(line, lambda x: x["text"]), "\n").alias("text"), F.avg("confidence").alias("mean")
    )
    return regions.join(found, "region_id", "left").select(
        "region_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("mean", F.lit(0.0)).alias("average_confidence")
    )


def evidence_chunks(chunks: DataFrame, cited: DataFrame, fallback: int | None = None) -> DataFrame:
    """C17: cited chunks of each document; a document without any gets all, or its ``fallback`` first ones."""
    named = chunks.join(cited.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rest = chunks.join(named.select("document_id").distinct(), "document_id", "left_anti")
    if fallback is not None:
        rest = top_per_key(rest, ["document_id"], ["order_index"], fallback).drop("rank")
    return named.unionByName(rest)


def citations_of(citations: DataFrame, owners: DataFrame) -> DataFrame:
    """Citations of many owners in one join on (owner_type, owner_id)."""
    return citations.join(owners.select("owner_type", "owner_id").distinct(), ["owner_type", "owner_id"])
