"""Section trees from ordered blocks (E1-E6), table anchors (C7-C9), tree assembly (C20).

A heading's parent is the last earlier heading of a smaller level: any heading
between the two has a level that is not smaller, so it cannot have closed the
parent.  Eight running values, one per level, therefore replace a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.headings import LEVELS, classify, heading_level
from docgraph.functions.text import SPACE, collapse, strip
from docgraph.operators.ordered import carry_last, exploded, row_index
from docgraph.session import cut_lineage

DEPTH = range(8)
#: Blocks of a page that form one segment at most.
BLOCKS_PER_SEGMENT = 4_096
BODY_TYPES = ("ARTICLE",)


def order_blocks(blocks: DataFrame, blocks_per_segment: int = BLOCKS_PER_SEGMENT) -> DataFrame:
    """Adds ``ord`` (place in the document) and ``seg``; the blocks are written once.

    A document of up to ``blocks_per_segment`` blocks is one segment (``seg`` null).  A
    longer one has a segment for each page, or for each bounded run of a page's blocks, so
    one that comes as a single page has many segments too.  Of ``n`` blocks at most
    ``n / blocks_per_segment`` documents are that long; only their ids are broadcast.
    """
    blocks = cut_lineage(blocks)
    sizes = blocks.groupBy("document_id").agg(F.count("*").alias("_n"))
    long = sizes.where(F.col("_n") > blocks_per_segment).select("document_id", F.lit(True).alias("_long"))
    run = F.col("page_index") * F.lit(1 << 32) + F.floor(F.col("order_index") / blocks_per_segment)
    return blocks.join(F.broadcast(long), "document_id", "left").select(
        *blocks.columns,
        (F.col("page_index") * F.lit(1 << 32) + F.col("order_index")).alias("ord"),
        F.when(F.col("_long"), run).alias("seg"),
    )


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """H24 over all documents, written once: every scan below reads its result."""
    ordered = blocks if "ord" in blocks.columns else order_blocks(blocks)
    placed = row_index(ordered, ["document_id"], "seg", "ord", "position")
    h = classify(F.col("text"), F.col("position"), F.col("block_type"))
    return cut_lineage(placed.withColumn("h", h).select(*placed.columns, "h.*"))


def block_levels(ordered: DataFrame) -> DataFrame:
    """document_id, seg, ord, text and level of ``order_blocks``, for scans that read them once.

    Labels and titles are not looked for, and nothing is written; the place in the document
    and a scan by segment after this share one shuffle.
    """
    placed = row_index(ordered.select("document_id", "seg", "ord", "text", "block_type"), ["document_id"], "seg", "ord", "position")
    lines = placed.withColumn("line", collapse(F.col("text")))
    return lines.select("document_id", "seg", "ord", "text", heading_level(F.col("line"), F.col("position"), F.col("block_type")).alias("level"))


def section_id(document: str = "document_id", block: str = "block_id") -> F.Column:
    return F.substring(F.sha2(F.concat_ws("|", F.col(document).cast("string"), F.col(block)), 256), 1, 32)


def parse_sections(classified: DataFrame) -> DataFrame:
    """One row per heading with parent, range and path.

    All scans run on one shuffle by segment, on rows without text; what they carry along
    is not shuffled again.
    """
    keys = ["document_id"]
    me = F.struct("ord", section_id().alias("id"), F.col("section_type").alias("sectionType"), "label", "title")
    place = F.struct("ord", "block_id", "page_index")
    seen = classified.where(strip(F.col("text")) != "").select(
        *keys, "seg", "ord", "block_id", "page_index", "section_type", "label", "title", "level"
    ).repartition(*keys, "seg")
    # The last block: of the segment by a scan from its end, of a document of several by their maximum.
    ends = seen.where("seg is not null").groupBy(*keys, "seg").agg(F.max(place).alias("_e"))
    ends = ends.select(*keys, "seg", F.max("_e").over(Window.partitionBy(*keys)).alias("doc_end"))
    from_end = Window.partitionBy(*keys, "seg").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    heads = carry_last(seen, keys, "seg", "ord", {"before": place}, inclusive=False)
    heads = heads.withColumn("seg_end", F.first(place).over(from_end)).where("level is not null")
    heads = carry_last(
        heads, keys, "seg", "ord",
        {f"stop{k}": F.when(F.col("level") <= k, F.col("before")) for k in DEPTH},
        inclusive=False, reverse=True,
    )
    stop = F.coalesce(*[F.when(F.col("level") == k, F.col(f"stop{k}")) for k in DEPTH])
    heads = heads.join(ends, [*keys, "seg"], "left").select(
        *seen.columns, F.coalesce(stop, "doc_end", "seg_end").alias("end")
    )
    heads = carry_last(
        heads, keys, "seg", "ord", {f"up{k}": F.when(F.col("level") == k, me) for k in DEPTH}, inclusive=False,
        summarise=seen.where("level is not null"),
    )
    path = []
    for k in DEPTH:
        lower = [F.col(f"up{j}.ord") for j in range(k)]
        fresh = F.lit(True) if not lower else F.col(f"up{k}.ord") > F.coalesce(
            F.greatest(*lower, F.lit(-1)), F.lit(-1)
        )
        path.append(F.when((F.col("level") > k) & fresh, F.col(f"up{k}")))
    heads = heads.withColumn("ancestors", F.array_compact(F.array(*path)))
    return heads.select(
        "document_id", section_id().alias("section_id"), F.try_element_at("ancestors", F.lit(-1))["id"].alias("parent_id"),
        "section_type", "label", "title", F.col("level").alias("hierarchy_level"), "ord", "seg",
        F.col("page_index").alias("page_start"), F.col("end.page_index").alias("page_end"),
        F.col("block_id").alias("start_block_id"), F.col("end.block_id").alias("end_block_id"),
        F.col("end.ord").alias("end_ord"),
        F.array_append("ancestors", me).alias("heading_path"),
    )


def number_sections(sections: DataFrame) -> DataFrame:
    """Adds the 0-based place of each section in its document."""
    return row_index(sections, ["document_id"], "seg", "ord", "order_index")


def section_content(classified: DataFrame) -> DataFrame:
    """Heading text and its body lines up to the next heading.

    A section longer than a segment is returned in several parts, so no task
    gathers more than one segment's lines.
    """
    seen = classified.where(strip(F.col("text")) != "").select("document_id", "seg", "ord", "level", "text")
    owned = carry_last(
        seen, ["document_id"], "seg", "ord", {"section_ord": F.when(F.col("level").isNotNull(), F.col("ord"))}
    ).where("section_ord is not null")
    parts = owned.groupBy("document_id", "section_ord", "seg").agg(
        F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("t")))).alias("lines")
    )
    nth = F.row_number().over(Window.partitionBy("document_id", "section_ord").orderBy("seg")) - 1
    numbered = parts.where("seg is null").withColumn("part", F.lit(0)).unionByName(
        parts.where("seg is not null").withColumn("part", nth)
    )
    return numbered.select(
        "document_id", F.col("section_ord").alias("ord"), "part",
        F.array_join(F.transform("lines", lambda x: x["t"]), "\n").alias("content"),
        F.size("lines").cast("long").alias("line_count"),
    )


# Marks of an article and of a clause at a block's start.
ARTICLE_MARK = r"(?iu)(?<![\p{L}\p{N}_])(?:Điều|Article)\s+\d+[A-Za-z]?(?![\p{L}\p{N}_])"
CLAUSE_MARK = r"(?iu)^\s*(?:Khoản\s+)?(\d+)\s*[.)]"


def _detected(text: F.Column) -> F.Column:
    """Article or clause of the first line that names one."""
    lines = F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    marks = F.transform(
        lines,
        lambda s: F.struct(F.regexp_extract(s, ARTICLE_MARK, 0).alias("article"), F.regexp_extract(s, CLAUSE_MARK, 1).alias("clause")),
    )
    hits = F.filter(marks, lambda m: (m["article"] != "") | (m["clause"] != ""))

    def located(m: Column) -> Column:
        article = F.regexp_replace(strip(F.nullif(m["article"], F.lit(""))), "[.:]+$", "")
        return F.struct(
            article.alias("article"), F.when(article.isNull(), F.concat(F.lit("Khoản "), F.nullif(m["clause"], F.lit("")))).alias("clause")
        )

    # Of an array of one, so that the line is named once and its marks are looked for once.
    return F.get(F.transform(F.array(F.get(hits, 0)), located), 0)


def carry_locators(blocks: DataFrame) -> DataFrame:
    """E5: running article and clause; a new article forgets the clause."""
    found = blocks.withColumn("m", _detected(strip(F.col("text"))))
    scanned = carry_last(
        found, ["document_id"], "seg", "ord",
        {
            "_a": F.when(F.col("m.article").isNotNull(), F.struct("ord", F.col("m.article").alias("v"))),
            "_c": F.when(F.col("m.clause").isNotNull(), F.struct("ord", F.col("m.clause").alias("v"))),
        },
    )
    valid = F.col("_a").isNull() | (F.col("_c.ord") >= F.col("_a.ord"))
    return scanned.withColumns(
        {"article": F.col("_a.v"), "clause": F.when(valid, F.col("_c.v"))}
    ).drop("m", "_a", "_c")


# Unit types from the innermost outwards, and what each one resets.
UNITS = ("DIEM", "KHOAN", "DIEU", "MUC", "CHUONG", "PHU_LUC")
UNIT_HEADING = r"(?iu)^(Chương|Mục|Điều|Khoản|Điểm|Phụ\s*lục)\s+([^.\-:]+)(?:[.\-:]\s*(.*))?$"
RESETS = {
    "CHUONG": ("MUC", "DIEU", "KHOAN", "DIEM"),
    "MUC": ("DIEU", "KHOAN", "DIEM"),
    "DIEU": ("KHOAN", "DIEM"),
    "KHOAN": ("DIEM",),
    "DIEM": (),
    "PHU_LUC": ("CHUONG", "MUC", "DIEU", "KHOAN", "DIEM"),
}


def _unit_of(line: Column) -> Column:
    """The unit that a heading line opens; null for other lines."""
    from docgraph.functions.text import slug

    raw = F.regexp_extract(line, UNIT_HEADING, 1)
    low = F.lower(raw)
    unit = F.replace(F.upper(slug(raw, "-")), F.lit("-"), F.lit("_"))
    # The usual spellings need no slug.
    usual = F.when(low == "điều", "DIEU").when(low == "khoản", "KHOAN").when(low == "điểm", "DIEM").when(low == "chương", "CHUONG").when(low == "mục", "MUC")
    return F.when(raw != "", usual.otherwise(unit))


def legal_locations(texts: DataFrame, key: str = "version_id", text: str = "raw_text") -> DataFrame:
    """Sections of a regulation text with their location string, a row each; ``part`` is always 0."""
    found = exploded(with_sections(texts.select(key, text), text), [key], "sections", "s")
    return found.select(key, "s.ord", F.lit(0).alias("part"), "s.section_type", "s.label", "s.title", "s.legal_location", "s.content")


def with_sections(texts: DataFrame, text: str = "raw_text") -> DataFrame:
    """``texts`` with the sections of each text as an array, in their order.

    A text lies in one row, so its lines are worked on there as an array: headings are
    picked, one fold over them keeps the open unit of each kind, and the lines between two
    headings are the content.  Nothing is shuffled.  A null text has no section.
    """
    lines = F.transform(F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n"), lambda line, i: F.struct(i.cast("long").alias("ord"), strip(line).alias("line")))
    kept = texts.withColumn("_lines", F.filter(lines, lambda x: x["line"] != ""))
    part = lambda line, n: F.regexp_extract(line, UNIT_HEADING, n)
    marked = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), x["ord"].alias("ord"), x["line"].alias("line"), _unit_of(x["line"]).alias("unit")))
    heads = F.transform(
        F.filter(marked, lambda x: x["unit"].isNotNull()),
        lambda x: F.struct(
            x["at"].alias("at"), x["ord"].alias("ord"), x["unit"].alias("unit"), strip(part(x["line"], 2)).alias("label"),
            F.nullif(strip(part(x["line"], 3)), F.lit("")).alias("title"), F.initcap(part(x["line"], 1)).alias("shown"),
        ),
    )
    kept = kept.withColumn("_heads", heads)
    none = F.lit(None).cast("string")
    closers = {u: [other for other, gone in RESETS.items() if u in gone] for u in UNITS}

    def step(acc: Column, x: Column) -> Column:
        name = F.concat_ws(" ", x["shown"], x["label"])
        now = {u: F.when(x["unit"] == u, name).when(x["unit"].isin(closers[u]) if closers[u] else F.lit(False), none).otherwise(acc[u]) for u in UNITS}
        location = F.concat_ws(", ", *now.values())
        return F.struct(F.array_append(acc["found"], location).alias("found"), *[v.alias(u) for u, v in now.items()])

    start = F.struct(F.array().cast("array<string>").alias("found"), *[none.alias(u) for u in UNITS])
    kept = kept.withColumn("_locations", F.aggregate("_heads", start, step, lambda acc: acc["found"]))
    count = F.size("_lines")
    until = lambda i: F.coalesce(F.get("_heads", i + 1)["at"], count)
    content = lambda first, n: F.array_join(F.transform(F.slice("_lines", first, n), lambda x: x["line"]), "\n")

    def section(h: Column, i: Column) -> Column:
        location, body = F.get("_locations", i), content(h["at"] + 2, until(i) - h["at"] - 1)
        return F.struct(
            h["ord"].alias("ord"), h["unit"].alias("section_type"), h["label"].alias("label"), h["title"].alias("title"),
            location.alias("legal_location"), F.when(body == "", location).otherwise(body).alias("content"),
        )

    before = F.coalesce(F.get("_heads", F.lit(0))["at"], count)
    preamble = F.struct(
        F.lit(-1).cast("long").alias("ord"), F.lit("PREAMBLE").alias("section_type"), none.alias("label"), none.alias("title"),
        F.lit("Mở đầu").alias("legal_location"), content(F.lit(1), before).alias("content"),
    )
    sections = F.concat(F.when(before > 0, F.array(preamble)).otherwise(F.slice(F.array(preamble), F.lit(1), F.lit(0))), F.transform("_heads", section))
    return kept.select(*texts.columns, sections.alias("sections"))


def whole_text_sections(texts: DataFrame, key: str = "version_id", text: str = "raw_text") -> DataFrame:
    """The single section of a text that has no line at all."""
    return texts.where(strip(F.coalesce(F.col(text), F.lit(""))) == "").select(
        key, F.lit(0).cast("long").alias("ord"), F.lit(0).alias("part"), F.lit("DOCUMENT").alias("section_type"),
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("title"),
        F.lit("Toàn văn").alias("legal_location"), F.col(text).alias("content"),
    )


def table_sections(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """First TABLE section that starts on a page of the table.

    The page range becomes an equi join on (document, page); a table's own
    pages bound the fan-out.
    """
    pages = tables.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    heads = sections.where("section_type = 'TABLE'").groupBy(
        "document_id", F.col("page_start").alias("page")
    ).agg(F.min(F.struct("ord", "section_id")).alias("s"))
    best = pages.join(heads, ["document_id", "page"]).groupBy("document_id", "table_id").agg(F.min("s").alias("s"))
    return tables.join(best, ["document_id", "table_id"], "left").withColumn("section_id", F.col("s.section_id")).drop("s")


def table_anchors(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """First and last block on the table's pages, else the document's first block."""
    place = F.struct("ord", "block_id")
    on_page = blocks.groupBy("document_id", F.col("page_index").alias("page")).agg(
        F.min(place).alias("lo"), F.max(place).alias("hi")
    )
    first = on_page.groupBy("document_id").agg(F.min("lo").alias("doc_first"))
    pages = tables.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    found = pages.join(on_page, ["document_id", "page"]).groupBy("document_id", "table_id").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    joined = tables.join(found, ["document_id", "table_id"], "left").join(first, ["document_id"], "left")
    start = F.coalesce("lo", "doc_first")
    return joined.withColumns(
        {"start_block_id": start["block_id"], "end_block_id": F.coalesce("hi", start)["block_id"]}
    ).drop("lo", "hi", "doc_first")


def section_blocks(sections: DataFrame, classified: DataFrame) -> DataFrame:
    """Blocks of each section's range.

    Each block meets the at most eight sections that are open at it, instead of
    every section of its document.
    """
    # Of an open section only its place is carried along.
    opened = open_sections(classified.select("document_id", "seg", "ord", "block_id", "level"), ("ord",))
    pairs = exploded(opened, ["document_id", "ord", "block_id"], F.array(*[F.col(f"open{k}.ord") for k in DEPTH]), "s_ord")
    ranges = sections.select("document_id", F.col("ord").alias("s_ord"), "section_id", "end_ord")
    return (
        pairs.join(ranges, ["document_id", "s_ord"]).where("ord <= end_ord")
        .select("document_id", "section_id", "block_id", "ord")
    )


def open_sections(classified: DataFrame, fields: tuple[str, ...] = ("ord", "block_id", "section_type", "label")) -> DataFrame:
    """For each block, the section open at every level (null when none), as its ``fields``, ``ord`` among them."""
    me = F.struct(*fields)
    scanned = carry_last(
        classified, ["document_id"], "seg", "ord",
        {f"open{k}": F.when(F.col("level") == k, me) for k in DEPTH},
    )
    for k in reversed(DEPTH):
        lower = [F.col(f"open{j}.ord") for j in range(k)]
        if lower:
            fresh = F.col(f"open{k}.ord") > F.coalesce(F.greatest(*lower, F.lit(-1)), F.lit(-1))
            scanned = scanned.withColumn(f"open{k}", F.when(fresh, F.col(f"open{k}")))
    return scanned


def children(sections: DataFrame) -> DataFrame:
    """C20: parent and child pairs with the parent's place; an orphan's parent is null (a root)."""
    parents = sections.select(
        "document_id", F.col("section_id").alias("parent_id"), F.lit(True).alias("known"), F.col("ord").alias("parent_ord")
    )
    return sections.join(parents, ["document_id", "parent_id"], "left").select(
        "document_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), "section_id", "ord", "parent_ord"
    )
