"""Section trees and chunks against the given examples and a stack."""

import random

from pyspark.sql import functions as F

from docgraph.operators import chunking, structure

BLOCK = "document_id string, page_index long, order_index long, block_id string, block_type string, text string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>"


def blocks(spark, lines, doc="d", per_page=100):
    rows = [(doc, i // per_page, i, f"{doc}-{i}", "PARAGRAPH", s, 0.9, (0.0, 0.0, 1.0, 1.0)) for i, s in enumerate(lines)]
    return spark.createDataFrame(rows, BLOCK)


def classified(spark, lines, **kw):
    return structure.classify_blocks(structure.order_blocks(blocks(spark, lines, **kw), blocks_per_segment=2))


def test_labels_and_parents(spark):
    c = classified(spark, ["CHƯƠNG II", "MỤC 1", "Điều 7. Nội dung", "1. Quy định", "a) Trường hợp A"])
    s = {r.section_type: r for r in structure.parse_sections(c).collect()}
    assert s["CHAPTER"].label == "Chương II" and s["ARTICLE"].label == "Điều 7"
    assert s["CLAUSE"].parent_id == s["ARTICLE"].section_id and s["POINT"].parent_id == s["CLAUSE"].section_id


def test_article_spans_pages(spark):
    lines = ["Điều 7. Nội dung", "1. Dòng đầu của khoản", "Nội dung tiếp tục ở trang sau", "a) Điểm a"]
    a = [r for r in structure.parse_sections(classified(spark, lines, per_page=2)).collect() if r.section_type == "ARTICLE"]
    assert len(a) == 1 and (a[0].page_start, a[0].page_end) == (0, 1)


def test_heading_kinds(spark):
    lines = ["x", "Số: 12/QĐ", "Hà Nội, ngày 1 tháng 2 năm 2024", "Căn cứ Luật", "BỘ TÀI CHÍNH", "Bảng số 1.2", "NƠI NHẬN: a", "TM. UBND",
             "TM.UBND", "CHỦ TỊCH", "Quyết định:", "(iv) mục con", "Phụ lục IV Danh mục", "Mẫu số 02/BC", "điều 5", "Điềun 5", "CHỮ HOA MUỘN"]
    got = [r.section_type for r in classified(spark, lines).orderBy("ord").collect()]
    assert got == [None, "DOCUMENT_NUMBER", "ISSUED_DATE", "LEGAL_BASIS", "ISSUING_AUTHORITY", "TABLE", "RECIPIENT_LIST", "DOCUMENT_TITLE",
                   "SIGNATURE", "SIGNATURE", "PREAMBLE", "SUBPOINT", "APPENDIX", "FORM", "ARTICLE", None, None]


def test_tree_equals_a_stack(spark):
    rng = random.Random(3)
    kinds = ["Căn cứ x", "CHƯƠNG I", "MỤC 1", "Điều 1. x", "1. x", "a) x", "(i) x", "thân bài", "  "]
    level = {"Căn cứ x": 0, "CHƯƠNG I": 1, "MỤC 1": 2, "Điều 1. x": 3, "1. x": 4, "a) x": 5, "(i) x": 6}
    lines = [rng.choice(kinds) for _ in range(300)]
    got = {r.ord & 0xFFFFFFFF: r for r in structure.parse_sections(classified(spark, lines, per_page=5)).collect()}
    stack, parent, end = [], {}, {}
    for i, s in enumerate(lines):
        if not s.strip():
            continue
        if s in level:
            while stack and level[lines[stack[-1]]] >= level[s]:
                stack.pop()
            parent[i] = stack[-1] if stack else None
            stack.append(i)
        for j in stack:
            end[j] = i
    ids = {i: r.section_id for i, r in got.items()}
    assert set(got) == set(parent)
    for i, r in got.items():
        assert r.parent_id == (ids[parent[i]] if parent[i] is not None else None)
        assert r.end_block_id == f"d-{end[i]}"


def test_one_chunk_with_locators(spark):
    lines = ["CHƯƠNG II", "MỤC 1", "Điều 7. Thời hạn thực hiện", "1. Khoản", "a) Điểm"]
    chunks = chunking.build_chunks(classified(spark, lines)).collect()
    assert len(chunks) == 1
    c = chunks[0]
    assert (c.chunk_type, c.chapter, c.section, c.article) == ("LEGAL_CLAUSE", "Chương II", "Mục 1", "Điều 7")
    assert (c.start_block_id, c.end_block_id, c.order_index) == ("d-2", "d-4", 0)


def test_oversize_block_becomes_word_windows(spark):
    words = " ".join(f"w{i}" for i in range(25))
    c = chunking.build_chunks(classified(spark, ["mở", words, "kết"]), 10, 4).orderBy("order_index").collect()
    assert [x.content.split()[0] for x in c] == ["mở", "w0", "w6", "w12", "w18", "kết"]
    assert [x.order_index for x in c] == list(range(6))


def test_character_split(spark):
    text = "a" * 150 + " " + "b" * 100
    got = chunking.split_long(spark.createDataFrame([("x", text)], "k string, text string"), 200, 50).orderBy("piece").collect()
    assert [r.text for r in got] == ["a" * 150, "a" * 50 + " " + "b" * 100]


def test_model_batches(spark):
    df = spark.createDataFrame([("d", i, f"c{i}", 20) for i in range(25)], "document_id string, order_index long, chunk_id string, token_count long")
    sizes = chunking.model_batches(df).groupBy("batch_index").count().orderBy("batch_index").collect()
    assert [r["count"] for r in sizes] == [12, 12, 1]


def test_levels_alone_are_those_of_the_classification(spark, monkeypatch):
    """The content of sections needs no label: levels are found without writing the classified blocks."""
    lines = ["x", "CHƯƠNG\t II", "Số: 12/QĐ", "  Điều  7. Nội dung", "1. Quy định", "thân bài", "a) Điểm", " ", "BỘ TÀI CHÍNH", "CHỦ TỊCH", "Quyết định:", "(iv) mục con", "Phụ lục IV", "Mẫu số 02", "CHỮ HOA MUỘN", "", "　điều 5"] * 3
    for per_segment in (2, 4096):
        ordered = structure.order_blocks(blocks(spark, lines, per_page=5), blocks_per_segment=per_segment)
        full = structure.classify_blocks(ordered)
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        want = rows(full.select("ord", "text", "level")), rows(structure.section_content(full))
        with monkeypatch.context() as m:
            m.setattr(structure, "cut_lineage", None)
            found = structure.block_levels(ordered)
            assert (rows(found.select("ord", "text", "level")), rows(structure.section_content(found))) == want


def test_section_blocks_need_no_labels(spark):
    c = classified(spark, ["Điều 7. Nội dung", "1. Quy định", "a) Trường hợp A", "tiếp", "Điều 8. Hết", "x"])
    s = structure.parse_sections(c)
    narrow = structure.section_blocks(s, c.select("document_id", "seg", "ord", "block_id", "level"))
    starts = {r.section_id: r.start_block_id for r in s.collect()}
    got = {}
    for r in narrow.collect():
        got.setdefault(starts[r.section_id], set()).add(r.block_id)
    assert got == {"d-0": {"d-0", "d-1", "d-2", "d-3"}, "d-1": {"d-1", "d-2", "d-3"}, "d-2": {"d-2", "d-3"}, "d-4": {"d-4", "d-5"}}
