"""Segments of documents: short documents have one, long ones many, with the same trees."""

from pyspark.sql import functions as F

from docgraph.operators import structure
from test_structure import blocks


def test_a_short_document_of_many_pages_is_one_segment(spark):
    lines = ["Điều 1. x", "1. x", "a) x", "thân bài", "2. y", "Điều 2. y", "1. z"] * 6
    short = structure.order_blocks(blocks(spark, lines, per_page=2))
    long = structure.order_blocks(blocks(spark, lines, per_page=2), blocks_per_segment=4)
    assert short.select("seg").distinct().count() == 1
    assert long.select("seg").distinct().count() == 21
    rows = lambda b: sorted(map(str, structure.parse_sections(structure.classify_blocks(b)).drop("seg").collect()))
    assert rows(short) == rows(long) and len(rows(short)) == 36


def test_sections_of_short_documents_are_shuffled_once(spark):
    c = structure.classify_blocks(structure.order_blocks(blocks(spark, ["Điều 1. x", "1. x", "b"], per_page=1)))
    plan = structure.parse_sections(c)._jdf.queryExecution().optimizedPlan().toString()
    # The branches of summaries read rows with a segment only.
    assert plan.count("isnotnull(seg") >= 4
    s = structure.parse_sections(c)
    assert {(r.parent_ord is None, r.ord) for r in structure.children(s).collect()} == {(True, 0), (False, (1 << 32) + 1)}
