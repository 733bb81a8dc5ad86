"""Running article and clause: marks of a line are looked for once."""

from docgraph.operators import structure as S

BLOCK = "document_id string, page_index long, order_index long, block_id string, block_type string, text string"


def test_first_marked_line_of_a_block_counts(spark):
    texts = ["mở đầu", "Điều 7. Tên", "x\r\n  2) y\rĐiều 9", "điều 8a: b\n3. c", "", None, "Khoản 4. d\nArticle 5", "lời\n\n", "Điều12"]
    rows = [("d", 0, i, f"b{i}", "P", t) for i, t in enumerate(texts)]
    located = S.carry_locators(S.order_blocks(spark.createDataFrame(rows, BLOCK)))
    got = [(r["article"], r["clause"]) for r in located.orderBy("ord").collect()]
    seven, eight = ("Điều 7", None), ("điều 8a", None)
    assert got == [(None, None), seven, ("Điều 7", "Khoản 2"), eight, eight, eight, ("điều 8a", "Khoản 4"), ("điều 8a", "Khoản 4"), ("điều 8a", "Khoản 4")]
    plan = located._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "regexp_extract(" in line]
    assert scans and max(line.count("regexp_extract(") for line in scans) <= 2
