import random
from collections import Counter

from docgraph.operators import citations as C
from docgraph.operators import regulatory as R


def boxes(rng, n, name):
    out = []
    for k in range(n):
        x, y = rng.uniform(-100, 600), rng.uniform(-50, 800)
        w, h = rng.choice([0, 3, 40, 64, 500]), rng.choice([0, 12, 128, 700])
        out.append((rng.randrange(2), rng.randrange(3), f"{name}{k}", (float(x), float(y), float(x + w), float(y + h))))
    out.append((0, 0, f"{name}grid", (64.0, 64.0, 128.0, 128.0)))
    out.append((0, 0, f"{name}null", None))
    return out


def test_blocks_meet_the_regions_they_touch_once(spark):
    rng = random.Random(3)
    kind = "document_id long, page_index long, {} string, {} struct<x1: double, y1: double, x2: double, y2: double>"
    blocks, regions = boxes(rng, 150, "b"), boxes(rng, 60, "r")
    got = C.region_text(spark.createDataFrame(blocks, kind.format("block", "bbox")), spark.createDataFrame(regions, kind.format("region_id", "region")))
    want = Counter(
        (b[2], r[2]) for b in blocks for r in regions
        if b[:2] == r[:2] and b[3] and r[3] and b[3][0] <= r[3][2] and r[3][0] <= b[3][2] and b[3][1] <= r[3][3] and r[3][1] <= b[3][3]
    )
    assert Counter((x["block"], x["region_id"]) for x in got.select("block", "region_id").collect()) == want and len(want) > 50


def test_sections_and_tenants_are_limited_only_on_demand(spark):
    sections = spark.createDataFrame([("v", k, 0, f"Điều {k}", "x" * 400) for k in range(7)], "version_id string, ord long, part int, legal_location string, content string")
    assert R.first_sections(sections).count() == 7
    first = R.first_sections(sections, keep=5, quote_chars=300).orderBy("ord").collect()
    assert [r["location"] for r in first] == [f"Điều {k}" for k in range(5)] and {len(r["quote"]) for r in first} == {300}
    versions = spark.createDataFrame([(f"v{k}", k % 2, k % 3) for k in range(6)], "version_id string, family_id long, workspace_id long")
    documents = spark.createDataFrame([(0, 9), (1, 8)], "family_id long, document_rows long")
    assert R.versions_with_documents(versions, documents).count() == 6
    assert {(r["version_id"], r["versions"]) for r in R.versions_with_documents(versions, documents, [0]).collect()} == {("v0", 3), ("v3", 3)}
