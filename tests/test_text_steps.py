"""Helpers that every text passes: same results as the regexes and joins they stand for, at a fraction of the work."""

import random

from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import regulatory as R
from docgraph.operators import structure


def test_strip_and_fold_equal_their_definitions(spark):
    rng = random.Random(1)
    odd = [chr(c) for c in [*range(0x0, 0x30), *range(0x7F, 0xA2), 0x1680, 0x180E, *range(0x1FFF, 0x2070), 0x3000, 0xFEFF, 0x1F600]] + list("aςßΣẞĐ")
    texts = ["", " ", "\n", "a\n", "\r\na b\r\n"] + [c + "x" + c for c in odd] + ["".join(rng.choice(odd) for _ in range(rng.randrange(9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    stripped = F.regexp_replace("t", rf"^{X.SPACE}+|{X.SPACE}+$", "")
    folded = F.replace(F.translate(F.lower("t"), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    bad = rows.where(~X.strip(F.col("t")).eqNullSafe(stripped) | ~X.fold(F.col("t")).eqNullSafe(folded)).collect()
    assert not bad


def test_facts_are_located_in_their_row(spark):
    texts = [
        "Điều 1. A\nNGƯỠNG  phê duyệt - 1,5 Tỷ đồng\nĐiều 2: B\nThời hạn báo cáo 7 tháng\nKhoản 3\ncơ quan phê duyệt:  Sở X ; y",
        "Ngưỡng\nphê duyệt: 5 triệu đồng", "Đơn vị phê duyệt:   \nĐiều 4. x", "không có gì", "", None,
        "Điều 9\n1,5 tỷ đồng\nĐiều 10\nngưỡng phê duyệt: 1,5 tỷ đồng triệu đồng",
    ]
    rows = [(f"v{i}", f"d{i}", t) for i, t in enumerate(texts)]
    versions = spark.createDataFrame(rows, "version_id string, document_id string, raw_text string")
    names = ["version_id", "fact_key", "document_id", "value", "quote", "location"]
    got = R.located_facts(versions)
    want = R.locate(R.facts(versions), structure.legal_locations(versions))
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert got.count() > 5 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = X.strip(F.regexp_extract("raw_text", R.FACTS["approval_threshold"][0], 1))
    assert R.facts(versions).where("fact_key = 'approval_threshold'").count() == versions.where(found != "").count()
