import hashlib
import re
from collections import Counter

import pytest

from docgraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


ODD = [
    None, "", "mail a.b+c@x.example.com now", "a@b.c%d@e.f a@b a@b..c x@y.z.", "..@--.-- @a.b a@@b.c a@b@c.d", "é🤦a@b.cd 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.01", "1.2.3 1.2.3.4.", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "41111111111111111 4111111111111111x 1 4111111111111111", "+1 (389) 555-5010, +49 30 1234567 +123 +1((((((2 ++1 2345678", "call (389) 555-5010 or 389-555-5010 today", "write to john (at) example (dot) com", "version 1.2.3.4", "a@b.c @x.y",
    "2001:0db8:0000:0000:0000:ff00:0042:8329 host", "9" * 30_000, "1." * 20_000, "a@" + "b." * 20_000 + "c", "+1" + "(" * 20_000, "card 378282246310005", "0000 0000 0000 0000", "x@y.z\n+33 1 23 45 67 89\n192.168.0.1", "12 34 5 6 " * 50,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(2, ODD[2]), (None, ODD[2])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_base_spans_equal_brute_force(odd):
    found = pii.find(odd).select("row.doc_id", "row.text", pii.listing(pii.F.col("base")).alias("base"), pii.listing(pii.F.col("spans")).alias("spans")).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        want = [":".join(map(str, s)) for s in base_spans(r["text"] or "")]
        assert r["base"] == ",".join(want), r["text"][:80]
        assert set(want) <= set(filter(None, r["spans"].split(",")))


def test_contract_digest(docs):
    got = Counter((r[0], r[1]) for r in pii.find(docs).select("row.doc_id", pii.F.sha2(pii.listing(pii.F.col("base")), 256)).collect())
    want = Counter((r["doc_id"], hashlib.sha256(",".join(":".join(map(str, s)) for s in base_spans(r["text"] or "")).encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_model_learns_the_checks_and_adds_spans(spark):
    rows = [(i, f"call me at +1 (212) 555-{1000 + i} please") for i in range(40)] + [(100 + i, f"phone (389) 555-{2000 + i} today") for i in range(30)] + [(200 + i, f"order no 12345678901234{i:02d} sent") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r[0]: r[1] for r in pii.find(df).select("row.doc_id", pii.listing(pii.F.col("spans"))).collect()}
    assert all(found[i] for i in range(40))
    assert all(found[100 + i].startswith("phone:6:") for i in range(30))


def test_redaction(odd, docs):
    clean = {r["doc_id"]: r["text"] for r in pii.redact(odd).where("doc_id is not null and doc_id <> 2").collect()}
    assert clean[0] is None and clean[1] == ""
    assert clean[21] == "<EMAIL>\n<PHONE>\n<IP>"
    assert clean[12].startswith("version") and "9" * 30_000 == clean[15]
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_empty_table(no_docs):
    assert pii.find(no_docs).collect() == [] and pii.redact(no_docs).collect() == []


def test_scan_equals_running_values(spark):
    rows = [([],), ([5],), ([3, 1, 2],), (list(range(100, 0, -1)),), ([1] * 1_025,)]
    df = spark.createDataFrame(rows, "v array<int>")
    for got in df.select("v", pii.scan(pii.F.col("v"), lambda a, b: a + b).alias("sums"), pii.scan(pii.F.col("v"), pii.F.least, back=True).alias("least")).collect():
        v = got["v"]
        assert got["sums"] == [sum(v[: i + 1]) for i in range(len(v))]
        assert got["least"] == [min(v[i:]) for i in range(len(v))]


def test_spans_of_either_kind_are_kept_apart(spark):
    """Failed and loose spans that touch a base one go, whichever starts first."""
    texts = ["a@b.c 1.2.3.4", "+1 4111 1111 1111 1111", "(389) 555-5010 x (at) y.com a@b.c", "999.1.1.1 +1 (212) 555-1234 4111111111111112", "é" * 300 + "a@b.c" + "🤦" * 600 + "+1 (212) 555-1234 999.1.1.1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pii.with_candidates(rows).collect():
        base = [(s["start"], s["end"]) for s in r["base"]]
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]] == base_spans(r["text"])
        assert all(not (a < s["end"] and s["start"] < b) for s in r["others"] for a, b in base)


def test_a_long_text_of_many_spans(spark):
    """100,000 spans in one text of some MB: no step takes time by the square of the spans."""
    line = "é mail john.doe{0}@example.com, call +1 (212) 555-{1:04d} or 999.1.1.1 from 10.0.{2}.{3} at noon;\n"
    text = "".join(line.format(i, i % 10_000, i // 256 % 256, i % 256) for i in range(25_000))
    rows = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["base"] for r in pii.find(rows).select("row.doc_id", pii.listing(pii.F.col("base")).alias("base")).collect()}
    assert got[1] == ",".join(":".join(map(str, s)) for s in base_spans(text)) and got[2] == got[3] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    want = "".join("é mail <EMAIL>, call <PHONE> or 999.1.1.1 from <IP> at noon;\n" for _ in range(25_000))
    assert clean[1] == want and clean[3] is None
