import json

from docgraph.operators import audit as A
from docgraph.operators import rules as R

PARTS = ("password", "passwd", "token", "authorization", "cookie", "secret", "credential")


def brute(value):
    if isinstance(value, dict):
        out = {}
        for k in sorted(value):
            out[k[:128]] = "[REDACTED]" if any(p in k[:128].lower() for p in PARTS) else brute(value[k])
        return out
    if isinstance(value, list):
        return [brute(v) for v in value[:100]]
    return value[:1024] if isinstance(value, str) else value


def test_nested_metadata(spark):
    long_key = "k" * 128
    cases = [
        {"a": 1, "b": None, "c": True, "Access_Token": "x", "d": "é\"\\\n" + "t" * 2_000},
        {"list": list(range(120)), "deep": [{"userPassword": {"p": 1}, "ok": [[], {}, [1, "x", None]]}, "s", 2.5]},
        {}, [], [{"cookies": [1], "z": {"y": {"x": {"secretary": 1, "w": -7}}}}], "plain", 7,
        {long_key + "a": 1, long_key + "b": {"q": 2}, "k" * 110 + "token" + "z" * 40: 3, "k" * 126 + "token": 4},
        {"": 1, "ß": [False], "A": {"b": "x" * 1_025}},
    ]
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(90, None), (91, "{broken")]
    df = spark.createDataFrame(rows, "event_id long, metadata string").repartition(3)
    got = {r["event_id"]: r["metadata"] for r in A.sanitized_json(df, "event_id", "metadata").collect()}
    assert got.pop(90) is None and got.pop(91) is None
    assert {i: json.loads(m) for i, m in got.items()} == {i: brute(c) for i, c in enumerate(cases)}
    assert A.sanitized_json(df.limit(0), "event_id", "metadata").collect() == []


def test_flags_of_different_edges_are_not_merged_by_equal_xors(spark):
    """Sets are told apart by digests of all their elements; flags of equal sets keep the first."""
    drafts = spark.createDataFrame([("f1", "R", 1), ("f2", "R", 2), ("f3", "R", 3), ("f4", "Q", 4), ("f5", "R", 5)], "flag_id string, issue_type string, ord int")
    links = [("f1", "EDGE", f"e{k}") for k in range(3_000)] + [("f2", "EDGE", f"e{k}") for k in reversed(range(3_000))] + [("f3", "EDGE", f"e{k}") for k in range(2_999)]
    links += [("f4", "EDGE", f"e{k}") for k in range(3_000)] + [("f2", "EDGE", "e5")]
    kept = R.dedup_drafts(drafts, spark.createDataFrame(links, "flag_id string, kind string, element_id string"))
    assert {r["flag_id"] for r in kept.collect()} == {"f1", "f3", "f4", "f5"}
