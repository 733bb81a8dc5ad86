"""H18 next to its SQL on texts without a segment, unusual white space and keys that repeat."""

import duckdb

from docgraph.plans import all_queries

NAME = "H18_best_quote"
TEXTS = [None, "", " ", "\n \n", "x\r\none two. y\r\n", ".\x0btwo one", "three. one two ", "　one two. b", "one. two. one two b", "one " * 300]


def test_best_quote_as_its_sql(spark, tmp_path):
    documents = [(i, text) for i, text in enumerate(t for t in TEXTS for _ in range(4))] + [(4, "late"), (4, "one two three")]
    benchmark = [(0, "one two"), (1, None), (2, "b y"), (2, "one two b")]
    spark.createDataFrame(documents, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    queries, sql = all_queries()
    got = sorted(tuple(r) for r in queries[NAME](spark, str(tmp_path)).select("doc_id", "quote").collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.sql(sql[NAME]).fetchall())
    assert got == want
    assert {"x\r", ".\x0btwo one"} <= {quote for _, quote in want} and len({i for i, _ in got}) == len(got)
