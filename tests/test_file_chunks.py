"""File chunks where a line is longer than a chunk may be."""

import duckdb

import __spark_entry__ as entry
from docgraph.operators import chunking


def test_query_keeps_a_line_above_the_limit_whole(spark, tmp_path):
    long = "từ " * 15_000
    texts = ["a\n" + long + "\nb", "\n".join(["c", "", long, long, "d"] * 3), long]
    rows = [(i, text, "vi") for i, text in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["E11_file_chunks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.sql(entry.oracle_sql()["E11_file_chunks"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))


def test_long_texts_are_split_unless_asked(spark):
    rows = [("f", 0, 0, "x" * 500, None, None), ("f", 0, 1, "y", None, None)]
    blocks = spark.createDataFrame(rows, "file_name string, seg long, ord long, text string, article string, clause string")
    whole = chunking.file_chunks(blocks, 200, 20, split=False).orderBy("sequence").collect()
    assert [r.text for r in whole] == ["x" * 500, "y"]
    assert len(chunking.file_chunks(blocks, 200, 20).collect()) > 2
