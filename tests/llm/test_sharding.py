import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from docgraph.llm import sharding as S


def bits(i):
    return format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b")


def check(rows, found, limit):
    assert sorted((str(r["doc_id"]), r["bytes"]) for r in found) == sorted((str(i), len((t or "").encode())) for i, t in rows)
    size = defaultdict(int)
    hashes = defaultdict(set)
    for i, t in rows:
        h = bits(i)
        for d in range(61):
            size[h[:d]] += len((t or "").encode())
            hashes[h[:d]].add(h)
    fits = lambda p: size[p] <= limit or len(hashes[p]) == 1
    pages = defaultdict(list)
    for r in found:
        h = bits(r["doc_id"])
        want = next(h[:d] for d in range(61) if fits(h[:d]))
        assert r["shard"] == want and r["depth"] == len(want)
        pages[r["shard"], r["page"]].append(r["bytes"])
    for (shard, page), sizes in pages.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        assert page == 0 or len(hashes[shard]) == 1


def test_every_shard_fits(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for limit in (1, 900, 20_000, 10**9):
        check(rows, S.assign(docs, shard_bytes=limit).collect(), limit)


def test_rows_of_one_hash_fill_pages(spark):
    rows = [(None, "x" * n) for n in (10, 20, 300, 30, 5, 90, 40, 40)] * 20 + [(i, "y" * 30) for i in range(100)]
    check(rows, S.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=100).collect(), 100)


def test_written_shards(docs, tmp_path, spark):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    S.write_shards(some, str(tmp_path / "shards"), shard_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == some.count()
    sizes = back.groupBy("_shard", "_page").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all((r["b"] or 0) <= 20_000 or r["n"] == 1 for r in sizes)


def test_rows_read_back_from_shards(docs, tmp_path, spark):
    for limit in (900, 20_000, 10**9):
        path = str(tmp_path / f"shards-{limit}")
        S.write_shards(docs, path, shard_bytes=limit)
        back = S.read_shards(spark, path, docs.schema)
        assert sorted(map(repr, back.select("row.*").collect())) == sorted(map(repr, docs.collect()))
        plain = back.select("row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)).alias("bytes"), "shard", F.length("shard").alias("depth"), "page")
        check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], plain.collect(), limit)


def test_null_and_repeated_ids_are_written_once_each(spark, tmp_path):
    rows = [(None, f"null {i} " * 5) for i in range(60)] + [(7, f"seven {i} " * 5) for i in range(40)] + [(i, "y" * 30) for i in range(100, 180)] + [(8, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    S.write_shards(df, str(tmp_path / "shards"), shard_bytes=300)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, df.collect()))
    check(rows, S.round_trip(df, shard_bytes=300).collect(), 300)


def test_columns_named_like_the_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * 50, "a", i, "b") for i in range(60)], "doc_id long, text string, _shard string, _PAGE long, __page string")
    S.write_shards(df, str(tmp_path / "shards"), shard_bytes=300)
    back = S.read_shards(spark, str(tmp_path / "shards"), df.schema).select("row.*")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert S.round_trip(df, shard_bytes=300).count() == 60


def test_empty_round_trip(no_docs):
    assert S.round_trip(no_docs).collect() == []


def test_empty_table(no_docs):
    assert S.assign(no_docs).collect() == []
