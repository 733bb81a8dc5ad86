"""Nothing is cut or lost where no limit is asked for."""

from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators import governance as O
from docgraph.operators import graph as G
from docgraph.operators import retrieval as Q
from docgraph.operators.packing import Packing, pack


def test_all_provisions_and_facts_are_kept(spark):
    article = lambda i: f"Điều {i}. Mục {i}\n" + "\n".join(f"Báo cáo trong vòng {k + 1} ngày." for k in range(3 if i <= 100 else 2))
    chunks = spark.createDataFrame([("d", f"k{i}", i, article(i), None) for i in range(1, 201)], "document_id string, chunk_id string, chunk_order long, content string, article string")
    assert G.sentence_facts(chunks.withColumn("parent_id", F.lit("p"))).count() == 500
    assert G.sentence_facts(chunks.withColumn("parent_id", F.lit("p")), 40).count() == 40
    docs = spark.createDataFrame([("d", "Tên")], "document_id string, name string")
    nodes, _ = G.extract(chunks, docs)
    assert nodes.where("type = 'LEGAL_PROVISION'").count() == 200
    assert G.extract(chunks, docs, max_provisions=80)[0].where("type = 'LEGAL_PROVISION'").count() == 80


def test_long_names_are_found_and_stay_apart(spark):
    head = "lập báo cáo " * 40
    rows = [("d", f"k{i}", i, f"Bộ {'Tài chính ' * 30}chủ trì {head} số {i}.", None) for i in range(2)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_order long, content string, article string")
    nodes, _ = G.extract(chunks, spark.createDataFrame([("d", "Tên")], "document_id string, name string"))
    tasks = nodes.where("type = 'TASK'").select("node_id", "name").distinct().collect()
    assert len({r.node_id for r in tasks}) == 2


def test_family_keys_differ_after_300_letters(spark):
    title = "quy định " * 40
    row = spark.range(1).select(*[X.family_key(F.lit(title + end), F.lit("1"), F.lit(None).cast("string")).alias(end) for end in ("một", "hai")]).first()
    assert row[0] != row[1]


def test_four_queries(spark):
    q = spark.createDataFrame([("q", "Thời hạn và kinh phí", 2)], "question_id string, question string, document_count int")
    assert Q.build_queries(q).count() == 4


def test_waiting_jobs_have_no_cap(spark):
    jobs = spark.range(250).selectExpr("cast(id as string) job_id", "timestamp_seconds(id) created_at", "'UPLOADED' status")
    assert O.pending_jobs(jobs).count() == 250 and O.pending_jobs(jobs, 100).count() == 100


def test_a_part_longer_than_the_halo_is_packed(spark):
    weights = [1] * 3_000 + [0] * 6_000 + [1] * 3_000
    items = spark.createDataFrame([("g", i, w) for i, w in enumerate(weights)], "g string, pos long, weight long")
    for rule in (Packing(800), Packing(800, overlap=50), Packing(800, overlap=0, max_items=5_000), Packing(800, split_oversize=True)):
        cut = pack(items, ["g"], rule, piece=1_024, halo=256)
        whole = pack(items, ["g"], rule)
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, pack(items, ["g"], rule, piece=20_000).collect())) == sorted(map(tuple, whole.collect()))
