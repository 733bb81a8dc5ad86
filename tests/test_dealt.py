from pyspark.sql import functions as F

from docgraph.operators import graph as G
from docgraph.operators import ordered
from docgraph.operators import rules as R
from docgraph.sources import views
from docgraph.sources.tables import Tables


def test_tasks_follow_the_size_of_the_input(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, e = views.kg_nodes(t), views.kg_edges(t)
    assert ordered.dealt(n, "node_id") is n
    rows = lambda df: sorted(map(tuple, df.collect()))
    merged = lambda: G.merge_nodes(n.withColumn("normalized_key", F.lower("name")), ["document_id"])[0]
    found = lambda: [rows(df) for df in (merged(), G.endpoint_issues(n, e), R.evaluate(n, e))]
    want = found()
    assert all(want)
    monkeypatch.setattr(ordered, "TASK_BYTES", 16 << 10)
    monkeypatch.setattr(views, "LINES_PER_TASK", 4 << 10)
    tasks = ordered.dealt(n, "node_id").rdd.getNumPartitions()
    assert tasks > 2 * session and views.lines(t).rdd.getNumPartitions() > session
    assert f", {tasks})" in merged()._jdf.queryExecution().toString()
    n, e = views.kg_nodes(t), views.kg_edges(t)
    assert found() == want
