"""Registered queries of this folder and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import bpe, fill_middle, metric_search, minhash, mixing, pii, quality, sharding, simhash, spelling, substring_dedup, token_files, toxicity

QUERIES = {}
SQL = {}


def register(name: str, sql: str | None = None):
    def take(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return take


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP1 = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM words, unnest(generate_series(1, len(w) - 12)) AS g(i)
), least AS (
  SELECT s, min(doc_id) AS least FROM windows GROUP BY s
), bad AS (
  SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN least USING (s), generate_series(0, 12) AS k(j) WHERE least < doc_id
), kept AS (
  SELECT doc_id, array_agg(w[p] ORDER BY p) AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM words) ANTI JOIN bad USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(len(k), 0))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@register("op1_substring_dedup", OP1)
def op1(spark, folder):
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_bpe_round_trip")
def op2(spark, folder):
    return bpe.encode_decode(table(spark, folder, "documents"), with_ids=False)


OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@register("op3_mtree_top_k", OP3)
def op3(spark, folder):
    return metric_search.top_inner_products(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op4_pii_weak_supervision")
def op4(spark, folder):
    found = pii.find(table(spark, folder, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"), pii.listing(F.col("spans")).alias("spans"))


@register("op5_toxicity_cnn")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.classifier(docs, table(spark, folder, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@register("op6_rans_token_files")
def op6(spark, folder):
    return token_files.round_trip(table(spark, folder, "documents"))


@register("op7_simhash_covering")
def op7(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


OP8 = """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), nodes AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) <= 1048576 OR min(h) = max(h) AS fits
  FROM d, generate_series(0, 60) AS g(depth) GROUP BY 1, 2
), placed AS (
  SELECT d.doc_id, d.bytes, d.h, min(depth) AS depth FROM d, nodes WHERE fits AND prefix = d.h >> (60 - depth) GROUP BY ALL
)
SELECT doc_id, bytes::BIGINT AS bytes, substr(lpad(to_binary(h), 60, '0'), 1, depth::INT) AS shard, depth::INT AS depth, 0::BIGINT AS page FROM placed
"""


@register("op8_extendible_sharding", OP8)
def op8(spark, folder):
    return sharding.round_trip(table(spark, folder, "documents"))


@register("op9_source_mix")
def op9(spark, folder):
    mix = mixing.plan_mix(table(spark, folder, "documents"))
    return mix.rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op10_compression_bands")
def op10(spark, folder):
    return quality.quality(table(spark, folder, "documents"))


def crc_table() -> list[int]:
    """The table of CRC-32, by its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


OP11 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY doc_id, run
), hexed AS (
  SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substring(x, 2 * i - 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, {crc_table()}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM hexed
), spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), vocabulary AS (
  SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cuts AS (
  SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT cuts.word, v.word FROM cuts JOIN vocabulary v ON cut = v.word
  UNION SELECT v.word, cuts.word FROM cuts JOIN vocabulary v ON cut = v.word
), ranked AS (
  SELECT a, b, v.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS place FROM near JOIN vocabulary v ON b = v.word
), found AS (
  SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * v.n THEN b END AS form, CASE WHEN r.n >= 5 * v.n THEN r.n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON a = word AND place = 1
), walk AS (
  SELECT word, word AS last, form AS next FROM found UNION ALL SELECT walk.word, next, found.form FROM walk JOIN found ON next = found.word
)
SELECT word, form, last AS root, n, n_near, form_n FROM found JOIN walk USING (word) WHERE next IS NULL
"""


@register("op11_spelling_variants", OP11)
def op11(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


OP12 = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents
), draws AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens
), parts AS (
  SELECT *, array_to_string(w[1:least(a, b)], '') AS prefix, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(w[greatest(a, b) + 1:], '') AS suffix
  FROM draws
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@register("op12_fill_in_middle", OP12)
def op12(spark, folder):
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


OP13 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS i FROM words
), runs AS (
  SELECT doc_id, n, i, w || coalesce(' ' || lead(w, 1) OVER o, '') || coalesce(' ' || lead(w, 2) OVER o, '') || coalesce(' ' || lead(w, 3) OVER o, '') AS x
  FROM listed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, x FROM runs WHERE i <= greatest(n - 4, 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS shared FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT p, q FROM common JOIN sizes a ON a.doc_id = p JOIN sizes b ON b.doc_id = q WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), edges AS MATERIALIZED (
  SELECT p, q FROM links UNION ALL SELECT q, p FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, q FROM reach JOIN edges ON r = p
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""


@register("op13_minhash_stars", OP13)
def op13(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))
