"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers floor(scale * x).  With one more coordinate,
sqrt(M^2 - |x|^2), all candidates lie on a sphere of radius M, and the distance d
to a query (whose extra coordinate is 0) obeys d^2 = |q|^2 + M^2 - 2 q.x: the
nearest candidates are those with the largest inner product.

Candidates are dealt into trees of about ``tree_rows`` rows, which are built side by
side and written as a table of pages.  A page holds entries: vector or routing
object, distance to the page's own routing object (the parent distance), and for
routing objects a covering radius and a child page.  Queries come in blocks; each
block visits each tree.  A query takes pages in the order of their lowest possible
distance, and drops an entry, without computing its distance, when the parent
distances and the radius already put it beyond the k-th best so far.  Bounds are
widened by a rounding margin and scores are exact, so ties are never lost.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import stored

#: Entries of a page; an array operation handles a page at once.
PAGE = 1_024
#: Queries of one block at most.
BLOCK_ROWS = 16_384
MARGIN = 1e-6
#: Stands for a null id inside the trees, so that such rows come last among ties.
NO_ID = np.iinfo(np.int64).max
#: Scores that a long can hold.
LEAST, MOST = -float(1 << 63), float((1 << 63) - 1024)


def integers(vector, scale: int):
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def usable(vector):
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def build_pages(points: np.ndarray, seed: int = 3) -> list[dict]:
    """Pages of the tree over the rows of ``points``, the root first.

    A group that does not fit a page gets up to ``PAGE`` routing objects, each point
    going to the nearest; a group that routing objects cannot tell apart (all points
    equal) is cut into equal pieces.
    """
    rng = np.random.default_rng(seed)
    pages: list[dict] = [{}]
    todo = [(0, np.arange(len(points)), None)]
    while todo:
        number, members, parent = todo.pop()
        to_parent = np.zeros(len(members)) if parent is None else np.sqrt(((points[members] - points[parent]) ** 2).sum(1))
        if len(members) <= PAGE:
            pages[number] = {"leaf": True, "object": members, "to_parent": to_parent}
            continue
        fan = min(PAGE, -(-len(members) // PAGE) * 2)
        chosen = rng.choice(members, fan, replace=False)
        squares = (points[members] ** 2).sum(1)[:, None] + (points[chosen] ** 2).sum(1)[None, :] - 2 * points[members] @ points[chosen].T
        nearest = squares.argmin(1)
        groups = [(c, members[nearest == i]) for i, c in enumerate(chosen)]
        groups = [(c, g) for c, g in groups if len(g)]
        if len(groups) == 1:
            groups = [(members[i], members[i : i + len(members) // 2 + 1]) for i in range(0, len(members), len(members) // 2 + 1)]
        objects, radii, children = [], [], []
        for center, group in groups:
            objects.append(center)
            radii.append(float(np.sqrt(((points[group] - points[center]) ** 2).sum(1).max())))
            children.append(len(pages))
            pages.append({})
            todo.append((children[-1], group, center))
        objects = np.array(objects)
        above = np.zeros(len(objects)) if parent is None else np.sqrt(((points[objects] - points[parent]) ** 2).sum(1))
        pages[number] = {"leaf": False, "object": objects, "to_parent": above, "radius": np.array(radii), "child": np.array(children)}
    return pages


PAGES = pa.schema([(n, pa.int64()) for n in ("tree", "page")] + [("leaf", pa.bool_())] + [(n, pa.binary()) for n in ("ids", "vectors", "to_parent", "radius", "child")] + [("longest", pa.float64())])
PAGES_SQL = "tree long, page long, leaf boolean, ids binary, vectors binary, to_parent binary, radius binary, child binary, longest double"


def tree_of(table: pa.Table) -> pa.Table:
    """The pages of one tree."""
    ids = table["id"].to_numpy()
    raw = np.array(table["vector"].to_pylist(), np.float64)
    order = np.lexsort((*raw.T[::-1], ids))
    ids, raw = ids[order], raw[order]
    squares = (raw**2).sum(1)
    longest = float(squares.max())
    points = np.column_stack([raw, np.sqrt(longest - squares)])
    out = {name: [] for name in PAGES.names}
    for number, page in enumerate(build_pages(points)):
        at = page["object"]
        for name, value in (
            ("tree", table["tree"][0].as_py()), ("page", number), ("leaf", page["leaf"]), ("ids", ids[at].astype("<i8").tobytes()), ("vectors", points[at].astype("<f8").tobytes()),
            ("to_parent", page["to_parent"].astype("<f8").tobytes()), ("radius", b"" if page["leaf"] else page["radius"].astype("<f8").tobytes()),
            ("child", b"" if page["leaf"] else page["child"].astype("<i8").tobytes()), ("longest", longest),
        ):
            out[name].append(value)
    return pa.table(out, PAGES)


class Tree:
    def __init__(self, table: pa.Table):
        table = table.sort_by("page")
        self.longest = table["longest"][0].as_py()
        self.pages = []
        for row in table.select(["leaf", "ids", "vectors", "to_parent", "radius", "child"]).to_pylist():
            ids = np.frombuffer(row["ids"], "<i8")
            self.pages.append((row["leaf"], ids, np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1), np.frombuffer(row["to_parent"], "<f8"), np.frombuffer(row["radius"], "<f8"), np.frombuffer(row["child"], "<i8").tolist()))

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than ``own``: highest score, then smallest id."""
        base = float(query @ query) + self.longest
        margin = MARGIN * (1 + np.sqrt(base))
        extended = np.append(query, 0.0)
        best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0)
        limit = np.inf
        waiting = [(0.0, 0, None)]
        while waiting:
            low, number, to_parent = heapq.heappop(waiting)
            if low > limit:
                break
            leaf, ids, vectors, parent, radius, child = self.pages[number]
            if to_parent is not None and limit < np.inf:
                keep = np.flatnonzero(np.abs(to_parent - parent) - (0 if leaf else radius) <= limit)
                if not len(keep):
                    continue
            else:
                keep = None
            products = (vectors if keep is None else vectors[keep]) @ extended
            if leaf:
                here = ids if keep is None else ids[keep]
                mine = here != own
                if len(best_scores) == k:
                    mine &= products >= best_scores[-1]
                if mine.any():
                    best_ids, best_scores = np.concatenate([best_ids, here[mine]]), np.concatenate([best_scores, products[mine]])
                    order = np.lexsort((best_ids, -best_scores))[:k]
                    best_ids, best_scores = best_ids[order], best_scores[order]
                    if len(best_scores) == k:
                        limit = np.sqrt(max(0.0, base - 2 * best_scores[-1])) + margin
            else:
                distance = np.sqrt(np.maximum(base - 2 * products, 0.0))
                lows = np.maximum(distance - (radius if keep is None else radius[keep]), 0.0) - margin
                for i, (d, b) in enumerate(zip(distance.tolist(), lows.tolist())):
                    if b <= limit:
                        heapq.heappush(waiting, (b, child[i if keep is None else keep[i]], d))
        return best_ids, best_scores


FOUND = pa.schema([("query_no", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_of(k: int):
    def run(queries: pa.Table, pages: pa.Table) -> pa.Table:
        if not queries.num_rows or not pages.num_rows:
            return FOUND.empty_table()
        tree = Tree(pages)
        numbers, own = queries["query_no"].to_numpy(), queries["id"].to_numpy()
        vectors = np.array(queries["vector"].to_pylist(), np.float64)
        parts = []
        for number, me, vector in zip(numbers.tolist(), own.tolist(), vectors):
            ids, scores = tree.nearest(me, vector, k)
            parts.append((np.full(len(ids), number), np.full(len(ids), me), ids, np.rint(np.clip(scores, LEAST, MOST)).astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=FOUND)

    return run


def top_inner_products(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, tree_rows: int = 65_536, block_rows: int | None = None,
) -> DataFrame:
    """Per query row its ``k`` best candidates: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vectors``.  Vectors that are null or hold a null or
    non-finite component take no part.  Vectors of unequal length meet over their common
    part, so an empty one scores 0.  A row without id is a candidate, the last one among
    ties, and no query.  A query never finds rows of its own id.  Of repeated query rows
    each distinct one is answered.  Products are exact below 2^53; larger ones are rounded
    like doubles and end at the bounds of a long.  Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("v")))
    asks = F.col("asks") & F.col("id").isNotNull()
    rows = stored(rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), integers(F.col("v"), scale).alias("vector"), asks.alias("asks")), "vectors")
    total, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    # Zeros up to the longest length leave every product as it is over the common part.
    rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), longest - F.size("vector"))))
    trees = max(1, -(-total // tree_rows))
    dealt = rows.select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(trees)).alias("tree"))
    pages = stored(dealt.groupBy("tree").applyInArrow(tree_of, PAGES_SQL), "pages")
    asked = rows.where("asks").select("id", "vector").distinct()
    asked = asked.withColumn("query_no", F.xxhash64("id", "vector"))
    n_asked = rows.where("asks").count()
    if block_rows is None:
        # Two groups for each core, as long as the blocks of queries stay within bounds.
        wanted = -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // trees)
        blocks = max(-(-n_asked // BLOCK_ROWS), min(-(-n_asked // 64), wanted), 1)
    else:
        blocks = max(1, -(-n_asked // block_rows))
    # Every (block of queries, tree) is one group.
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "query_no"), F.lit(blocks))).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("tree", F.col("tree").cast("long"))
    spread = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    found = asked.groupBy("block", "tree").cogroup(spread.groupBy("block", "tree")).applyInArrow(search_of(k), "query_no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
