"""Red-flag rules over a property graph.

A flag is a row (issue_type, severity, anchor).  The edges behind a flag are
joined as rows of their own, so a node with very many edges is never gathered
into one array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as X
from docgraph.operators.ordered import dealt

CRITICAL_CONFIDENCE = 0.75
# Severity of each rule.
SEVERITY = {
    "MISSING_RESPONSIBLE_ACTOR": "HIGH", "MISSING_LEAD_AGENCY": "HIGH", "MISSING_DEADLINE": "MEDIUM",
    "DOSSIER_WITHOUT_RECEIVING_AUTHORITY": "HIGH", "MISSING_BUDGET_AMOUNT": "MEDIUM", "MISSING_FUNDING_SOURCE": "HIGH",
    "BROKEN_LEGAL_REFERENCE": "MEDIUM", "MISSING_REFERENCED_FORM": "MEDIUM", "LOW_CONFIDENCE_CRITICAL_TEXT": "CRITICAL",
    "MULTIPLE_LEAD_AGENCIES": "HIGH", "CONFLICTING_RESPONSIBILITY": "CRITICAL", "DEADLINE_WITHOUT_OUTPUT": "HIGH",
    "CONFLICTING_DEADLINE": "HIGH", "CONFLICTING_BUDGET": "CRITICAL",
}
# Node types, relation and direction whose absence raises a flag.
ABSENT = {
    "MISSING_RESPONSIBLE_ACTOR": (("TASK", "RESPONSIBILITY"), "ASSIGNS_RESPONSIBILITY", ("in",)),
    "MISSING_LEAD_AGENCY": (("TASK", "PROCEDURE"), "LEADS", ("in",)),
    "MISSING_DEADLINE": (("TASK",), "HAS_DEADLINE", ("out",)),
    "DOSSIER_WITHOUT_RECEIVING_AUTHORITY": (("DOSSIER",), "SUBMITS", ("out",)),
    "MISSING_FUNDING_SOURCE": (("BUDGET",), "HAS_FUNDING_SOURCE", ("in", "out")),
}


def _flag(rule: str, kind: str, anchor: Column) -> list[Column]:
    return [
        F.lit(rule).alias("issue_type"), F.lit(SEVERITY[rule]).alias("severity"),
        F.lit(kind).alias("anchor_kind"), anchor.alias("anchor_id"),
    ]


def _ends(edges: DataFrame, relation: str, sides: tuple[str, ...]) -> DataFrame:
    column = {"in": "target_node_id", "out": "source_node_id"}
    picked = edges.where(F.col("type") == relation)
    return reduce(
        DataFrame.unionByName, [picked.select(F.col(column[s]).alias("node_id")) for s in sides]
    )


def absent(nodes: DataFrame, edges: DataFrame, rule: str) -> DataFrame:
    """Nodes without the relation they need."""
    types, relation, sides = ABSENT[rule]
    wanted = dealt(nodes.where(F.col("type").isin(*types)), "node_id")
    return wanted.join(_ends(edges, relation, sides), "node_id", "left_anti").select(*_flag(rule, "NODE", F.col("node_id")))


def missing_amount(nodes: DataFrame) -> DataFrame:
    """Only the property ``amount`` is read, as the reference's rule does."""
    return nodes.where("type = 'BUDGET' and coalesce(amount, '') = ''").select(
        *_flag("MISSING_BUDGET_AMOUNT", "NODE", F.col("node_id"))
    )


def broken_reference(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """R7."""
    linked = _ends(edges, "REFERENCES", ("in", "out")).distinct().withColumn("linked", F.lit(True))
    refs = dealt(nodes.where("type = 'LEGAL_REFERENCE'"), "node_id").join(linked, "node_id", "left")
    return refs.where("coalesce(resolved, '') = 'false' or linked is null").select(
        *_flag("BROKEN_LEGAL_REFERENCE", "NODE", F.col("node_id"))
    )


def missing_form(nodes: DataFrame) -> DataFrame:
    """R8."""
    hit = "type = 'LEGAL_REFERENCE' and target_type = 'FORM' and resolved = 'false'"
    return nodes.where(hit).select(*_flag("MISSING_REFERENCED_FORM", "NODE", F.col("node_id")))


def low_confidence(nodes: DataFrame, edges: DataFrame, threshold: float = CRITICAL_CONFIDENCE) -> DataFrame:
    """Critical nodes and edges of low confidence."""
    weak = (F.col("importance") == "CRITICAL") & (F.col("confidence") < threshold)
    rule = "LOW_CONFIDENCE_CRITICAL_TEXT"
    return nodes.where(weak).select(*_flag(rule, "NODE", F.col("node_id"))).unionByName(
        edges.where(weak).select(*_flag(rule, "EDGE", F.col("edge_id")))
    )


def crowded(edges: DataFrame, rule: str, relation: str) -> DataFrame:
    """Targets with more than one incoming edge; the target may be missing."""
    counts = dealt(edges.where(F.col("type") == relation).select("target_node_id"), "target_node_id").groupBy("target_node_id").agg(F.count("*").alias("n")).where("n > 1")
    return counts.select(*_flag(rule, f"IN:{relation}", F.col("target_node_id")))


def deadline_without_output(edges: DataFrame) -> DataFrame:
    """R12."""
    timed = edges.where("type = 'HAS_DEADLINE'").select(F.col("source_node_id").alias("node_id")).distinct()
    made = _ends(edges, "PRODUCES", ("out",))
    return timed.join(made, "node_id", "left_anti").select(
        *_flag("DEADLINE_WITHOUT_OUTPUT", "OUT:HAS_DEADLINE", F.col("node_id"))
    )


def differing(nodes: DataFrame, edges: DataFrame, rule: str, relation: str) -> DataFrame:
    """Several targets whose values differ; smallest against largest
    value tells that, with no set of values kept."""
    name = "canonical_name" if "canonical_name" in nodes.columns else "name"
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    value = F.coalesce(
        F.when(filled("amount") != "0", filled("amount")), F.when(filled("value") != "0", filled("value")),
        filled(name), F.col("name"),
    )
    values = nodes.select(F.col("node_id").alias("target_node_id"), X.fold(value).alias("v"))
    picked = dealt(edges.where(F.col("type") == relation).select("source_node_id", "target_node_id"), "target_node_id")
    joined = picked.join(values, "target_node_id", "left").withColumn("v", F.coalesce("v", "target_node_id"))
    groups = dealt(joined, "source_node_id").groupBy("source_node_id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return groups.where("n > 1 and lo <> hi").select(*_flag(rule, f"OUT:{relation}", F.col("source_node_id")))


def evaluate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All rules; R15 keeps one flag per rule and anchor."""
    found = [absent(nodes, edges, rule) for rule in ABSENT]
    found += [
        missing_amount(nodes), broken_reference(nodes, edges), missing_form(nodes), low_confidence(nodes, edges),
        crowded(edges, "MULTIPLE_LEAD_AGENCIES", "LEADS"),
        crowded(edges, "CONFLICTING_RESPONSIBILITY", "ASSIGNS_RESPONSIBILITY"),
        deadline_without_output(edges),
        differing(nodes, edges, "CONFLICTING_DEADLINE", "HAS_DEADLINE"),
        differing(nodes, edges, "CONFLICTING_BUDGET", "HAS_BUDGET"),
    ]
    flags = dealt(reduce(DataFrame.unionByName, found), "anchor_id").distinct()
    return flags.withColumn("flag_id", X.stable_id("flag", F.col("issue_type"), F.col("anchor_kind"), F.col("anchor_id")))


def flag_edges(flags: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (flag_id, edge_id): the edges each flag points to."""
    direct = flags.where("anchor_kind = 'EDGE'").select("flag_id", F.col("anchor_id").alias("edge_id"))
    grouped = flags.where("anchor_kind like 'IN:%' or anchor_kind like 'OUT:%'")
    keyed = edges.select(
        "edge_id",
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("IN:"), "type").alias("anchor_kind"), F.col("target_node_id").alias("anchor_id")),
                F.struct(F.concat(F.lit("OUT:"), "type").alias("anchor_kind"), F.col("source_node_id").alias("anchor_id")),
            )
        ).alias("k"),
    ).select("edge_id", "k.*")
    return direct.unionByName(grouped.join(keyed, ["anchor_kind", "anchor_id"]).select("flag_id", "edge_id"))


#: Pieces in which the elements of a flag are hashed.
SET_PIECES = 1_024
#: Links of a flag whose elements meet in one row; those of one with more meet piece by piece.
ROW_LINKS = 1_024


def dedup_drafts(drafts: DataFrame, links: DataFrame, order: str = "ord") -> DataFrame:
    """R15 for flags from elsewhere: same rule, same nodes and edges; the first stays,
    with the number of drafts it stands for as ``merged``.

    ``links``: flag_id, kind, element_id.  Sets are compared by a SHA-256 digest: the digests of
    the elements, sorted and hashed in ``SET_PIECES`` pieces by their hash, and the pieces hashed
    again.  A flag of up to ``ROW_LINKS`` links does that in its row, after one shuffle of the names;
    the others, at most a ``ROW_LINKS``-th of the links, are broadcast, and no row holds all their elements.
    """
    piece_of = lambda e: F.pmod(F.xxhash64(e), F.lit(SET_PIECES))
    joined = lambda c: F.unhex(F.sha2(F.array_join(F.transform(F.sort_array(c), F.hex), ""), 256))
    hashed = lambda c: joined(F.transform(c, lambda e: F.unhex(F.sha2(e, 256))))
    named = lambda piece, d: F.concat(F.unhex(F.lpad(F.hex(piece), 8, "0")), d)
    wide = links.groupBy("flag_id").agg(F.count("*").alias("n")).where(F.col("n") > ROW_LINKS).select("flag_id", F.lit(True).alias("wide"))
    marked = links.select("flag_id", F.concat_ws("\x1f", "kind", "element_id").alias("e")).join(F.broadcast(wide), "flag_id", "left")
    few = marked.where("wide IS NULL").groupBy("flag_id").agg(F.collect_set("e").alias("e"))
    pieces = F.transform(
        F.array_distinct(F.transform("e", piece_of)), lambda piece: named(piece, hashed(F.filter("e", lambda e: piece_of(e) == piece)))
    )
    few = few.select("flag_id", joined(pieces).alias("few"))
    many = marked.where("wide").groupBy("flag_id", piece_of(F.col("e")).alias("piece")).agg(F.collect_set("e").alias("e"))
    many = many.select("flag_id", named(F.col("piece"), hashed(F.col("e"))).alias("d")).groupBy("flag_id").agg(joined(F.collect_list("d")).alias("many"))
    keyed = drafts.join(few, "flag_id", "left").join(many, "flag_id", "left").withColumn("digest", F.coalesce("few", "many"))
    rest = [c for c in drafts.columns if c not in ("issue_type", order)]
    first = keyed.groupBy("issue_type", "digest").agg(F.min(F.struct(order, *rest)).alias("_first"), F.count("*").alias("merged"))
    return first.select("issue_type", "_first.*", "merged").select(*drafts.columns, "merged")
