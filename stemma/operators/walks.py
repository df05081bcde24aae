"""Structural questions over scored graphs: support trees, closures, signed walks, rankings, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators.closure import closure, links
from stemma.operators.scoring import ablate
from stemma.storage import stored


def evidence_for(cards: DataFrame, scores: DataFrame, root, hops: int = 7) -> DataFrame:
    """path, depth, node_id, strength: every support path into root, repeated nodes once per path, hops 1 to 7."""
    support = stored(links(cards).filter("sign = 1").select("target", "premise"), "support")
    level = support.filter(F.col("target") == root).select(F.concat(F.col("target").cast("string"), F.lit("/"), F.col("premise").cast("string")).alias("path"), F.lit(1).alias("depth"), F.col("premise").alias("node_id"))
    levels = [stored(level, "tree")]
    for depth in range(2, hops + 1):
        nxt = levels[-1].join(support, F.col("node_id") == F.col("target")).select(F.concat("path", F.lit("/"), F.col("premise").cast("string")).alias("path"), F.lit(depth).alias("depth"), F.col("premise").alias("node_id"))
        nxt = stored(nxt, "tree")
        if nxt.isEmpty():
            break
        levels.append(nxt)
    return reduce(DataFrame.unionByName, levels).join(scores.select("node_id", "strength"), "node_id", "left")


def polarized(cards: DataFrame, root, hops: int = 6) -> DataFrame:
    """(node_id, sign): nodes that support or negate root within so many hops; attack flips; the root is left out.

    Breadth first, so it holds all that a depth-first walk with the same bound finds, and what that misses by order."""
    edges = stored(links(cards).select("target", "premise", "sign"), "edges")
    front = seen = edges.limit(1).select(F.lit(root).cast(dict(edges.dtypes)["target"]).alias("node_id"), F.lit(1).alias("sign"))
    for _ in range(hops):
        step = front.withColumnRenamed("sign", "_s").join(edges, F.col("node_id") == F.col("target")).select(F.col("premise").alias("node_id"), (F.col("_s") * F.col("sign")).alias("sign")).distinct()
        nxt = stored(step.join(seen, ["node_id", "sign"], "left_anti"), "front")
        if nxt.isEmpty():
            break
        seen, front = seen.unionByName(nxt), nxt
    return seen.filter(F.col("node_id") != root)


def of_kind(cards: DataFrame, nodes: DataFrame, root, matches: Column | None = None, sign: int | None = None) -> DataFrame:
    """The signed walk from root, restricted: claims-for, background-for, evidence-only-for and so on by `matches`; supporting-for and negating-for by `sign`."""
    found = polarized(cards, root).join(nodes, "node_id")
    found = found if matches is None else found.filter(matches)
    return found if sign is None else found.filter(F.col("sign") == sign)


def is_quantitative() -> Column:
    return (F.col("type") == "estimate") | (F.coalesce("number", F.lit("")) != "")


def contested(scores: DataFrame) -> DataFrame:
    """Nodes with cards on both sides, the most lopsided first."""
    both = scores.filter((F.size("in_supporters") > 0) & (F.size("in_attackers") > 0))
    winner = F.when(F.col("vs") > F.col("va"), "support").when(F.col("vs") < F.col("va"), "attack").otherwise("tie")
    return both.withColumn("winner", winner).orderBy(F.desc(F.abs(F.col("vs") - F.col("va"))), "node_id")


def rank_hypotheses(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    rows = nodes.filter("type = 'hypothesis'").join(scores, "node_id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return rows.select("node_id", F.coalesce("strength", F.lit(0.0)).alias("strength"), n("in_supporters").alias("n_supporters"), n("in_attackers").alias("n_attackers"), "document")


def weakest_links(nodes: DataFrame, cards: DataFrame, root, scoped: bool = False) -> DataFrame:
    """Cards by how much root's strength moves without them; scoped: only those root depends on."""
    only = stored(closure(cards, root), "closure") if scoped else None
    found = ablate(nodes, cards, root, only)
    return found.join(cards.select(F.col("card_id").alias("removed"), "kind", "target", "premises"), "removed")


def backbone(nodes: DataFrame, cards: DataFrame, scores: DataFrame) -> DataFrame:
    """Quantitative nodes with their outgoing cards, inactive ones too."""
    out = cards.select(F.explode("premises").alias("node_id"), "card_id", "kind", "target")
    return nodes.filter(is_quantitative()).join(scores.select("node_id", "strength"), "node_id", "left").join(out, "node_id", "left")


def resolve_document(provenance: Column, meta: Column, default: Column) -> Column:
    """First provenance entry with a document; else the default if any has a chunk; else the source in meta."""
    named = F.filter(provenance, lambda p: p["document"].isNotNull() & (p["document"] != ""))
    return F.coalesce(F.try_element_at(named, F.lit(1))["document"], F.when(F.exists(provenance, lambda p: F.coalesce(p["chunk_id"], F.lit("")) != ""), default), F.try_element_at(meta, F.lit("source")), F.try_element_at(meta, F.lit("fixture")), F.lit("unknown"))


def resolve_question(query: DataFrame, nodes: DataFrame, scores: DataFrame, shortlist: int = 12) -> DataFrame:
    """Nodes nearest to a one-row query vector, re-ranked by cosine and, at 0.4, their share of the most supports. nodes: node_id, vector."""
    from stemma.operators.funnel import nearest

    near = nearest(nodes, query, None, shortlist)
    pool = near.join(scores.select(F.col("node_id").alias("src"), F.size("in_supporters").alias("n")), "src", "left").fillna(0, ["n"])
    top = pool.agg(F.greatest(F.max("n"), F.lit(1)).alias("top"))
    return pool.join(top, F.lit(True)).select(F.col("src").alias("node_id"), "cosine", F.col("n").cast("bigint").alias("n_supports"), F.round(F.col("cosine") + 0.4 * F.col("n") / F.col("top"), 6).alias("score"))


def cross_document(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards whose first premise and target stand in different documents, counted by direction."""
    doc = nodes.select("node_id", "document")
    a = cards.withColumn("_p", F.element_at("premises", 1)).join(doc.select(F.col("node_id").alias("_p"), F.col("document").alias("from_document")), "_p")
    both = a.join(doc.select(F.col("node_id").alias("target"), F.col("document").alias("to_document")), "target")
    return both.filter("from_document <> to_document").groupBy("from_document", "to_document", "kind").agg(F.count("*").alias("n_cards"))
