"""Active cards as links, and what a node depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.storage import stored


def links(cards: DataFrame) -> DataFrame:
    """Active cards by premise: premise -> target with sign +1 (support) or -1."""
    return cards.filter("active").select("card_id", "weight", "target", F.explode("premises").alias("premise"), F.when(F.col("kind") == "RA", 1).otherwise(-1).alias("sign"))


def closure(cards: DataFrame, root) -> DataFrame:
    """card_id of every card reachable backwards from root; cycles end."""
    edges = stored(links(cards).select("card_id", "target", "premise"), "edges")
    seen = stored(edges.filter(F.col("target") == root).select(F.col("target").alias("node_id")).distinct(), "seen")
    front = seen
    while True:
        nxt = stored(edges.join(front, F.col("target") == F.col("node_id"), "left_semi").select(F.col("premise").alias("node_id")).distinct().join(seen, "node_id", "left_anti"), "front")
        if nxt.isEmpty():
            return edges.join(seen, F.col("target") == F.col("node_id"), "left_semi").select("card_id").distinct()
        seen, front = seen.unionByName(nxt), nxt
