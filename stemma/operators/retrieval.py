"""The topical baseline: a knowledge graph of entities and passages, ranked by personalised PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.storage import discard, stored


def edges(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """source, target, weight, both ways: subject-object co-mentions counted, passage-entity links at 1. facts: subject, object; mentions: passage, entity."""
    pairs = facts.filter("subject <> object").groupBy(F.col("subject").alias("source"), F.col("object").alias("target")).agg(F.count("*").cast("double").alias("weight"))
    links = mentions.select(F.col("passage").alias("source"), F.col("entity").alias("target")).distinct().withColumn("weight", F.lit(1.0))
    one = pairs.unionByName(links)
    both = one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def fact_scores(similarities: DataFrame) -> DataFrame:
    """Min-max normalised; all equal: 1."""
    ends = similarities.agg(F.min("score").alias("_l"), F.max("score").alias("_h"))
    return similarities.join(ends, F.lit(True)).withColumn("score", F.when(F.col("_h") > F.col("_l"), (F.col("score") - F.col("_l")) / (F.col("_h") - F.col("_l"))).otherwise(F.lit(1.0))).drop("_l", "_h")


def pagerank(graph: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.5) -> DataFrame:
    """node, rank: `rounds` steps from the seeds' distribution, back to it at 1 - damping. graph: source, target, weight; seeds: node, weight."""
    total = graph.groupBy("source").agg(F.sum("weight").alias("_t"))
    steps = stored(graph.join(total, "source").select("source", "target", (F.col("weight") / F.col("_t")).alias("p")), "steps")
    whole = seeds.agg(F.sum("weight").alias("_w"))
    reset = stored(seeds.groupBy("node").agg(F.sum("weight").alias("w")).join(whole, F.lit(True)).select("node", (F.col("w") / F.col("_w")).alias("r")), "reset")
    rank, old = reset.select("node", F.col("r").alias("rank")), None
    for k in range(rounds):
        moved = rank.join(steps, F.col("node") == F.col("source")).groupBy("target").agg((F.sum(F.col("rank") * F.col("p")) * damping).alias("m"))
        rank = moved.withColumnRenamed("target", "node").join(reset, "node", "full_outer").select("node", (F.coalesce("m", F.lit(0.0)) + F.coalesce(F.col("r") * (1 - damping), F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank = stored(rank, "rank")
            if old is not None:
                discard(old)
            old = rank
    return rank


def report(graph: DataFrame) -> DataFrame:
    """metric, value of the undirected graph."""
    one = graph.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    nodes = one.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    n = nodes.agg(F.count("*").alias("n")).join(one.agg(F.count("*").alias("m")), F.lit(True))
    row = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    density = F.round(F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1)), 4)
    return n.select(F.explode(F.array(row("nodes", F.col("n")), row("edges", F.col("m")), row("density", density))).alias("x")).select("x.*")
