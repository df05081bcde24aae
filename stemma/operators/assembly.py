"""What stands between the stages: who is asked what, whose answers are kept, and what a store must hold before it is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fan_out(documents: DataFrame, sections: DataFrame, node_types: list[str]) -> DataFrame:
    """doc_id, section, node_type, seq: a request for each section in scope and node type, in order. documents: doc_id, doc_order; sections: doc_id, section, section_order."""
    kinds = F.posexplode(F.array(*map(F.lit, node_types))).alias("type_order", "node_type")
    rows = sections.join(documents, "doc_id").select("doc_id", "doc_order", "section", "section_order", kinds)
    w = Window.partitionBy("doc_id").orderBy("type_order", "section_order")
    return rows.select("doc_id", "section", "node_type", F.row_number().over(w).alias("seq"))


def combined(tables: list[DataFrame], order: DataFrame) -> DataFrame:
    """Nodes of several tables in one total order per document: section, type, place in its table. tables: doc_id, section, node_type, idx; order: doc_id, section, section_order. Nodes of unknown sections come last."""
    rows = reduce(DataFrame.unionByName, tables).join(order, ["doc_id", "section"], "left")
    w = Window.partitionBy("doc_id").orderBy(F.col("section_order").asc_nulls_last(), "section", "node_type", "idx")
    return rows.withColumn("position", F.row_number().over(w))


def top_level(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """Hypotheses with `kept`: those in keep (doc_id, node_id); all of a document for which keep has nothing, as a failed selection keeps all."""
    answered = keep.select(F.col("doc_id").alias("_d")).distinct()
    chosen = keep.select(F.col("node_id").alias("_n"), F.lit(True).alias("_in")).distinct()
    rows = nodes.filter("node_type = 'hypothesis'").join(answered, F.col("doc_id") == F.col("_d"), "left").join(chosen, F.col("node_id") == F.col("_n"), "left")
    return rows.withColumn("kept", F.col("_d").isNull() | F.coalesce("_in", F.lit(False))).drop("_d", "_n", "_in")


def without_document(nodes: DataFrame, provenance: str = "provenance") -> DataFrame:
    """Nodes with a provenance entry that names no document: a graph of several documents must have none."""
    return nodes.filter(F.exists(provenance, lambda p: F.coalesce(p["document"], F.lit("")) == ""))


def first_votes(votes: DataFrame) -> DataFrame:
    """claim_id, role: the first real vote, else UNPARSED. votes: claim_id, role, seq."""
    real = F.when(F.col("role") != "UNPARSED", F.col("seq"))
    return votes.groupBy("claim_id").agg(F.coalesce(F.min_by("role", real), F.lit("UNPARSED")).alias("role"))


def tagged(votes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, done: whether any answer could be read; those with none are asked again. votes: keys, role."""
    return votes.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("role") != "UNPARSED", F.lit(False))).alias("done"))


def node_roles(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """node_id, role by the claim of a node's first provenance entry. nodes: node_id, provenance; roles: claim_id, role."""
    first = nodes.select("node_id", F.try_element_at("provenance", F.lit(1))["claim_id"].alias("claim_id"))
    return first.join(roles, "claim_id").select("node_id", "role")


def leaks(cards: DataFrame, roles: DataFrame, role: str = "conclusory") -> DataFrame:
    """card_id, node_id: active cards that touch a node of that role; a guarded scoring refuses if there is any."""
    ends = cards.filter("active").select("card_id", F.explode(F.concat("premises", F.array("target"))).alias("node_id")).distinct()
    return ends.join(roles.filter(F.col("role") == role).select("node_id"), "node_id", "left_semi").select("card_id", "node_id")


def card_documents(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """card_id, documents: the sorted documents of its premises. nodes: node_id, document."""
    rows = cards.select("card_id", F.explode("premises").alias("node_id")).join(nodes.select("node_id", "document"), "node_id")
    return rows.groupBy("card_id").agg(F.array_sort(F.collect_set("document")).alias("documents"))


def typed_summary(claims: DataFrame, type_: str = "type", number: str = "number") -> DataFrame:
    """type, n, with_number (percent, one place)."""
    some = F.avg(F.when(F.coalesce(F.col(number), F.lit("")) != "", 1.0).otherwise(0.0))
    return claims.groupBy(F.col(type_).alias("type")).agg(F.count("*").alias("n"), F.round(100 * some, 1).alias("with_number"))


def coverage(covered: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_chars, covered, ratio (4 places; null for empty texts) of merged spans. covered: key, start, end."""
    sums = covered.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    rows = texts.select(key, F.length(text).alias("n_chars")).join(sums, key, "left").fillna(0, ["covered"])
    return rows.withColumn("ratio", F.round(F.try_divide(F.col("covered").cast("double"), F.col("n_chars")), 4))


def seed_weights(scores: DataFrame, mentions: DataFrame, dense: DataFrame, share: float = 0.05) -> DataFrame:
    """node, weight: each fact's entities by its score over the entity's passages, summed; passages by dense score times share. scores: entity, score; mentions: passage, entity; dense: passage, score."""
    often = mentions.select("passage", "entity").distinct().groupBy("entity").agg(F.count("*").alias("_n"))
    entities = scores.groupBy("entity").agg(F.sum("score").alias("_s")).join(often, "entity", "left").select(F.col("entity").alias("node"), (F.col("_s") / F.coalesce("_n", F.lit(1))).alias("weight"))
    return entities.unionByName(dense.select(F.col("passage").alias("node"), (F.col("score") * share).alias("weight")))


def hashed_id(kind: str, content: Column) -> Column:
    """entity-, chunk- and fact- ids."""
    return F.concat(F.lit(f"{kind}-"), F.md5(content))


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that only one of two results has: none if a replay gives the same."""
    return one.exceptAll(two).unionByName(two.exceptAll(one))
