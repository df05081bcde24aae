"""What surrounds the model calls: batches, defaults, mention registry and antecedents, conversion, review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import is_judgment
from stemma.schema import TYPE_MAP, layer_of, lookup


def batches(df: DataFrame, order: list[str], size: int, within: list[str] = []) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order) if within else Window.orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def with_defaults(rows: DataFrame, parsed: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """Parsed answers by position; what is missing gets the default."""
    return rows.join(parsed, keys, "left").fillna(defaults)


def salvage(reply: Column, schema: str) -> Column:
    """A reply's JSON array, fences dropped; a truncated one up to its last object."""
    body = F.regexp_replace(reply, r"(?s)^.*?```(?:json)?|```.*$", "")
    inner = F.regexp_extract(body, r"(?s)(\[.*)", 1)
    whole = F.from_json(inner, f"array<{schema}>")
    cut = F.from_json(F.concat(F.regexp_extract(inner, r"(?s)(.*\})", 1), F.lit("]")), f"array<{schema}>")
    return F.coalesce(F.when(inner.rlike(r"(?s)\]\s*$"), whole), cut, F.array().cast(f"array<{schema}>"))


def mention_registry(mentions: DataFrame) -> DataFrame:
    """doc, entity_key, first_seen, last_seen, n, entity_no by first sighting. mentions: doc, sentence, mention, text."""
    key = F.regexp_replace(F.trim(F.lower("text")), r"\s+", " ")
    got = mentions.withColumn("entity_key", key).filter("entity_key <> ''").groupBy("doc", "entity_key").agg(F.min(F.struct("sentence", "mention")).alias("f"), F.max("sentence").alias("last_seen"), F.count("*").alias("n"))
    return got.select("doc", "entity_key", F.col("f.sentence").alias("first_seen"), "last_seen", "n", F.row_number().over(Window.partitionBy("doc").orderBy("f.sentence", "f.mention")).alias("entity_no"))


def antecedents(pronouns: DataFrame, named: DataFrame, top: int = 5) -> DataFrame:
    """For each pronoun the best earlier entities, by (2 if in its section else 1) / (1 + sentences between). Both: doc, section, sentence, mention; named: entity_key.

    All names of the pronoun's sentence count as seen first, so that an entity named again later in it is no candidate."""
    n = named.select("doc", F.col("section").alias("_sec"), F.col("sentence").alias("_s"), F.col("mention").alias("_m"), "entity_key")
    met = pronouns.join(n, "doc").filter("_s <= sentence")
    last = met.groupBy("doc", "section", "sentence", "mention", "entity_key").agg(F.max(F.struct("_s", "_m", "_sec")).alias("l"))
    ok = last.filter("l._s < sentence or l._m < mention")
    score = F.when(F.col("l._sec") == F.col("section"), 2.0).otherwise(1.0) / (1 + F.col("sentence") - F.col("l._s"))
    w = Window.partitionBy("doc", "sentence", "mention").orderBy(F.desc("score"), "entity_key")
    return ok.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("doc", "sentence", "mention", "entity_key", "score", "rank")


def escalation(ranked: DataFrame, picks: DataFrame, keys: list[str], tiers: tuple[int, ...] = (5, 20)) -> DataFrame:
    """keys, entity_key, shown, calls: how many candidates had been shown when the pick was among them; beyond the last tier the whole pool is. No call repeats a pool already shown whole. ranked: keys, entity_key, rank; picks: keys, entity_key."""
    pool = ranked.groupBy(*keys).agg(F.count("*").alias("_pool"))
    met = ranked.join(picks.select(*keys, "entity_key"), [*keys, "entity_key"]).join(pool, keys)
    calls = F.lit(len(tiers) + 1)
    for k, t in reversed(list(enumerate(tiers, 1))):
        calls = F.when(F.col("rank") <= t, k).otherwise(calls)
    shown = F.least(F.try_element_at(F.array(*map(F.lit, tiers)), calls), F.col("_pool")) if tiers else F.col("_pool")
    return met.select(*keys, "entity_key", F.coalesce(shown, F.col("_pool")).cast("bigint").alias("shown"), calls.alias("calls"))


def substitutions(picks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, payload: a sentence's mentions with what stands for them, in order. picks: keys, mention, surface, entity_key; rows without an entity are left out."""
    kept = picks.filter("entity_key is not null")
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("mention", "surface", "entity_key"))).alias("payload"))


def internal_refs(texts: DataFrame, sections: DataFrame, pattern: str) -> DataFrame:
    """texts with `number`: the section that the text names, only where its document has one of that number. texts: doc, text; sections: doc, number."""
    named = texts.withColumn("number", F.regexp_extract("text", pattern, 1)).filter("number <> ''")
    return named.join(sections.select("doc", "number").distinct(), ["doc", "number"], "left_semi")


def nearby_sections(sections: DataFrame) -> DataFrame:
    """doc, ord, near: itself, its parent and the three before it. sections: doc, ord, number."""
    s = sections.select("doc", F.col("ord").alias("near"), F.col("number").alias("_n"))
    parent = F.regexp_extract("number", r"^(.*)\.[^.]*$", 1)
    return sections.join(s, "doc").filter(F.col("near").between(F.col("ord") - 3, F.col("ord")) | (F.col("_n") == parent)).select("doc", "ord", "near").distinct()


def retype_bridges(nodes: DataFrame) -> DataFrame:
    """Judgments of the data layer become claims; retyped_from keeps the old type."""
    move = (layer_of(F.col("type")) == "data") & is_judgment(F.coalesce("canonical_text", F.lit("")))
    return nodes.withColumn("retyped_from", F.when(move, F.col("type"))).withColumn("type", F.when(move, "claim").otherwise(F.col("type")))


def convert_type(node_type: Column, kept: Column) -> Column:
    """The graph's type of an extracted node; a hypothesis not kept as top-level is a claim."""
    return F.when((node_type == "hypothesis") & ~kept, "claim").otherwise(lookup(TYPE_MAP, node_type, "claim"))


def review_priority(role: Column, primary: Column, second: Column, third: Column, section: Column, text: Column, confidence: Column) -> Column:
    """How much a claim wants a human look."""
    # Marks of a numeric statement.
    numeric = text.rlike(r"(?i)bayes|prior|probability|odds|1/|factor|estimate|%")
    add = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    unparsed = F.array_contains(F.array(*(F.coalesce(v, F.lit("")) for v in (primary, second, third))), "UNPARSED")
    return (add(unparsed, 100.0) + add(primary != second, 60.0) + add(second != third, 25.0) + add((role == "conclusory") & ~F.startswith(F.coalesce(section, F.lit("")), F.lit("7")), 20.0)
            + add(role == "conclusory", 8.0) + add(numeric, 6.0) + (1 - F.coalesce(confidence, F.lit(1.0))) * 10)
