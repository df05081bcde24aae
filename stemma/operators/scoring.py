"""Gradual strengths over weighted support and attack cards (DF-QuAD), and ablation.

A card's force is its weight times the least strength of its premises; sides combine by the
complement product; a node's strength moves its base towards 1 or 0 by the difference. Nodes
are scored level by level, each level one join and aggregation; what no level reaches lies on
or behind cycles and is iterated per connected part.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.closure import closure
from stemma.operators.components import components
from stemma.storage import stored

BASE = 0.5


def combine(base, va, vs):
    """Columns or numbers."""
    if isinstance(va, (int, float)):
        return base - base * (va - vs) if va >= vs else base + (1 - base) * (vs - va)
    return F.when(va >= vs, base - base * (va - vs)).otherwise(base + (1 - base) * (vs - va))


def score_graph(nodes: DataFrame, cards: DataFrame, keys: tuple[str, ...] = (), base: float = BASE, damping: float = 0.5, max_iter: int = 100, unknown_kind: str = "ignore") -> DataFrame:
    """keys, node_id, strength, base, va, vs, in_supporters, in_attackers.

    nodes: node_id (and base, where given). cards: card_id, kind, weight, premises, target, active.
    keys: columns of both that separate graphs scored together. Inactive cards, and cards whose
    target or any premise is no node, count for nothing; unknown_kind: `ignore` or `attack`."""
    k = [*keys, "node_id"]
    own = F.coalesce(F.col("base"), F.lit(base)) if "base" in nodes.columns else F.lit(base)
    nodes = nodes.select(*k, own.cast("double").alias("base"))
    side = F.when(F.col("kind") == "RA", "s").when(F.col("kind").isin("CA", "PA"), "a").otherwise("a" if unknown_kind == "attack" else None)
    live = cards.filter("active").withColumn("side", side).filter("side is not null and size(premises) > 0").select(*keys, "card_id", "weight", "side", "target", "premises")
    ends = [*keys, "target"]
    live = live.join(nodes.select(*keys, F.col("node_id").alias("target"), "base"), ends).withColumn("n", F.size("premises"))
    card = [*ends, "base", "card_id", "weight", "side", "n"]
    known = live.select(*card, F.explode("premises").alias("node_id")).join(nodes.select(*k), k, "left_semi")
    whole = stored(known.groupBy(*card).agg(F.collect_list("node_id").alias("premises")).filter("size(premises) = n"), "live")
    links = stored(whole.join(whole.groupBy(*ends).agg(F.count("*").alias("need")), ends).select(*card, "need", F.explode("premises").alias("node_id")), "links")
    forces = F.collect_list(F.struct("side", "force", "card_id"))

    def sides(scored: DataFrame) -> DataFrame:
        """Nodes all of whose cards' premises are scored, with both sides."""
        per_card = links.join(scored.select(*k, "strength"), k).groupBy(*card, "need").agg(F.count("*").alias("_n"), F.min("strength").alias("m")).filter("_n = n")
        got = per_card.withColumn("force", F.col("weight") * F.col("m")).groupBy(*ends, "base", "need").agg(forces.alias("f"), F.count("*").alias("_have")).filter("_have = need")
        return got.select(*keys, F.col("target").alias("node_id"), "base", F.expr("array_sort(f)").alias("f"))

    def shaped(df: DataFrame) -> DataFrame:
        f = lambda s: F.expr(f"1D - aggregate(filter(f, x -> x.side = '{s}'), 1D, (p, x) -> p * (1D - x.force))")
        df = df.withColumn("va", f("a")).withColumn("vs", f("s"))
        names = {n: F.expr(f"array_sort(transform(filter(f, x -> x.side = '{s}'), x -> x.card_id))") for n, s in (("in_supporters", "s"), ("in_attackers", "a"))}
        return df.withColumns(names).withColumn("strength", combine(F.col("base"), F.col("va"), F.col("vs"))).select(*k, "strength", "base", "va", "vs", "in_supporters", "in_attackers")

    targets = links.select(*keys, F.col("target").alias("node_id")).distinct()
    empty = F.expr("filter(array(struct('' as side, 0D as force, card as card_id)), x -> false)")
    card_type = dict(links.dtypes)["card_id"]
    scored = stored(shaped(nodes.join(targets, k, "left_anti").withColumn("card", F.lit(None).cast(card_type)).withColumn("f", empty)), "level")
    left = targets.count()
    while left:
        level = stored(shaped(sides(scored).join(scored.select(*k), k, "left_anti")), "level")
        n = level.count()
        if not n:
            break
        scored, left = scored.unionByName(level), left - n
    if not left:
        return scored
    rest = targets.join(scored.select(*k), k, "left_anti")
    return scored.unionByName(_cyclic(rest.join(nodes, k), links, scored, keys, damping, max_iter))


def _cyclic(rest: DataFrame, links: DataFrame, scored: DataFrame, keys: tuple[str, ...], damping: float, max_iter: int) -> DataFrame:
    """In-place damped sweeps, per connected part of what is left."""
    k = [*keys, "node_id"]
    tag = lambda c: F.concat_ws("\u0001", *keys, F.col(c).cast("string"))
    among = links.join(rest.select(*k), k, "left_semi").select(tag("node_id").alias("a"), tag("target").alias("b"))
    parts = components(among).withColumnRenamed("node", "_tag")
    full = links.drop("base").join(rest.select(*keys, F.col("node_id").alias("target")), [*keys, "target"], "left_semi").join(scored.select(*k, F.col("strength").alias("fixed")), k, "left")
    rows = full.withColumn("_tag", tag("target")).join(parts, "_tag", "left").withColumn("component", F.coalesce("component", "_tag")).join(rest.select(*keys, F.col("node_id").alias("target"), "base"), [*keys, "target"])
    types = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(pdf["target"].unique())
        base = dict(zip(pdf["target"], pdf["base"]))
        cards: dict = {t: {} for t in order}
        for r in pdf.itertuples(index=False):
            cards[r.target].setdefault(r.card_id, (r.side, r.weight, []))[2].append((r.node_id, r.fixed))
        now, sums = dict(base), {}
        for _ in range(max_iter):
            moved = 0.0
            for t in order:
                out = {"a": 1.0, "s": 1.0}
                for side, weight, premises in cards[t].values():
                    out[side] *= 1 - weight * min(now[p] if p in now else f for p, f in premises)
                va, vs = 1 - out["a"], 1 - out["s"]
                new = damping * now[t] + (1 - damping) * combine(base[t], float(va), float(vs))
                moved, now[t], sums[t] = max(moved, abs(new - now[t])), new, (va, vs)
            if moved < 1e-9:
                break
        ids = lambda t, s: sorted(c for c, x in cards[t].items() if x[0] == s)
        same = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame([{**same, "node_id": t, "strength": now[t], "base": base[t], "va": sums[t][0], "vs": sums[t][1], "in_supporters": ids(t, "s"), "in_attackers": ids(t, "a")} for t in order])

    cards_type = types["card_id"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), f"node_id {types['node_id']}", "strength double, base double, va double, vs double", f"in_supporters array<{cards_type}>, in_attackers array<{cards_type}>"])
    return rows.groupBy(*keys, "component").applyInPandas(lambda pdf: run(pdf), schema)


def ablate(nodes: DataFrame, cards: DataFrame, target, only: DataFrame | None = None, base: float = BASE) -> DataFrame:
    """removed, delta (absolute change of the target's strength) for each active card, or each in `only`.

    All scenarios, and the one that removes nothing, are one job over what the target depends on;
    a card outside that moves nothing and has delta 0 without being scored."""
    spark, active = cards.sparkSession, cards.filter("active")
    asked = active if only is None else active.join(only, "card_id", "left_semi")
    near = stored(active.join(closure(cards, target), "card_id", "left_semi"), "near")
    gone = near.join(asked.select("card_id"), "card_id", "left_semi").select(F.col("card_id").alias("removed"), F.concat(F.lit("-"), F.col("card_id").cast("string")).alias("scenario"))
    none = spark.range(1).select(F.lit(None).cast(dict(cards.dtypes)["card_id"]).alias("removed"), F.lit("").alias("scenario"))
    every = stored(gone.unionByName(none), "scenarios")
    scenarios = near.join(every, F.col("removed").isNull() | (F.col("card_id") != F.col("removed"))).drop("removed")
    used = near.select(F.explode(F.concat("premises", F.array("target"))).alias("node_id")).distinct()
    graphs = nodes.join(used, "node_id", "left_semi").join(every.select("scenario"), F.lit(True))
    after = stored(score_graph(graphs, scenarios, ("scenario",), base).filter(F.col("node_id") == target).select("scenario", "strength"), "after")
    before = after.filter("scenario = ''").select(F.col("strength").alias("_before"))
    moved = after.join(every.filter("removed is not null"), "scenario").join(before, F.lit(True)).select("removed", F.abs(F.col("strength") - F.col("_before")).alias("delta"))
    return asked.select(F.col("card_id").alias("removed")).join(moved, "removed", "left").fillna(0.0, ["delta"])
