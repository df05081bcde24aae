"""Two-tier entity resolution: overlapping quotes, then near vectors; cliques, not mere components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.spans import ratio
from stemma.functions.text import numbers, numeric_conflict
from stemma.operators.components import components
from stemma.storage import stored


def tier1_pairs(nodes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(a, b): same document and chunk, overlapping spans, near texts, no numeric conflict. nodes: node_id, doc_id, chunk_id, span, node_text, quote."""
    rows = nodes.filter("chunk_id is not null and span is not null").select("node_id", "doc_id", "chunk_id", F.col("span")[0].alias("s"), F.col("span")[1].alias("e"), "node_text", numbers(F.concat_ws(" ", "node_text", "quote")).alias("nums"))
    a, b = (rows.select("doc_id", "chunk_id", *(F.col(c).alias(f"{c}_{x}") for c in ("node_id", "s", "e", "node_text", "nums"))) for x in "ab")
    met = a.join(b, ["doc_id", "chunk_id"]).filter("node_id_a < node_id_b and s_a < e_b and s_b < e_a").filter(~numeric_conflict(F.col("nums_a"), F.col("nums_b")))
    la, lb = F.length("node_text_a"), F.length("node_text_b")

    @F.pandas_udf("double")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y)], dtype=float)

    met = met.filter(2 * F.least(la, lb) >= threshold * (la + lb) * 0.5)
    return met.withColumn("_r", near("node_text_a", "node_text_b")).filter(F.col("_r") >= threshold).select(F.col("node_id_a").alias("a"), F.col("node_id_b").alias("b"))


def tier2_pairs(nodes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(a, b, cosine) of near vectors without numeric conflict. nodes: node_id, vector, nums."""
    from stemma.operators.funnel import nearest

    near = nearest(nodes, nodes, None, None, unordered=True, least=threshold)
    n = nodes.select("node_id", "nums")
    met = near.join(n.select(F.col("node_id").alias("src"), F.col("nums").alias("_a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("nums").alias("_b")), "dst")
    return met.filter(~numeric_conflict(F.col("_a"), F.col("_b"))).select(F.col("src").alias("a"), F.col("dst").alias("b"), "cosine")


#: Edges of a component that one task takes whole; of larger ones each node's later neighbours are searched apart.
WHOLE = 2_000_000


def _first_clique(near: list[int], free: int, need: int) -> int:
    """The least bits first, a largest all-linked set of `free` of at least `need`; 0 if none. near: each bit's links as bits.

    Branch and bound: no more can be linked than colours that a greedy colouring takes."""
    best, todo = 0, [(0, free)]
    while todo:
        held, free = todo.pop()
        colours, left = 0, free
        while left:
            colours, one = colours + 1, left
            while one:
                x = one & -one
                left ^= x
                one &= ~(near[x.bit_length() - 1] | x)
        n = held.bit_count()
        if n + colours < need:
            continue
        if colours == free.bit_count():  # all linked
            best, need = held | free, n + colours + 1
            continue
        x = free & -free
        todo += [(held, free ^ x), (held | x, free & near[x.bit_length() - 1])]  # with x first
    return best


def _later(x: int, after: np.ndarray, links, need: int) -> list[int]:
    """The largest all-linked set of x and some of `after` (sorted), if of `need` at least. links(y): sorted."""
    if len(after) + 1 < need:
        return []
    near = []
    for y in after:
        bits = np.zeros(len(after), bool)
        other = links(y)
        at = np.searchsorted(after, other)
        ok = at < len(after)
        bits[at[ok][after[at[ok]] == other[ok]]] = True
        near.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
    found = _first_clique(near, (1 << len(after)) - 1, max(need - 1, 1))
    return [x, *(int(y) for k, y in enumerate(after) if found >> k & 1)] if found else []


def largest_clique(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of linked pairs the largest all-linked set, the least ids first among equals."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    best: list[int] = []
    need = 2
    while True:
        both = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))
        a, b = np.divmod(both, len(ids))
        start = np.searchsorted(a, np.arange(len(ids) + 1))
        links = lambda x: b[start[x] : start[x + 1]]  # noqa: B023, E731
        degree = np.diff(start)
        if need == 2:  # a lower bound: some set grown from the nodes with most links
            for x in np.argsort(-degree, kind="stable")[:8]:
                n, free = 1, links(x)
                while len(free):
                    n, free = n + 1, np.intersect1d(free, links(free[np.argmax(degree[free])]), assume_unique=True)
                need = max(need, n)
        keep = (degree[a] >= need - 1) & (degree[b] >= need - 1)
        if keep.all():
            break
        a, b = a[keep], b[keep]
    for x in np.unique(a):
        after = links(x)
        if got := _later(int(x), after[after > x], links, need):
            best, need = got, len(got) + 1
    return ids[best].tolist()


def _pruned(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large components' edges (component, a, b; a < b) what a largest set can hold, and (component, need), a size that it has at least."""
    both = edges.unionByName(edges.select("component", F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.groupBy("component", "a").agg(F.count("*").alias("n"))
    top = degrees.groupBy("component").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    round_ = stored(both.join(top, ["component", "a"]).select("b"), "around")
    among = edges.join(round_.select(F.col("b").alias("a")), "a", "left_semi").join(round_, "b", "left_semi")

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": pdf["component"][:1], "need": [1 + len(largest_clique(pdf["a"].to_numpy(), pdf["b"].to_numpy()))]})

    types = dict(edges.dtypes)
    sizes = among.groupBy("component").applyInPandas(size, f"component {types['component']}, need int")
    need = stored(edges.select("component").distinct().join(sizes, "component", "left").fillna(2, ["need"]), "need")
    n = edges.count()
    while n:  # fewer links than the others of such a set: not in one
        both = edges.unionByName(edges.select("component", F.col("b").alias("a"), F.col("a").alias("b")))
        linked = both.groupBy("component", "a").agg(F.count("*").alias("n")).join(F.broadcast(need), "component").filter("n >= need - 1").select("a")
        edges = stored(edges.join(linked, "a", "left_semi").join(linked.withColumnRenamed("a", "b"), "b", "left_semi").select("component", "a", "b"), "edges")
        n, before = edges.count(), n
        if n > 0.9 * before:
            break
    return edges, need


def clique_groups(pairs: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(group_id, node_id): of each component the largest all-linked set, the least ids first among equals; others stay solo.

    A task holds at most WHOLE edges of a component, or one node's later neighbours with their links."""
    parts = components(pairs)
    one = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = stored(one.join(parts, F.col("a") == F.col("node")).select("component", "a", "b"), "linked")
    found = f"component {id_type}, members array<{id_type}>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": pdf["component"][:1], "members": [largest_clique(pdf["a"].to_numpy(), pdf["b"].to_numpy())]})

    large = rows.groupBy("component").count().filter(F.col("count") > WHOLE).select("component")
    got = rows.join(F.broadcast(large), "component", "left_anti").groupBy("component").applyInPandas(run, found)
    if not large.isEmpty():
        edges, need = _pruned(rows.join(F.broadcast(large), "component", "left_semi"))
        x, y, z = edges, edges.select("component", F.col("a"), F.col("b").alias("c")), edges.select("component", F.col("a").alias("b"), F.col("b").alias("c"))
        corners = x.join(y, ["component", "a"]).filter("b < c").join(z, ["component", "b", "c"]).select("component", "a", "b", "c")
        plain = edges.withColumn("c", F.lit(None).cast(id_type))  # sets of two have no corners
        around = corners.unionByName(plain.select("component", "a", "b", "c")).join(F.broadcast(need), "component")

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            links: dict = {}
            whole = pdf.dropna(subset=["c"])
            for b, c in ((whole["b"], whole["c"]), (whole["c"], whole["b"])):
                for k, v in c.astype("int64").groupby(b.astype("int64")):
                    links.setdefault(k, []).append(v.to_numpy())
            links = {k: np.unique(np.concatenate(v)) for k, v in links.items()}
            got = _later(int(pdf["a"].iloc[0]), np.unique(pdf["b"].to_numpy()), lambda y: links.get(int(y), np.empty(0, "int64")), int(pdf["need"].iloc[0]))
            return pd.DataFrame({"component": pdf["component"][:1], "members": [got]}).iloc[: 1 if got else 0]

        most = around.groupBy("component", "a").applyInPandas(search, found)
        got = got.unionByName(most.groupBy("component").agg(F.min(F.struct(-F.size("members"), "members"))["members"].alias("members")))
    return got.select(F.array_min("members").alias("group_id"), F.explode("members").alias("node_id"))


def representatives(nodes: DataFrame, groups: DataFrame, order: list[str]) -> DataFrame:
    """One row per group and per solo node: the longest text, then the earliest; with group size, members and what it spans."""
    rows = nodes.join(groups, "node_id", "left").withColumn("group_id", F.coalesce("group_id", "node_id"))
    w = Window.partitionBy("group_id").orderBy(F.desc(F.length("node_text")), *order)
    agg = rows.groupBy("group_id").agg(F.count("*").alias("group_size"), F.array_sort(F.collect_set("node_type")).alias("node_types"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.array_sort(F.collect_list("node_id")).alias("members"))
    first = rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return first.join(agg, "group_id").withColumn("cross_document", F.size("doc_ids") > 1).withColumn("cross_type", F.size("node_types") > 1)


def sanity(pairs: set[tuple[int, int]], group: set[int]) -> bool:
    """Whether a group is a clique of the pairs."""
    return all((a, b) in pairs or (b, a) in pairs for a, b in combinations(sorted(group), 2))
