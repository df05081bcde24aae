"""The budgeted pairing funnel: blocked cosine top-k, channels, dedup, labels to cards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.storage import lean, stored

#: Rows of a packed matrix, and of the pieces in which two of them are multiplied.
BLOCK, TILE = 4096, 1024
#: Blocks that a task of a meeting holds of one side at most.
PANEL = 16
SHARES = {"top_down": 0.50, "data_to_argument": 0.30, "argument_to_question": 0.15, "contradiction": 0.05}


def budgets(total: int, nli: bool = False) -> dict[str, int]:
    """Half-even rounded shares; without entailment scores the contradiction share goes top-down."""
    out = {c: round(total * s) for c, s in SHARES.items()}
    if not nli:
        out["top_down"] = round(total * (SHARES["top_down"] + SHARES["contradiction"]))
        out["contradiction"] = 0
    return out


def blocks(df: DataFrame) -> DataFrame:
    """Stored rows (no, ids, x): unit vectors packed into matrices of at most BLOCK rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                c = b.slice(a, BLOCK)
                x = c.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(c.num_rows, -1)
                norm = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                yield pa.RecordBatch.from_pydict({"ids": [c.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], "x": [x.tobytes()]})

    packed = df.select("node_id", "vector").filter("vector is not null").mapInArrow(lean(pack), "ids binary, x binary")
    return stored(packed.select(F.monotonically_increasing_id().alias("no"), "ids", "x"), "blocks")


class _Best:
    """What of the pairs met so far can be among the best: at most per_dst of a dst, `budget` in all, cosines from `least` on."""

    def __init__(self, per_dst: int | None, budget: int | None, least: float | None):
        self.per_dst, self.budget, self.least = per_dst, budget, -np.inf if least is None else least
        self.kept, self.more, self.n, self.past = [], [], 0, self.least

    def start(self, rows: int) -> None:
        """Another block of dst, where each of its rows has a bound of its own."""
        self.past = np.full(rows, self.least)

    def add(self, s: np.ndarray, d: np.ndarray, c: np.ndarray) -> None:
        self.more.append((s, d, c))
        self.n += len(s)

    def cut(self) -> None:
        s, d, c = (np.concatenate(x) for x in zip(*self.kept, *self.more))
        if self.per_dst is not None:
            order = np.lexsort((s, -c, d))
            s, d, c = s[order], d[order], c[order]
            keep = np.arange(len(d)) - np.searchsorted(d, d, "left") < self.per_dst
            s, d, c = s[keep], d[keep], c[keep]
        if self.budget is not None:
            order = np.lexsort((d, s, -c))[: self.budget]
            s, d, c = s[order], d[order], c[order]
            if len(c) == self.budget:
                self.past = max(self.least, c[-1]) if len(c) else np.inf
        else:
            rows, first, many = np.unique(d, return_index=True, return_counts=True)
            full = many == self.per_dst
            self.past[rows[full]] = c[(first + many - 1)[full]]
        self.kept, self.more, self.n = [(s, d, c)], [], 0

    def take(self) -> tuple:
        if self.more:
            self.cut()
        got = self.kept[0] if self.kept else (np.empty(0, "<i8"), np.empty(0, "<i8"), np.empty(0))
        self.kept = []
        return got


def _meeting(per_dst: int | None, budget: int | None, unordered: bool, least: float | None):
    """For mapInArrow: blocks of src meet blocks of dst, those of a dst block one after the other.

    Products in single precision, piece by piece, tell which pairs can be among the best; these
    alone get their cosine. What a task holds depends on neither table's size."""
    by_row = per_dst is not None and budget is None  # then a pair's dst is kept by its row until its block ends
    every = per_dst is None and budget is None

    def out(s: np.ndarray, d: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(c), 1 << 16):
            z = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(s[z]), pa.array(d[z]), pa.array(c[z])], ["src", "dst", "cosine"])

    def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = 1 << 14
        return np.round(np.concatenate([np.einsum("ij,ij->i", x[i[a : a + step]], y[j[a : a + step]]) for a in range(0, len(i), step)] or [np.empty(0)]), 6)

    def bound(near: np.ndarray, ok: np.ndarray, wide: float):
        """Below which, by this piece alone, nothing is among the best; None if it has too few pairs to tell."""
        k = budget if per_dst is None else per_dst
        if near.shape[1] <= k if per_dst is not None else near.size <= k or k == 0:
            return None
        v = np.where(ok, near, np.float32(-2))
        low = np.partition(v, v.shape[1] - k, axis=1)[:, -k] if per_dst is not None else np.partition(v, v.size - k, axis=None)[-k]
        return low - 2 * wide

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block, d_ids = _Best(per_dst, budget, least), None, None
        for b in batches:
            for r in range(b.num_rows):
                v = {n: b.column(k)[r] for k, n in enumerate(b.schema.names)}
                s_no, d_no = v["s_no"].as_py(), v["d_no"].as_py()
                s, x = np.frombuffer(v["s_ids"].as_buffer(), "<i8"), np.frombuffer(v["s_x"].as_buffer())
                d, y = np.frombuffer(v["d_ids"].as_buffer(), "<i8"), np.frombuffer(v["d_x"].as_buffer())
                x, y = x.reshape(len(s), -1), y.reshape(len(d), -1)
                if by_row and d_no != block:
                    if block is not None:
                        i, j, c = best.take()
                        yield from out(i, d_ids[j], c)
                    block, d_ids = d_no, d.copy()
                    best.start(len(d))
                x4, y4 = x.astype(np.float32), y.astype(np.float32)
                wide = 2e-6 + 1.3e-7 * (x.shape[1] + 8)  # single precision and rounding to 6 places
                for q in range(0, len(d), TILE):
                    for p in range(0, len(s), TILE):
                        if unordered and s_no == d_no and p + TILE <= q:
                            continue  # met the other way round
                        near = y4[q : q + TILE] @ x4[p : p + TILE].T
                        past = best.past[q : q + TILE] if by_row else best.past
                        low = past - wide
                        if not every and np.isneginf(low).any():
                            ok = s[None, p : p + TILE] != d[q : q + TILE, None]
                            if unordered and s_no == d_no:
                                ok &= np.arange(p, p + near.shape[1]) > np.arange(q, q + near.shape[0])[:, None]
                            own = bound(near, ok, wide)
                            low = low if own is None else np.maximum(low, own)
                        j, i = np.nonzero(near >= (np.asarray(low, np.float32)[:, None] if np.ndim(low) else np.float32(low)))
                        if not len(i):
                            continue
                        i, j = i + p, j + q
                        ok = s[i] != d[j]
                        if unordered and s_no == d_no:
                            ok &= i > j
                        i, j = i[ok], j[ok]
                        c = cosines(x, y, i, j)
                        ok = c >= (best.past[j] if by_row else best.past)
                        i, j, c = i[ok], j[ok], c[ok]
                        a, z = s[i], d[j]
                        if unordered:
                            a, z = np.minimum(a, z), np.maximum(a, z)
                        if every:
                            yield from out(a, z, c)
                        elif len(c):
                            best.add(a, j if by_row else z, c)
                            if not by_row or best.n > 1 << 16 or np.isneginf(low).any():
                                best.cut()
        if not every:
            i, j, c = best.take()
            yield from out(i, d_ids[j] if by_row and len(j) else j, c)

    return evaluate


def nearest(src: DataFrame, dst: DataFrame, per_dst: int | None, budget: int | None, unordered: bool = False, least: float | None = None) -> DataFrame:
    """(src, dst, cosine) of the `budget` best pairs by cosine to 6 places, then ids; per_dst: only each dst's nearest so many;
    least: only cosines from there on; no budget: all. unordered: src and dst are one table, of which each pair counts once, the lesser id first."""
    a = blocks(src)
    return meet(a, a if src is dst or unordered else blocks(dst), per_dst, budget, unordered, least)


def meet(src: DataFrame, dst: DataFrame, per_dst: int | None, budget: int | None, unordered: bool = False, least: float | None = None) -> DataFrame:
    """nearest() of blocks().

    Panels of both sides meet in as many tasks as the cluster's cores share evenly; a task passes on
    what can be among the best: a row for each of `budget`, or per_dst rows for each of its dst."""
    cores = src.sparkSession.sparkContext.defaultParallelism

    def panels(df: DataFrame, name: str) -> DataFrame:
        n = df.count()
        return df.select(*(F.col(c).alias(f"{name}_{c}") for c in ("no", "ids", "x"))).repartition(max(1, min(n, max(math.ceil(math.sqrt(3 * cores)), math.ceil(n / PANEL)))))

    met = panels(dst, "d").join(panels(src, "s"), F.col("s_no") >= F.col("d_no") if unordered else F.lit(True))  # packed blocks, not rows
    pairs = met.mapInArrow(lean(_meeting(per_dst, budget, unordered, least)), "src bigint, dst bigint, cosine double")
    if per_dst is not None:
        w = Window.partitionBy("dst").orderBy(F.desc("cosine"), "src")
        pairs = pairs.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_dst).drop("_k")
    return pairs if budget is None else pairs.orderBy(F.desc("cosine"), "src", "dst").limit(budget)


def funnel(nodes: DataFrame, total: int, k: int = 50, new_ids: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """src, dst, channel, cosine, confidence, rank. nodes: node_id, layer, vector.

    new_ids: each channel is run with one side new, and pairs of `prior` are kept and not repeated."""
    fresh = None if new_ids is None else new_ids.select("node_id").distinct()
    layer = {x: nodes.filter(F.col("layer") == x) for x in ("data", "argument", "question")}
    whole = {x: blocks(df) for x, df in layer.items()}
    part = {} if fresh is None else {x: blocks(df.join(fresh, "node_id", "left_semi")) for x, df in layer.items()}
    b = budgets(total)
    plan = [("top_down", "data", "question", k), ("data_to_argument", "data", "argument", None), ("argument_to_question", "argument", "question", None)]
    found = None
    for channel, s, d, per in plan:
        sides = [(part[s], whole[d]), (whole[s], part[d])] if part else [(whole[s], whole[d])]
        for a, z in sides:
            got = meet(a, z, per, b[channel]).withColumn("channel", F.lit(channel))
            found = got if found is None else found.unionByName(got)
    found = found.withColumn("confidence", F.col("cosine"))
    if prior is not None:
        found = found.join(prior.select("src", "dst"), ["src", "dst"], "left_anti")
    return ranked(found, total, prior)


def ranked(pairs: DataFrame, total: int, prior: DataFrame | None = None) -> DataFrame:
    """The first of each (src, dst) by confidence, the best `total`, ranked after what `prior` has."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc("confidence"), "channel")
    best = pairs.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k").orderBy(F.desc("confidence"), "src", "dst").limit(total)
    before = 0 if prior is None else prior.count()
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "src", "dst")) + before)
    return out if prior is None else prior.unionByName(out, allowMissingColumns=True)


def contradictions(nodes: DataFrame, contra: Column, cap: int, budget: int) -> DataFrame:
    """src, dst, channel, cosine, confidence: unordered pairs within data and within argument, the cap/2 nearest of each, the `budget` best by `contra` (a contradiction score over src and dst)."""
    found = None
    for layer in ("data", "argument"):
        side = nodes.filter(F.col("layer") == layer)
        got = nearest(side, side, None, cap // 2, unordered=True)
        found = got if found is None else found.unionByName(got)
    return found.withColumns({"channel": F.lit("contradiction"), "confidence": contra}).orderBy(F.desc("confidence"), "src", "dst").limit(budget)


def blended(cosine: Column, entail: Column, contra: Column) -> Column:
    """Confidence after entailment scoring."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - 0.7) / 0.3))
    return 0.7 * F.greatest(entail, contra) + 0.3 * near


def cards_of(pairs: DataFrame, labels: DataFrame, start: int = 0) -> DataFrame:
    """Labelled pairs as cards; `none` and missing labels give none. labels: src, dst, relation, strength."""
    kind = F.when(F.col("relation") == "support", "RA").when(F.col("relation") == "attack", "CA")
    weight = F.when(F.col("strength") == "high", 0.85).when(F.col("strength") == "medium", 0.6).otherwise(0.35)
    rows = pairs.join(labels, ["src", "dst"]).withColumn("kind", kind).filter("kind is not null")
    n = F.row_number().over(Window.orderBy("rank")) + start
    return rows.select(F.format_string("card-%05d", n).alias("card_id"), "kind", weight.alias("weight"), F.array("src").alias("premises"), F.col("dst").alias("target"), F.lit(True).alias("active"))


def merge_cards(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Existing cards first; added ones with a new (premises, target, kind), renumbered."""
    key = ["_p", "target", "kind"]
    both = existing.withColumn("_o", F.lit(0)).unionByName(added.withColumn("_o", F.lit(1))).withColumn("_p", F.array_join(F.array_sort(F.transform("premises", lambda x: x.cast("string"))), ","))
    w = Window.partitionBy(*key).orderBy("_o", "card_id")
    first = both.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return first.withColumn("card_id", F.format_string("card-%05d", F.row_number().over(Window.orderBy("_o", "card_id")))).drop("_o", "_p", "_k")


