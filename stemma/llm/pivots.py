"""Exact top-k inner products over a pivot-distance index.

Vectors are raised to a common norm by one more component, sqrt(M - |x|^2), and queries get 0
there; the largest inner product is then the least distance. Every vector is keyed by its
nearest pivot and its distance to it; runs of the sorted keys with one pivot are stored as
annuli of some thousand rows. A query at distance d from a pivot is at least
max(d - far, near - d) from all of an annulus, which bounds its scores there. Queries go in
chunks: each round a chunk takes up its next annuli in the order of those bounds, each time
more, and a query stops once no bound reaches its k-th score so far. Scores are integers and
exact; bounds carry a margin for rounding, so that no result is lost.

Pivots come from at most SAMPLE vectors, those of least hash of the id, by farthest-first
choice; all vectors are indexed. Annuli are sized so that their list, which chunks need in
full, has at most some MAX_ANNULI entries.

Defined results: vectors that are null, or hold null or non-finite components, and null ids
take no part; vectors of different lengths are not compared; equal scores rank by id; of rows
that repeat an id each is a query and a candidate of the others, so that such an id has several
rows of a rank; with fewer candidates all are returned; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.storage import lean, stored

SAMPLE = 4096
PIVOTS = 32
ANNULUS = 2048
MAX_ANNULI = 500_000
CHUNK = 1024
FIRST = 3
GROWTH = 8


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v (floor(scale * x) of each component), size."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * scale))
    fine = F.forall(F.col(vector_col), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), x.alias("v"), F.size(vector_col).alias("size"))


def _choose(sample: np.ndarray, top: float) -> np.ndarray:
    """Raised pivots, farthest first."""
    up = np.c_[sample, np.sqrt(np.maximum(top - (sample**2).sum(1), 0))]
    chosen = [0]
    away = ((up - up[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(up)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((up - up[chosen[-1]]) ** 2).sum(1))
    return up[chosen]


def _distances(raised: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((raised**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * raised @ pivots.T, 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _packed(rows: DataFrame, pivots, top: float, size: int, query: bool, limit: int) -> DataFrame:
    """Annuli (or chunks of queries) of at most limit rows: name, pivot, near, far, n, ids, keys, vectors; a chunk may hold several pivots' rows."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), size)
            d = _distances(np.c_[x, np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x**2).sum(1), 0))], pivots.value)
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p]), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], ["id", "key", "pivot", "d", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def done() -> pa.RecordBatch:
            ids, keys, ps, ds, vs = zip(*held)
            return pa.RecordBatch.from_pydict({"name": pa.array([part * 2**32 + k], pa.int64()), "pivot": pa.array([ps[0]], pa.int32()), "near": [min(ds)], "far": [max(ds)], "n": pa.array([len(ids)], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "keys": [np.array(keys, "<i8").tobytes()], "vectors": [b"".join(vs)]})

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (len(held) >= limit or not query and row[2] != held[-1][2]):
                    yield done()
                    held, k = [], k + 1
                held.append(row)
        if held:
            yield done()

    keyed = rows.select("id", "key", "v").mapInArrow(lean(key), "id bigint, key bigint, pivot int, d double, vector binary")
    return keyed.repartitionByRange("pivot", "d", "id", "key").sortWithinPartitions("pivot", "d", "id", "key").mapInArrow(lean(pack), "name bigint, pivot int, near double, far double, n int, ids binary, keys binary, vectors binary")


def _one_size(rows: DataFrame, queries, size: int, n: int, top: float, k: int, annulus: int, chunk: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.select("id", "key", "v").withColumn("_h", F.xxhash64("id")).orderBy("_h", "id", "key").limit(SAMPLE).drop("_h").collect()
    pivots = spark.sparkContext.broadcast(_choose(np.array([r["v"] for r in sorted(sample, key=lambda r: (r["id"], r["key"]))], float).reshape(-1, size), top))
    annuli = stored(_packed(rows, pivots, top, size, False, max(annulus, -(-n // MAX_ANNULI))), "annuli")
    chunks = stored(_packed(rows.filter(queries), pivots, top, size, True, chunk), "chunks")
    table = spark.sparkContext.broadcast(tuple(np.array(x) for x in zip(*((r["name"], r["pivot"], r["near"], r["far"]) for r in annuli.select("name", "pivot", "near", "far").toLocalIterator()))))

    def bounds(vectors: np.ndarray) -> np.ndarray:
        """[queries, annuli]: what no score exceeds."""
        _, pivot, near, far = table.value
        d = _distances(np.c_[vectors, np.zeros(len(vectors))], pivots.value)[:, pivot]
        low = np.maximum(np.maximum(d - far, near - d), 0)
        norms = (vectors**2).sum(1)[:, None]
        low = np.maximum(low - 1e-7 * (np.sqrt(norms) + np.sqrt(top) + 1), 0)
        return (norms + top - low * low) / 2 + 1e-6 * (norms + top) + 1

    def choose(width: int, done: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, vectors, floors in zip(*(b.column(c).to_pylist() for c in ("name", "vectors", "floors"))):
                    x = np.frombuffer(vectors, "<i8").reshape(-1, size).astype(float)
                    bound = bounds(x)
                    order = np.argsort(-bound.max(0), kind="stable")  # the same in each round
                    floor = np.full(len(x), -np.inf)
                    for f in floors or ():
                        floor[f["q"]] = f["s"]
                    live = (bound >= floor[:, None]).any(0)
                    take = [table.value[0][a] for a in order[done : done + width] if live[a]]
                    more = bool(live[order[done + width :]].any())
                    take.append(None)  # the chunk's word on whether any later annulus may still matter
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(take), pa.int64()), pa.array(take, pa.int64()), pa.array([more] * len(take), pa.bool_())], ["chunk", "annulus", "more"])

        return run

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q, x = (np.frombuffer(row[c], "<i8").reshape(-1, size) for c in ("q_vectors", "vectors"))
                q_ids, ids, q_keys, keys = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "ids", "q_keys", "keys"))
                exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * size < 2**53
                score = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else q @ x.T
                floor = np.full(len(q), np.iinfo(np.int64).min)
                for f in row["floors"] or ():
                    floor[f["q"]] = f["s"]
                other = q_keys[:, None] != keys
                score = np.where(other, score, np.iinfo(np.int64).min)
                if score.shape[1] > k:  # negated, the least int64 would wrap and count as the best
                    floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
                at, of = np.nonzero((score >= floor[:, None]) & other)
                s, i = score[at, of], ids[of]
                order = np.lexsort((i, -s, at))
                at, s, i = at[order], s[order], i[order]
                begin = np.searchsorted(at, at, "left")
                keep = np.arange(len(at)) - begin < k
                at, s, i = at[keep], s[keep], i[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["chunk"], np.int64)), pa.array(at.astype(np.int32)), pa.array(q_ids[at]), pa.array(i), pa.array(s)], ["chunk", "q", "query_id", "vec_id", "score"])

    best, done, width = None, 0, FIRST
    ranked = Window.partitionBy("chunk", "q").orderBy(F.desc("score"), "vec_id")
    while True:
        if best is None:
            now = chunks.withColumn("floors", F.lit(None).cast("array<struct<q:int,s:bigint>>"))
        else:
            floors = best.filter(F.col("rank") == k).groupBy("chunk").agg(F.collect_list(F.struct("q", F.col("score").alias("s"))).alias("floors"))
            now = chunks.join(floors, F.col("name") == F.col("chunk"), "left").drop("chunk")
        now = stored(now, "round")
        pairs = stored(now.select("name", "vectors", "floors").mapInArrow(lean(choose(width, done)), "chunk bigint, annulus bigint, more boolean"), "pairs")
        work = pairs.join(annuli.select(F.col("name").alias("annulus"), "ids", "keys", "vectors"), "annulus")
        work = work.join(now.select(F.col("name").alias("chunk"), F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors"), "floors"), "chunk")
        found = work.repartition("chunk", "annulus").mapInArrow(lean(evaluate), "chunk bigint, q int, query_id bigint, vec_id bigint, score bigint")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k), "best")
        done, width = done + width, width * GROWTH
        if done >= len(table.value[0]) or pairs.filter("more").isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", annulus: int = ANNULUS, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score. queries: a condition on `id`."""
    rows = stored(integers(vectors, id_col, vector_col, scale).withColumn("key", F.monotonically_increasing_id()), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.max(norm).alias("top")).collect()  # a row for each vector length
    parts = [_one_size(rows.filter(F.col("size") == r["size"]), queries, r["size"], r["n"], r["top"], k, annulus, chunk) for r in sorted(sizes, key=lambda r: r["size"]) if r["size"] > 0]
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
