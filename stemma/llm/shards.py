"""Sharding by longest-processing-time scheduling, law `bytes`: groups stay whole, shard sizes come near equal.

A group's rows (equal texts) stay together. Groups are taken by size, largest first, each
going to the least-loaded shard of a heap. The driver holds no groups, only their histogram:
sizes up to 2^16 exactly, larger ones by their 16 leading bits (at most 65,536 + 32,768 * 47
classes, whatever the corpus). n groups of one class are dealt by levelling in one step and
the heap for the remainder, which is what item by item gives. A group finds its shard by its
rank within its class.

Defined results: a null text has no bytes, counts 8 and is grouped with the empty text;
repeated rows are one group; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.storage import stored
from stemma.llm.packing import PER_BUCKET, _ranked

#: Groups of at least this share of all rows are joined by broadcast: at most so many exist.
HOT_SHARE = 1000


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """classes: (class, groups, bytes in all), any order -> (class, first rank, shard) by runs, from the heaviest mean size on."""
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for c, n, total in sorted(classes, key=lambda x: (-x[2] / x[1], x[0])):
        each, rank = total / n, 0
        if n > 4 * shards:
            loads = np.array([x for x, _ in sorted(heap, key=lambda y: y[1])])
            low, high = loads.min(), loads.min() + each * (n + 1)
            for _ in range(64):  # the highest level that at most n groups reach
                mid = (low + high) / 2
                low, high = (mid, high) if np.floor(np.maximum(mid - loads, 0) / each).sum() <= n else (low, mid)
            take = np.floor(np.maximum(low - loads, 0) / each).astype(np.int64)
            for s, k in enumerate(take.tolist()):
                if k:
                    out.append((c, rank, s))
                    rank += k
            heap = [(float(loads[s] + take[s] * each), s) for s in range(shards)]
            heapq.heapify(heap)
        while rank < n:
            load, s = heap[0]
            out.append((c, rank, s))
            heapq.heapreplace(heap, (load + each, s))
            rank += 1
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group")), "sized")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"))
    width = F.greatest(F.floor(F.log2("bytes")) - 15, F.lit(0)).cast("int")
    groups = stored(groups.withColumn("class", F.call_function("shiftleft", F.call_function("shiftright", F.col("bytes"), width), width)), "groups")
    classes = [(r[0], r[1], r[2]) for r in groups.groupBy("class").agg(F.count("*"), F.sum("bytes")).collect()]
    n_groups = sum(r[1] for r in classes)
    runs = sorted(schedule(classes, shards))
    firsts = spark.createDataFrame([(c, f, g, s) for (c, f, s), g in zip(runs, [*(y[1] if y[0] == x[0] else 1 << 62 for x, y in zip(runs, runs[1:])), 1 << 62])], "class bigint, first bigint, past bigint, shard int")
    ranked = _ranked(groups, "class", ["group"], n_groups)
    dealt = ranked.join(firsts.withColumnRenamed("class", "_c"), (F.col("class") == F.col("_c")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))).select("group", "copies", "shard")
    dealt = stored(dealt, "dealt")
    total = rows.count()
    hot = dealt.filter(F.col("copies") * HOT_SHARE > total).select(F.col("group").alias("_g"), F.col("shard").alias("hot_shard"))
    rest = dealt.filter(F.col("copies") * HOT_SHARE <= total).select("group", "shard")
    marked = rows.join(F.broadcast(hot), rows["group"] == hot["_g"], "left").drop("_g")
    known = marked.filter(F.col("hot_shard").isNotNull()).select("doc_id", "size", "text_crc32", F.col("hot_shard").alias("shard"))
    found = marked.filter(F.col("hot_shard").isNull()).join(rest, "group").select("doc_id", "size", "text_crc32", "shard")
    placed = stored(known.unionByName(found), "placed")
    slots = _ranked(placed, "shard", ["doc_id", "text_crc32"], total // max(1, shards) + PER_BUCKET)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
