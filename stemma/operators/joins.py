"""Joins that stay spread where one key, or a few, hold much of a side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one row in so many are joined by broadcast: fewer than that many exist.
HOT_SHARE = 1000
#: Buckets of among()'s first filter: what it broadcasts at most.
BUCKETS = 1 << 18


def hot_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right, inner, on a column of both. right has a key once; left is read three times, so let it be stored.

    Rows of left under a frequent key stay where they are and get right's row by broadcast."""
    counts = left.groupBy(key).count()
    hot = counts.filter(F.col("count") * HOT_SHARE > left.count()).filter(F.col(key).isNotNull()).select(key, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot), key, "left")
    few = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    known = marked.filter("_hot").drop("_hot").join(F.broadcast(few), key)
    return known.unionByName(marked.filter("_hot is null").drop("_hot").join(right, key))


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df's rows whose key (a bigint) is in keys. A broadcast of at most BUCKETS buckets of the keys
    drops most rows before they are shuffled, as long as the keys are few against BUCKETS; the
    semi join decides."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    some = keys.select(bucket.alias("_bucket")).distinct()
    near = df.withColumn("_bucket", bucket).join(F.broadcast(some), "_bucket", "left_semi").drop("_bucket")
    return near.join(keys.select(key).distinct(), key, "left_semi")
