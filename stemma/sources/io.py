"""Scans and sinks of the record files, and the response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_missing_ok(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return scan_jsonl(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def scan_ids_spec(spark: SparkSession, spec: str) -> DataFrame:
    """Ids of a comma list, or of a file, of which only tokens that begin n- count."""
    if _exists(spark, spec):
        words = spark.read.text(spec).select(F.explode(F.split("value", r"[\s,]+")).alias("node_id"))
        return words.filter(F.startswith("node_id", F.lit("n-"))).distinct()
    return spark.createDataFrame([(x.strip(),) for x in spec.split(",") if x.strip()], "node_id string")


def sink_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def sink_text_per_group(df: DataFrame, path: str, group: str, text: str) -> None:
    df.select(group, F.col(text).alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def cache_split(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached response, misses)."""
    return requests.join(cache, keys), requests.join(cache.select(*keys).distinct(), keys, "left_anti")


def budgeted(df: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """Requests made before the budget is spent: tokens of all earlier ones below it."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(tokens).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_spent", before).filter(F.col("_spent") < budget).drop("_spent")


def slugs(df: DataFrame, name: str, position: str) -> DataFrame:
    """df with doc_slug; repeats get -2, -3, ... in order."""
    from pyspark.sql import Window

    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    n = F.row_number().over(Window.partitionBy("_slug").orderBy(position))
    return df.withColumn("_slug", slug).withColumn("_n", n).withColumn("doc_slug", F.when(F.col("_n") > 1, F.concat("_slug", F.lit("-"), F.col("_n"))).otherwise(F.col("_slug"))).drop("_slug", "_n")
