"""URL filters by a sort-merge range join of reversed-host keys with rule intervals.

A host becomes the key of its labels in reverse, each followed by a dot (net.example.a.), so
that a rule's host and its subdomains are one interval of keys, from `net.example.` up to
`net.example/`. Intervals nest or are apart. A sweep over the sorted keys of rule starts,
rule ends and urls carries the stack of open rules: each start holds its own stack, each end
its parent's, and a url takes that of the last event before it. Among the open rules whose
path begins the url's, the longest wins.

Work is dealt by the first two labels; those of over a HOT_SHARE-th of all urls (so at most
HOT_SHARE of them, a bounded broadcast) are split by salt and their rules repeated. Rules of
one label go to all parts under it.

Defined results: a null url or one without `://` has empty host and path and gets `default`;
equal rules with two verdicts block; rules of one length rank by host length; repeated urls get
a row each; no rules: all `default`; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 5000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _part(key: Column) -> Column:
    return F.substring_index(key, ".", 2)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict. rules: (host, path, verdict)."""
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.filter("host <> '' and path is not null").groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "host", "path", "verdict")
    nodes = rules.groupBy("host").agg(F.collect_list(rule).alias("own")).withColumn("key", _key(F.col("host")))
    # a node's stack: the rules of every node whose key begins its key
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    above = nodes.withColumn("labels", labels).select("key", F.explode(F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, 1, k), '.') || '.')")).alias("up"))
    chains = above.join(nodes.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own")))).alias("below"))
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("key", _key(F.col("host"))).withColumn("part", _part(F.col("key")))
    counts = rows.groupBy("part").count()
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("total")))).filter(F.col("count") * HOT_SHARE > F.col("total")).select(F.col("part").alias("_part"), F.ceil(F.col("count") * HOT_SHARE / F.col("total")).cast("int").alias("salts"))
    # one label: every part under it; more: the part of its own
    ends = F.expr("array(struct(key as at, 1 as kind, stack as open), struct(substring(key, 1, length(key) - 1) || '/' as at, 0 as kind, below as open))")
    one = F.size(F.filter(F.split("key", r"\."), lambda x: x != "")) == 1
    wide = chains.filter(one).join(counts.select("part").withColumn("_top", F.concat(F.substring_index("part", ".", 1), F.lit("."))), F.col("key") == F.col("_top")).drop("_top")
    narrow = chains.filter(~one).withColumn("part", _part(F.col("key")))
    events = wide.select("part", "key", "stack", "below").unionByName(narrow.select("part", "key", "stack", "below"))
    events = events.join(F.broadcast(hot), F.col("part") == F.col("_part"), "left").select("part", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("salt"), F.explode(ends).alias("e")).select("part", "salt", "e.*")
    salted = rows.join(F.broadcast(hot), F.col("part") == F.col("_part"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "path", "host"), F.col("salts").cast("bigint")).cast("int"), F.lit(0)))
    urls = salted.select("part", "salt", F.col("key").alias("at"), F.lit(2).alias("kind"), F.struct("page_id", "host", "path").alias("url"))
    sweep = Window.partitionBy("part", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = urls.unionByName(events, allowMissingColumns=True).withColumn("stack", F.last("open", True).over(sweep)).filter("kind = 2")
    fits = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("url.path"), r["path"])))
    best = swept.select("url.*", fits.alias("best"))
    return best.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
