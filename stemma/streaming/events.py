"""The append-only event log: batch fold, role resolution, and the same fold over a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(log: DataFrame, events: DataFrame, order: str) -> DataFrame:
    """events numbered on from the log's count."""
    n = log.count()
    return log.unionByName(events.withColumn("event_id", F.format_string("ev-%06d", F.row_number().over(Window.orderBy(order)) + n)), allowMissingColumns=True)


def claims(events: DataFrame) -> DataFrame:
    """key, payload, n_tags, last_tag: each claim as last added, with the tags since. events: seq, event_type, key, payload."""
    added = F.max(F.when(F.col("event_type") == "claim_added", F.col("seq")))
    base = events.filter(F.col("event_type").isin("claim_added", "claim_tagged"))
    at = base.groupBy("key").agg(added.alias("_added"), F.max_by("payload", F.when(F.col("event_type") == "claim_added", F.col("seq"))).alias("payload")).filter("_added is not null")
    tags = base.filter("event_type = 'claim_tagged'").select("key", "seq", F.col("payload").alias("tag"))
    since = at.join(tags, "key", "left").withColumn("_on", F.col("seq") > F.col("_added"))
    return since.groupBy("key", "payload").agg(F.count_if("_on").alias("n_tags"), F.max_by("tag", F.when(F.col("_on"), F.col("seq"))).alias("last_tag"))


def cards(events: DataFrame) -> DataFrame:
    """key, payload, active: each card as last added; off iff deactivated after that."""
    seq = lambda t: F.max(F.when(F.col("event_type") == t, F.col("seq")))
    got = events.groupBy("key").agg(seq("card_added").alias("_a"), seq("card_deactivated").alias("_d"), F.max_by("payload", F.when(F.col("event_type") == "card_added", F.col("seq"))).alias("payload"))
    return got.filter("_a is not null").select("key", "payload", (F.coalesce("_d", F.lit(-1)) < F.col("_a")).alias("active"))


def latest(events: DataFrame, event_type: str) -> DataFrame:
    """key, payload: the last event of a type by key, as scores, verdicts and attributions are folded."""
    return events.filter(F.col("event_type") == event_type).groupBy("key").agg(F.max_by("payload", "seq").alias("payload"))


def operative_roles(votes: DataFrame, primary: str) -> DataFrame:
    """claim_id, role, agreement: primary model's primary pass, else its last real vote, else the last real one, else the last. votes: claim_id, model, pass, role, seq."""
    real = F.col("role") != "UNPARSED"
    grade = F.when(real & (F.col("model") == primary) & (F.col("pass") == "primary"), 0).when(real & (F.col("model") == primary), 1).when(real, 2).otherwise(3)
    w = Window.partitionBy("claim_id").orderBy("_g", F.when(F.col("_g") == 0, F.col("seq")).asc_nulls_last(), F.desc("seq"))
    first = votes.withColumn("_g", grade).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("claim_id", "role")
    last = votes.filter(real).groupBy("claim_id", "model").agg(F.max_by("role", "seq").alias("r")).groupBy("claim_id").agg((F.count_distinct("r") <= 1).alias("agreement"))
    return first.join(last, "claim_id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(True)))


CARD_STATE = "added long, deactivated long, payload string"


def streamed_cards(events: DataFrame) -> DataFrame:
    """cards() over a stream, in update mode: late events count by seq, and none is dropped."""

    def fold(key, batches, state):
        a, d, p = state.get if state.exists else (-1, -1, None)
        for pdf in batches:
            for seq, kind, payload in zip(pdf["seq"], pdf["event_type"], pdf["payload"]):
                if kind == "card_added" and seq > a:
                    a, p = int(seq), payload
                elif kind == "card_deactivated":
                    d = max(d, int(seq))
        state.update((a, d, p))
        if a >= 0:
            yield pd.DataFrame({"key": [key[0]], "payload": [p], "active": [d < a]})

    kind = dict(events.dtypes)["key"]
    return events.select("key", "seq", "event_type", "payload").groupBy("key").applyInPandasWithState(fold, f"key {kind}, payload string, active boolean", CARD_STATE, "update", "NoTimeout")
