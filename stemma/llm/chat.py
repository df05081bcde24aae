"""Preference formatting: one prompt, two masked completions.

The turns that the chosen and the rejected conversation begin with alike, role and text, are
rendered once as the prompt; what follows is rendered for each as its completion. A
completion's mask are the spans of assistant text in it (character offsets within the
completion): only these count in a loss, the prompt and markers never do. Built-in functions
only; turns meet by conversation, in one shuffle.

Defined results: turns sort by turn, role, text; null roles and texts render empty and equal
null only; a null or empty conversation has no turns, so the prompt is empty; equal
conversations are all prompt with empty completions; repeated turns stay; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turns_of(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turns: array<struct<role, text>> in order."""
    held = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.groupBy(F.col(id_col).alias("conv_id")).agg(held.alias("h")).select("conv_id", F.expr("transform(h, t -> struct(t.role as role, t.text as text))").alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def _spans(turns: str) -> Column:
    """start-end of each assistant text in what _rendered() gives, ';'-joined."""
    size = "length(coalesce(t.role, '')) + length(coalesce(t.text, '')) + 6"
    step = f"""named_struct('at', acc.at + {size}, 'spans', if(t.role = 'assistant',
        concat(acc.spans, array(concat(acc.at + length(t.role) + 5, '-', acc.at + {size} - 1))), acc.spans))"""
    return F.array_join(F.expr(f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<string>)), (acc, t) -> {step}, acc -> acc.spans)"), ";")


def preferences(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask. pairs: id, chosen, rejected: array<struct<role, text>>."""
    some = pairs.select(F.col(id_col).alias("pair_id"), *(F.expr(f"coalesce({c}, cast(array() as array<struct<role: string, text: string>>))").alias(c) for c in ("chosen", "rejected")))
    differ = "array_min(filter(sequence(0, least(size(chosen), size(rejected))), i -> i = least(size(chosen), size(rejected)) or not (chosen[i] <=> rejected[i])))"
    cut = some.withColumn("n_common", F.expr(differ))
    rest = cut.select("pair_id", "n_common", F.expr("slice(chosen, 1, n_common)").alias("p"), *(F.expr(f"slice({c}, n_common + 1, size({c}))").alias(c[0]) for c in ("chosen", "rejected")))
    return rest.select(
        "pair_id", F.col("n_common").cast("bigint").alias("n_common"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _spans("c").alias("chosen_mask"), _spans("r").alias("rejected_mask"),
    )


def with_next_answers(conversations: DataFrame) -> DataFrame:
    """Pairs of each conversation as it is and with its last assistant turn answered by that of the next conversation id (empty if there is none)."""
    last = "array_max(filter(sequence(0, size(turns) - 1), i -> i >= 0 and turns[i].role = 'assistant'))"
    convs = turns_of(conversations).withColumn("last", F.expr(last))
    answers = convs.filter("last is not null").select((F.col("conv_id") - 1).alias("_conv"), F.expr("turns[last].text").alias("other"))
    joined = convs.join(answers, F.col("conv_id") == F.col("_conv"), "left")
    swapped = "transform(turns, (t, i) -> if(i = last, named_struct('role', t.role, 'text', coalesce(other, '')), t))"
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.expr(swapped).alias("rejected"))
