"""Record shapes, vocabularies and store validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = "struct<claim_id:string,chunk_id:string,section_number:string,quote:string,span:array<int>,tier:string,document:string>"
NODE = f"node_id string, type string, canonical_text string, fingerprint string, provenance array<{PROVENANCE}>, payload struct<number:string,attribution:string,base:double,log_bf:double>, tier string, meta map<string,string>"
EDGE = "edge_id string, type string, src string, dst string, directed boolean, payload map<string,string>, provenance map<string,string>, tier string"
CARD = "card_id string, kind string, weight double, premises array<string>, target string, active boolean, provenance map<string,string>, tier string"
EVENT = "event_id string, event_type string, payload string, cause string, model string, model_raw_output string, ts string"

# The vocabularies of the data model.
LAYERS = {"evidence": "data", "estimate": "data", "background": "data", "correlation_group": "data", "claim": "argument", "rebuttal": "argument", "assumption": "argument", "hypothesis": "question", "verdict": "question", "subquestion": "question"}
TYPE_MAP = {"research_question": "subquestion", "hypothesis": "hypothesis", "evidence": "evidence", "analysis": "claim", "quantitative_result": "estimate", "assumption": "assumption", "limitation": "rebuttal"}
CARD_KINDS = ("RA", "CA", "PA")
TIERS = ("T1", "T2", "T3")


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default) if not isinstance(default, Column) else default)


def layer_of(type_: Column) -> Column:
    return lookup(LAYERS, type_, "argument")


def validate_store(nodes: DataFrame, edges: DataFrame, cards: DataFrame) -> DataFrame:
    """(kind, id, problem), a row for each violation; an empty result is a valid store."""

    def rows(df: DataFrame, kind: str, id_col: str, problem: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), F.lit(problem).alias("problem"))

    ids = nodes.select(F.col("node_id").alias("_n")).distinct()

    def dangling(df: DataFrame, kind: str, id_col: str, ref: str, what: str) -> DataFrame:
        return rows(df.join(ids, F.col(ref) == F.col("_n"), "left_anti"), kind, id_col, what)

    found = [
        rows(nodes.filter(~F.col("type").isin(*LAYERS) | F.col("type").isNull()), "node", "node_id", "unknown type"),
        rows(nodes.filter(F.trim(F.coalesce("canonical_text", F.lit(""))) == ""), "node", "node_id", "empty text"),
        rows(cards.filter(~F.col("kind").isin(*CARD_KINDS) | F.col("kind").isNull()), "card", "card_id", "unknown kind"),
        rows(cards.filter(~F.coalesce(F.col("weight").between(0, 1), F.lit(False))), "card", "card_id", "weight out of range"),
        rows(cards.filter(F.coalesce(F.size("premises"), F.lit(0)) < 1), "card", "card_id", "no premises"),
        dangling(edges, "edge", "edge_id", "src", "dangling src"), dangling(edges, "edge", "edge_id", "dst", "dangling dst"),
        dangling(cards, "card", "card_id", "target", "dangling target"),
        dangling(cards.select("card_id", F.explode("premises").alias("premise")), "card", "card_id", "premise", "dangling premise"),
    ]
    for df, kind, id_col in ((nodes, "node", "node_id"), (edges, "edge", "edge_id"), (cards, "card", "card_id")):
        found.append(rows(df.groupBy(id_col).count().filter("count > 1"), kind, id_col, "duplicate id"))
    return reduce(DataFrame.unionByName, found)
