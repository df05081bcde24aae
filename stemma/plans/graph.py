"""The deterministic graph over the driver's tables: nodes from embeddings, pairs by the funnel, cards by a rule, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.funnel import funnel
from stemma.operators.scoring import score_graph
from stemma.schema import layer_of, lookup
from stemma.storage import stored, table

TOTAL = 1000
TYPES = {0: "evidence", 1: "evidence", 2: "evidence", 3: "estimate", 4: "background", 5: "claim", 6: "claim", 7: "rebuttal", 8: "assumption", 9: "hypothesis"}

_built: dict[tuple[str, str], "Graph"] = {}


class Graph:
    """nodes, pairs, cards and scores as stored tables, made once for a session and input."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
        text = d.select(F.col("doc_id").alias("node_id"), F.col("text").alias("canonical_text"))
        base = e.select(F.col("vec_id").alias("node_id"), lookup(TYPES, F.col("label"), "claim").alias("type"), F.col("embedding").cast("array<double>").alias("vector")).join(text, "node_id", "left")
        first = F.nullif(F.regexp_extract(F.coalesce("canonical_text", F.lit("")), r"[0-9]+(\.[0-9]+)?", 0), F.lit(""))
        number = F.coalesce(first, F.when(F.col("type") == "estimate", F.concat(F.col("node_id").cast("string"), F.lit("%"))))
        self.nodes = stored(base.withColumns({"layer": layer_of(F.col("type")), "document": (F.col("node_id") % 2).cast("int"), "number": number}), "nodes")
        self.pairs = stored(funnel(self.nodes.select("node_id", "layer", "vector"), TOTAL), "pairs")
        h = (F.col("src") * 31 + F.col("dst") * 17) % 10
        w = (F.col("src") + F.col("dst")) % 3
        cards = self.pairs.withColumn("kind", F.when(h < 5, "RA").when(h < 7, "CA")).filter("kind is not null")
        self.cards = stored(cards.select(F.col("rank").cast("bigint").alias("card_id"), "kind", F.when(w == 0, 0.85).when(w == 1, 0.6).otherwise(0.35).alias("weight"), F.array("src").alias("premises"), F.col("dst").alias("target"), F.lit(True).alias("active")), "cards")
        self.scores = stored(score_graph(self.nodes.select("node_id"), self.cards), "scores")

    def root(self) -> int:
        """The first question that a supporting card reaches (-1 if none)."""
        q = self.nodes.filter("layer = 'question'").select(F.col("node_id").alias("target"))
        return self.cards.filter("kind = 'RA'").join(q, "target", "left_semi").agg(F.coalesce(F.min("target"), F.lit(-1))).first()[0]


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Graph(spark, sf_dir)
    return _built[key]


#: The same graph in SQL.
SQL = """
nodes AS (SELECT *, CASE WHEN type IN ('evidence', 'estimate', 'background') THEN 'data' WHEN type = 'hypothesis' THEN 'question' ELSE 'argument' END AS layer, (node_id % 2)::INTEGER AS document,
  coalesce(nullif(regexp_extract(coalesce(txt, ''), '[0-9]+(\\.[0-9]+)?'), ''), CASE WHEN type = 'estimate' THEN node_id || '%' END) AS number
  FROM (SELECT vec_id AS node_id, CASE WHEN label <= 2 THEN 'evidence' WHEN label = 3 THEN 'estimate' WHEN label = 4 THEN 'background' WHEN label <= 6 THEN 'claim' WHEN label = 7 THEN 'rebuttal' WHEN label = 8 THEN 'assumption' ELSE 'hypothesis' END AS type,
    embedding::DOUBLE[] AS e, d.text AS txt FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id)),
td AS (SELECT src, dst, c FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY c DESC, src) AS k FROM (SELECT s.node_id AS src, d.node_id AS dst, round(list_cosine_similarity(s.e, d.e), 6) AS c FROM nodes s JOIN nodes d ON s.layer = 'data' AND d.layer = 'question')) WHERE k <= 50 ORDER BY c DESC, src, dst LIMIT 550),
da AS (SELECT s.node_id AS src, d.node_id AS dst, round(list_cosine_similarity(s.e, d.e), 6) AS c FROM nodes s JOIN nodes d ON s.layer = 'data' AND d.layer = 'argument' ORDER BY c DESC, src, dst LIMIT 300),
aq AS (SELECT s.node_id AS src, d.node_id AS dst, round(list_cosine_similarity(s.e, d.e), 6) AS c FROM nodes s JOIN nodes d ON s.layer = 'argument' AND d.layer = 'question' ORDER BY c DESC, src, dst LIMIT 150),
pairs AS (SELECT *, row_number() OVER (ORDER BY c DESC, src, dst)::INTEGER AS rank FROM (SELECT *, 'top_down' AS channel FROM td UNION ALL SELECT *, 'data_to_argument' FROM da UNION ALL SELECT *, 'argument_to_question' FROM aq)),
cards AS (SELECT rank::BIGINT AS card_id, CASE WHEN (src * 31 + dst * 17) % 10 < 5 THEN 'RA' ELSE 'CA' END AS kind, CASE (src + dst) % 3 WHEN 0 THEN 0.85::DOUBLE WHEN 1 THEN 0.6 ELSE 0.35 END AS weight, src, dst AS target FROM pairs WHERE (src * 31 + dst * 17) % 10 < 7),
"""


def scores_sql(cards: str, extra: str = "", prefix: str = "") -> str:
    """CTEs s1 (all but questions) and scores over `cards`; extra: a leading scenario column with its comma."""
    move = "CASE WHEN va >= vs THEN 0.5 - 0.5 * (va - vs) ELSE 0.5 + 0.5 * (vs - va) END"
    f = lambda k, s: f"coalesce(1 - product(1 - weight * {s}) FILTER (kind = '{k}'), 0)"
    return f"""
{prefix}l1 AS (SELECT {extra}target AS node_id, {f('CA', '0.5')} AS va, {f('RA', '0.5')} AS vs FROM {cards} c JOIN nodes n ON n.node_id = c.target AND n.layer = 'argument' GROUP BY {extra}target),
{prefix}s1 AS (SELECT *, {move} AS strength FROM {prefix}l1),
{prefix}l2 AS (SELECT {extra.replace('scenario', 'c.scenario') if extra else ''}target AS node_id, {f('CA', 'coalesce(s.strength, 0.5)')} AS va, {f('RA', 'coalesce(s.strength, 0.5)')} AS vs FROM {cards} c JOIN nodes n ON n.node_id = c.target AND n.layer = 'question' LEFT JOIN {prefix}s1 s ON s.node_id = c.src{' AND s.scenario = c.scenario' if extra else ''} GROUP BY {'c.scenario, ' if extra else ''}target),
{prefix}s2 AS (SELECT *, {move} AS strength FROM {prefix}l2)"""


WITH = "WITH RECURSIVE " + SQL + scores_sql("cards") + """,
scored AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
scores AS (SELECT n.node_id, coalesce(s.strength, 0.5) AS strength, coalesce(va, 0) AS va, coalesce(vs, 0) AS vs FROM nodes n LEFT JOIN scored s USING (node_id)),
sides AS (SELECT target AS node_id, count(*) FILTER (kind = 'RA') AS n_s, count(*) FILTER (kind = 'CA') AS n_a FROM cards GROUP BY target),
root AS (SELECT coalesce(min(target), -1) AS r FROM cards c JOIN nodes n ON n.node_id = c.target AND layer = 'question' WHERE kind = 'RA')"""
