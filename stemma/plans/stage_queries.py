"""Registered queries over what stands between the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import spans as S
from stemma.operators import assembly as A
from stemma.plans.graph import WITH, graph
from stemma.plans.queries import _EVENT, _MERGED, _SPANS, _events, query, r6
from stemma.storage import table
from stemma.streaming import events as V

_KINDS = ["hypothesis", "evidence", "analysis"]
_ROLE = "CASE quality WHEN 1 THEN 'evidentiary' WHEN 0 THEN 'procedural' ELSE 'UNPARSED' END"
_SECOND = "CASE toxic WHEN 1 THEN 'conclusory' ELSE 'UNPARSED' END"


@query("""WITH s AS (SELECT DISTINCT conv_id AS doc_id, turn AS section FROM conversations), k AS (SELECT * FROM (VALUES (0, 'hypothesis'), (1, 'evidence'), (2, 'analysis')) t(o, node_type))
  SELECT doc_id, section, node_type, (row_number() OVER (PARTITION BY doc_id ORDER BY o, section))::INTEGER AS seq FROM s CROSS JOIN k""")
def extraction_requests(spark, sf):
    sections = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section"), F.col("turn").alias("section_order")).distinct()
    documents = sections.select("doc_id", F.col("doc_id").alias("doc_order")).distinct()
    return A.fan_out(documents, sections, _KINDS)


@query("""WITH b AS (SELECT source AS doc_id, lang AS section, CASE WHEN doc_id % 2 = 0 THEN 'claim' ELSE 'evidence' END AS node_type, doc_id AS idx FROM documents), o AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY section DESC) AS so FROM (SELECT DISTINCT doc_id, section FROM b))
  SELECT idx, (row_number() OVER (PARTITION BY b.doc_id ORDER BY so NULLS LAST, b.section, node_type, idx))::INTEGER AS position FROM b LEFT JOIN o ON o.doc_id = b.doc_id AND o.section = b.section""")
def combined_nodes(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("section"), F.when(F.col("doc_id") % 2 == 0, "claim").otherwise("evidence").alias("node_type"), F.col("doc_id").alias("idx"))
    order = rows.select("doc_id", "section").distinct().withColumn("section_order", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("section"))))
    return A.combined([rows.filter(f"node_type = '{t}'") for t in ("claim", "evidence")], order).select("idx", "position")


@query("""WITH h AS (SELECT doc_id AS node_id, source AS doc_id FROM documents WHERE doc_id % 4 = 0), k AS (SELECT * FROM h WHERE node_id % 8 = 0 AND doc_id >= 'f')
  SELECT node_id, doc_id NOT IN (SELECT doc_id FROM k) OR node_id IN (SELECT node_id FROM k) AS kept FROM h WHERE doc_id IS NOT NULL""")
def top_level_hypotheses(spark, sf):
    nodes = table(spark, sf, "documents").filter("doc_id % 4 = 0 and source is not null").select(F.col("doc_id").alias("node_id"), F.col("source").alias("doc_id"), F.lit("hypothesis").alias("node_type"))
    return A.top_level(nodes, nodes.filter("node_id % 8 = 0 and doc_id >= 'f'").select("doc_id", "node_id")).select("node_id", "kept")


@query("SELECT doc_id AS node_id FROM documents WHERE doc_id % 3 <> 0 AND lang <> 'en'")
def provenance_without_document(spark, sf):
    named = F.when((F.col("doc_id") % 3 == 0) | (F.col("lang") == "en"), F.col("source"))
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.array(F.struct(F.col("source").alias("document")), F.struct(named.alias("document"))).alias("provenance"))
    return A.without_document(nodes).select("node_id")


def _votes(spark, sf):
    one = lambda r, s: F.struct(F.expr(r).alias("role"), F.lit(s).alias("seq"))
    return table(spark, sf, "labels").select(F.col("doc_id").alias("claim_id"), F.explode(F.array(one(_SECOND, 1), one(_ROLE, 2))).alias("v")).select("claim_id", "v.*")


@query(f"SELECT doc_id AS claim_id, CASE WHEN {_SECOND} <> 'UNPARSED' THEN {_SECOND} ELSE {_ROLE} END AS role FROM labels")
def first_votes(spark, sf):
    return A.first_votes(_votes(spark, sf))


@query(f"SELECT doc_id AS claim_id, {_SECOND} <> 'UNPARSED' AS done FROM labels")
def tagging_done(spark, sf):
    return A.tagged(_votes(spark, sf).filter("seq = 1"), ["claim_id"])


_ROLES = f"SELECT n.node_id, {_ROLE} AS role FROM nodes n JOIN labels l ON l.doc_id = n.node_id"


def _node_roles(spark, sf):
    nodes = graph(spark, sf).nodes.select("node_id", F.array(F.struct(F.col("node_id").alias("claim_id"))).alias("provenance"))
    return A.node_roles(nodes, table(spark, sf, "labels").select(F.col("doc_id").alias("claim_id"), F.expr(_ROLE).alias("role")))


@query(WITH + " " + _ROLES)
def node_roles(spark, sf):
    return _node_roles(spark, sf)


@query(WITH + f", roles AS ({_ROLES}), ends AS (SELECT card_id, src AS node_id FROM cards UNION SELECT card_id, target FROM cards) SELECT card_id, node_id FROM ends WHERE node_id IN (SELECT node_id FROM roles WHERE role = 'procedural')")
def leaking_cards(spark, sf):
    return A.leaks(graph(spark, sf).cards, _node_roles(spark, sf), "procedural")


@query(WITH + " SELECT card_id, document::VARCHAR AS documents FROM cards JOIN nodes ON node_id = src")
def card_documents(spark, sf):
    g = graph(spark, sf)
    return A.card_documents(g.cards, g.nodes).select("card_id", F.array_join(F.transform("documents", lambda d: d.cast("string")), ",").alias("documents"))


@query(WITH + " SELECT type, count(*) AS n, round(100 * avg(CASE WHEN coalesce(number, '') <> '' THEN 1.0::DOUBLE ELSE 0 END), 1) AS with_number FROM nodes GROUP BY type")
def typed_summary(spark, sf):
    return A.typed_summary(graph(spark, sf).nodes)


@query(_SPANS + _MERGED + """, c AS (SELECT k, sum(e - s)::BIGINT AS covered FROM m GROUP BY k), t AS (SELECT o_orderkey AS k, 150 AS n_chars FROM orders)
  SELECT k, n_chars::INTEGER AS n_chars, coalesce(covered, 0)::BIGINT AS covered, round(coalesce(covered, 0)::DOUBLE / n_chars, 4) AS ratio FROM t LEFT JOIN c USING (k)""")
def coverage_report(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("int")).alias("end"))
    texts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.repeat(F.lit("x"), F.lit(150)).alias("text"))
    return A.coverage(S.merged(x, "k"), texts, "k")


@query("""WITH f AS (SELECT source AS entity, sum(n_chars)::DOUBLE / 1000 AS s, count(DISTINCT doc_id) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
  SELECT entity AS node, round(s / n, 6) AS weight FROM f UNION ALL SELECT 'p' || doc_id, round(n_chars::DOUBLE / 1000 * 0.05, 6) FROM documents""")
def seed_weights(spark, sf):
    d = table(spark, sf, "documents").withColumns({"passage": F.concat(F.lit("p"), F.col("doc_id").cast("string")), "score": F.col("n_chars").cast("double") / 1000})
    named = d.filter("source is not null").withColumnRenamed("source", "entity")
    return A.seed_weights(named.select("entity", "score"), named.select("passage", "entity"), d.select("passage", "score")).select("node", r6("weight"))


@query("SELECT doc_id, 'chunk-' || md5(text) AS chunk_id, 'entity-' || md5(source) AS entity_id FROM documents")
def hashed_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.hashed_id("chunk", F.col("text")).alias("chunk_id"), A.hashed_id("entity", F.col("source")).alias("entity_id"))


@query(f"SELECT user_id AS key, arg_max(props, event_id) AS payload FROM events WHERE {_EVENT} = 'claim_tagged' GROUP BY user_id")
def fold_latest(spark, sf):
    return V.latest(_events(spark, sf), "claim_tagged")


@query("SELECT NULL::BIGINT AS key, NULL::VARCHAR AS payload, NULL::BOOLEAN AS active, count(*) AS n FROM events WHERE false")
def replay_differences(spark, sf):
    """A replay of the shuffled log gives the same cards: one row that counts no difference."""
    log = _events(spark, sf)
    empty = A.differing(V.cards(log), V.cards(log.repartition(5, "seq")))
    return empty.agg(F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("boolean").alias("active"), F.count("*").alias("n"))
