"""Registered queries over records: labels to cards, validation, review, batches, bodies, coverage, dedup assembly, the baseline's parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import spans as S
from stemma.functions import text as T
from stemma.operators import claims as C
from stemma.operators import dedup as D
from stemma.operators import documents as O
from stemma.operators import funnel as P
from stemma.operators import retrieval as R
from stemma.plans.graph import WITH, graph
from stemma.plans.queries import _KG, _kg, query
from stemma.schema import validate_store
from stemma.storage import table

# --- pairs and cards -----------------------------------------------------------------------

#: Entailment scores stand in as a function of the ids.
_ENTAIL, _CONTRA = (f"((src * {a} + dst * {b}) % 100)::DOUBLE / 100" for a, b in ((7, 3), (5, 11)))


@query(WITH + f""", e AS (SELECT src, dst, channel, round(0.7::DOUBLE * greatest({_ENTAIL}, {_CONTRA}) + 0.3::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (c - 0.7::DOUBLE) / 0.3::DOUBLE)), 6) AS confidence FROM pairs)
  SELECT *, (row_number() OVER (ORDER BY confidence DESC, src, dst))::INTEGER AS rank FROM e QUALIFY rank <= 500""")
def entailment_rerank(spark, sf):
    score = lambda a, b: ((F.col("src") * a + F.col("dst") * b) % 100).cast("double") / 100
    pairs = graph(spark, sf).pairs.withColumn("confidence", F.round(P.blended(F.col("cosine"), score(7, 3), score(5, 11)), 6))
    return P.ranked(pairs.drop("rank"), 500).select("src", "dst", "channel", "confidence", "rank")


_LABELS = "lab AS (SELECT *, CASE (src + 2 * dst) % 4 WHEN 0 THEN 'support' WHEN 1 THEN 'attack' WHEN 2 THEN 'none' END AS relation, CASE src % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS strength FROM pairs)"


@query(WITH + ", " + _LABELS + """ SELECT printf('card-%05d', row_number() OVER (ORDER BY rank)) AS card_id, CASE relation WHEN 'support' THEN 'RA' ELSE 'CA' END AS kind, CASE strength WHEN 'high' THEN 0.85::DOUBLE WHEN 'medium' THEN 0.6 ELSE 0.35 END AS weight,
  src AS premise, dst AS target FROM lab WHERE relation IN ('support', 'attack')""")
def cards_from_labels(spark, sf):
    pairs = graph(spark, sf).pairs
    n = (F.col("src") + 2 * F.col("dst")) % 4
    relation = F.when(n == 0, "support").when(n == 1, "attack").when(n == 2, "none")
    strength = F.when(F.col("src") % 3 == 0, "high").when(F.col("src") % 3 == 1, "medium").otherwise("low")
    cards = P.cards_of(pairs, pairs.select("src", "dst", relation.alias("relation"), strength.alias("strength")))
    return cards.select("card_id", "kind", "weight", F.col("premises")[0].alias("premise"), "target")


@query(WITH + """, b AS (SELECT *, 0 AS o FROM cards WHERE card_id <= 400 UNION ALL SELECT *, 1 FROM cards WHERE card_id > 200), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src, target, kind ORDER BY o, card_id) = 1)
  SELECT printf('card-%05d', row_number() OVER (ORDER BY o, card_id)) AS card_id, kind, src AS premise, target FROM f""")
def merge_cards(spark, sf):
    cards = graph(spark, sf).cards
    merged = P.merge_cards(cards.filter("card_id <= 400"), cards.filter("card_id > 200"))
    return merged.select("card_id", "kind", F.col("premises")[0].alias("premise"), "target")


@query(WITH + """, e AS (SELECT rank, src, dst * 2 AS dst FROM pairs), c AS (SELECT card_id, CASE WHEN card_id % 10 = 0 THEN 'ZZ' ELSE kind END AS kind, weight * 1.5 AS weight, target FROM cards)
  SELECT * FROM (SELECT 'node' AS kind, 'empty text' AS problem, count(*) AS n FROM nodes WHERE trim(coalesce(txt, '')) = '' UNION ALL SELECT 'edge', 'dangling dst', count(*) FROM e WHERE dst NOT IN (SELECT node_id FROM nodes)
  UNION ALL SELECT 'card', 'unknown kind', count(*) FROM c WHERE kind = 'ZZ' UNION ALL SELECT 'card', 'weight out of range', count(*) FROM c WHERE weight > 1) WHERE n > 0""")
def store_violations(spark, sf):
    g = graph(spark, sf)
    edges = g.pairs.select(F.col("rank").alias("edge_id"), "src", (F.col("dst") * 2).alias("dst"))
    cards = g.cards.withColumns({"kind": F.when(F.col("card_id") % 10 == 0, "ZZ").otherwise(F.col("kind")), "weight": F.col("weight") * 1.5})
    return validate_store(g.nodes, edges, cards).groupBy("kind", "problem").agg(F.count("*").alias("n"))


@query(WITH + rf""" SELECT node_id, CASE WHEN j THEN 'claim' ELSE type END AS type, CASE WHEN j THEN type END AS retyped_from
  FROM (SELECT node_id, type, layer = 'data' AND regexp_matches(coalesce(txt, ''), '(?i){"|".join(T.JUDGMENT)}') AND NOT regexp_matches(coalesce(txt, ''), '(?i){"|".join(T.EXCUSED)}') AS j FROM nodes)""")
def retype_bridges(spark, sf):
    return C.retype_bridges(graph(spark, sf).nodes).select("node_id", "type", "retyped_from")


# --- around the model calls ------------------------------------------------------------------


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64)::BIGINT AS batch FROM documents")
def label_batches(spark, sf):
    return C.batches(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], 64, ["source"]).select("doc_id", "batch")


_VOTES = "CASE quality WHEN 1 THEN 'evidentiary' WHEN 0 THEN 'procedural' ELSE 'UNPARSED' END AS q, CASE toxic WHEN 1 THEN 'conclusory' WHEN 0 THEN 'procedural' ELSE 'UNPARSED' END AS t"


@query(f"""WITH v AS (SELECT l.doc_id, {_VOTES}, coalesce(d.source, '') AS source, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
  SELECT doc_id, round((CASE WHEN q = 'UNPARSED' OR t = 'UNPARSED' THEN 100 ELSE 0 END + CASE WHEN q <> t THEN 60 ELSE 0 END + CASE WHEN t = 'conclusory' AND NOT starts_with(source, '7') THEN 20 ELSE 0 END + CASE WHEN t = 'conclusory' THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(text, '(?i)bayes|prior|probability|odds|1/|factor|estimate|%') THEN 6 ELSE 0 END)::DOUBLE, 3) AS priority FROM v""")
def review_priority(spark, sf):
    q = F.when(F.col("quality") == 1, "evidentiary").when(F.col("quality") == 0, "procedural").otherwise("UNPARSED")
    t = F.when(F.col("toxic") == 1, "conclusory").when(F.col("toxic") == 0, "procedural").otherwise("UNPARSED")
    rows = table(spark, sf, "labels").select("doc_id", q.alias("q"), t.alias("t")).join(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    return rows.select("doc_id", F.round(C.review_priority(F.col("t"), F.col("q"), F.col("t"), F.col("t"), F.col("source"), F.col("text"), F.lit(1.0)), 3).alias("priority"))


_NUMBER = "CASE WHEN turn % 3 = 0 THEN (turn // 3)::VARCHAR ELSE (turn // 3)::VARCHAR || '.' || (turn % 3)::VARCHAR END"


@query(f"""WITH s AS (SELECT conv_id AS doc, turn AS ord, {_NUMBER} AS number FROM conversations)
  SELECT DISTINCT a.doc, a.ord, b.ord AS near FROM s a JOIN s b ON a.doc = b.doc AND (b.ord BETWEEN a.ord - 3 AND a.ord OR b.number = regexp_extract(a.number, '^(.*)\\.[^.]*$', 1))""")
def nearby_sections(spark, sf):
    whole, part = F.expr("cast(turn div 3 as string)"), F.expr("cast(turn % 3 as string)")
    number = F.when(F.col("turn") % 3 == 0, whole).otherwise(F.concat(whole, F.lit("."), part))
    return C.nearby_sections(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), number.alias("number")))


# --- text and coverage -----------------------------------------------------------------------


@query(r"""WITH t AS (SELECT conv_id AS doc_id, turn, regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), lambda x: NOT regexp_matches(trim(x), '^[0-9]{1,3}$')), chr(10)), '^\n+|\n+$', '', 'g') AS t FROM conversations)
  SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY turn, t)) AS body_md5, count(*) AS n_pages FROM t WHERE t <> '' GROUP BY doc_id""")
def document_bodies(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    bodies, offsets = O.build_body(pages)
    return bodies.select("doc_id", F.md5("body").alias("body_md5")).join(offsets.groupBy("doc_id").agg(F.count("*").alias("n_pages")), "doc_id")


@query(r"""WITH d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE length(text) >= 300), g AS (SELECT doc_id, t, 0 AS a, 10 AS z FROM d UNION ALL SELECT doc_id, t, 90, 200 FROM d UNION ALL SELECT doc_id, t, 260, n FROM d),
  x AS (SELECT doc_id, a, z, substring(t, a + 1, z - a) AS s FROM g), y AS (SELECT doc_id, a + length(s) - length(regexp_replace(s, '^[ \t\n\r\f\v]+', '')) AS "start", z - length(s) + length(regexp_replace(s, '[ \t\n\r\f\v]+$', '')) AS "end" FROM x)
  SELECT doc_id, "start"::INTEGER AS "start", "end"::INTEGER AS "end" FROM y WHERE "start" < "end" """)
def coverage_gaps(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text").filter(F.length("text") >= 300)
    quoted = F.expr("inline(array(struct(10 as start, 50 as end), struct(40 as start, 90 as end), struct(200 as start, 260 as end)))")
    return S.gaps(S.merged(texts.select("doc_id", quoted), "doc_id"), texts, "doc_id").select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


# --- dedup assembly and the baseline's parts -----------------------------------------------------


@query(r"""WITH d AS (SELECT doc_id, lang, source, text, sha1(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS f FROM documents WHERE text IS NOT NULL), g AS (SELECT *, min(doc_id) OVER (PARTITION BY f) AS group_id FROM d)
  SELECT group_id, arg_min(doc_id, (-length(text), doc_id)) AS node_id, count(*) AS group_size, count(DISTINCT source) > 1 AS cross_document, count(DISTINCT lang) > 1 AS cross_type FROM g GROUP BY group_id""")
def dedup_assembly(spark, sf):
    rows = table(spark, sf, "documents").filter("text is not null")
    nodes = rows.select(F.col("doc_id").alias("node_id"), F.col("lang").alias("node_type"), F.col("source").alias("doc_id"), F.col("text").alias("node_text"))
    marked = nodes.select("node_id", T.fingerprint(F.col("node_text")).alias("f"))
    groups = marked.join(marked.groupBy("f").agg(F.min("node_id").alias("group_id")), "f").select("node_id", "group_id")
    return D.representatives(nodes, groups, ["node_id"]).select("group_id", "node_id", F.col("group_size"), "cross_document", "cross_type")


@query("""WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
  SELECT src, dst, c AS weight FROM p WHERE c >= 0.4 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY c DESC, src) <= 5""")
def synonym_edges(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return P.nearest(e, e, 5, None, least=0.4).withColumnRenamed("cosine", "weight")


@query(WITH + " SELECT rank, round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS score FROM pairs")
def fact_scores(spark, sf):
    return R.fact_scores(graph(spark, sf).pairs.select("rank", F.col("cosine").alias("score"))).withColumn("score", F.round("score", 6))


@query("WITH " + _KG + ", one AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM g), n AS (SELECT a AS node FROM one UNION ALL SELECT b FROM one WHERE a <> b) SELECT node, count(*) AS degree FROM n GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def kg_top_degrees(spark, sf):
    one = _kg(spark, sf).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ends = one.select(F.explode(F.expr("if(a = b, array(a), array(a, b))")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(10)
