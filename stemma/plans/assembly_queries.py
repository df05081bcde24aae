"""Registered queries over a growing graph, cycles, quotes, headings, references and the response cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import spans as S
from stemma.functions import text as T
from stemma.operators import claims as C
from stemma.operators import dedup as D
from stemma.operators import documents as O
from stemma.operators import funnel as P
from stemma.operators.scoring import score_graph
from stemma.plans.graph import TOTAL, WITH, graph
from stemma.plans.queries import _mentions, query
from stemma.sources import io
from stemma.storage import spread, table

# --- a second document arrives, contradictions, cycles -------------------------------------------


def _arriving() -> str:
    sql, parts = "", []
    for name, channel, src, dst, per, budget in (("td", "top_down", "data", "question", 50, 550), ("da", "data_to_argument", "data", "argument", None, 300), ("aq", "argument_to_question", "argument", "question", None, 150)):
        for fresh in ("s", "d"):
            met = f"SELECT s.node_id AS src, d.node_id AS dst, round(list_cosine_similarity(s.e, d.e), 6) AS c FROM nodes s JOIN nodes d ON s.layer = '{src}' AND d.layer = '{dst}' AND {fresh}.document = 1"
            met = f"SELECT src, dst, c FROM ({met} QUALIFY row_number() OVER (PARTITION BY d.node_id ORDER BY c DESC, s.node_id) <= {per})" if per else met
            sql += f", new_{name}_{fresh} AS ({met} ORDER BY c DESC, src, dst LIMIT {budget})"
            parts.append(f"SELECT src, dst, '{channel}' AS channel, c FROM new_{name}_{fresh}")
    return sql + ", arrived AS (" + " UNION ".join(parts) + ")"


@query(WITH + """, prior AS (SELECT p.src, p.dst, channel, c, rank FROM pairs p JOIN nodes a ON a.node_id = p.src JOIN nodes b ON b.node_id = p.dst WHERE a.document = 0 AND b.document = 0)""" + _arriving() + f"""
  SELECT src, dst, channel, c AS cosine, rank FROM prior UNION ALL
  SELECT src, dst, channel, c, ((SELECT count(*) FROM prior) + row_number() OVER (ORDER BY c DESC, src, dst))::INTEGER AS rank FROM (SELECT * FROM arrived ANTI JOIN prior USING (src, dst) ORDER BY c DESC, src, dst LIMIT {TOTAL})""")
def incremental_pairs(spark, sf):
    g = graph(spark, sf)
    fresh, old = g.nodes.filter("document = 1").select("node_id"), g.nodes.filter("document = 0").select("node_id")
    prior = g.pairs.join(old.withColumnRenamed("node_id", "src"), "src", "left_semi").join(old.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return P.funnel(g.nodes.select("node_id", "layer", "vector"), TOTAL, new_ids=fresh, prior=prior).select("src", "dst", "channel", "cosine", "rank")


_WITHIN = "SELECT a.node_id AS src, b.node_id AS dst, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM nodes a JOIN nodes b ON a.node_id < b.node_id AND a.layer = '{0}' AND b.layer = '{0}' ORDER BY c DESC, src, dst LIMIT 200"


@query(WITH + f", wd AS ({_WITHIN.format('data')}), wa AS ({_WITHIN.format('argument')}) SELECT src, dst, c AS cosine, ((src * 5 + dst * 11) % 100)::DOUBLE / 100 AS confidence FROM (SELECT * FROM wd UNION ALL SELECT * FROM wa) ORDER BY confidence DESC, src, dst LIMIT 50")
def contradiction_channel(spark, sf):
    contra = ((F.col("src") * 5 + F.col("dst") * 11) % 100).cast("double") / 100  # stands in for a model's scores
    return P.contradictions(graph(spark, sf).nodes, contra, 400, P.budgets(TOTAL, nli=True)["contradiction"]).select("src", "dst", "cosine", "confidence")


@query()
def score_graph_cyclic(spark, sf):
    """The graph with each card's answer by its target, so that most nodes lie on cycles."""
    g = graph(spark, sf)
    back = g.cards.select((-F.col("card_id")).alias("card_id"), F.lit("CA").alias("kind"), F.lit(0.35).alias("weight"), F.array("target").alias("premises"), F.col("premises")[0].alias("target"), "active")
    scores = score_graph(g.nodes.select("node_id"), g.cards.unionByName(back))
    return scores.select("node_id", *(F.round(c, 6).alias(c) for c in ("strength", "va", "vs")))


# --- quotes and headings ---------------------------------------------------------------------------


@query("""WITH n AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS doc, l_returnflag || ' ' || l_linestatus AS t, l_linenumber % 2 AS q, l_partkey % 100 AS s, l_partkey % 100 + l_quantity::INTEGER AS e FROM lineitem)
  SELECT a.id AS a, b.id AS b, count(*) AS n FROM n a JOIN n b ON a.doc = b.doc AND a.id < b.id AND a.s < b.e AND b.s < a.e AND a.t = b.t AND a.q = b.q GROUP BY ALL""")
def span_overlap_pairs(spark, sf):
    at = F.col("l_partkey") % 100
    nodes = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"), F.col("l_orderkey").alias("doc_id"), F.lit("0").alias("chunk_id"), F.array(at, at + F.col("l_quantity").cast("int")).alias("span"),
                                                F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("node_text"), (F.col("l_linenumber") % 2).cast("string").alias("quote"))
    return D.tier1_pairs(nodes, 1.0).groupBy("a", "b").agg(F.count("*").alias("n"))


@query()
def locate_quotes(spark, sf):
    """Each document's first sentence without its third word, sought in the whole document."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    words = F.split(F.try_element_at(T.sentences(F.col("text")), F.lit(1)), " ")
    quoted = docs.withColumn("needle", F.array_join(F.filter(words, lambda w, i: i != 2), " "))
    return S.locate(quoted).select("doc_id", "start", "end", "score", "tier")


@query()
def location_tiers(spark, sf):
    return locate_quotes(spark, sf).groupBy("tier").agg(F.count("*").alias("n"))


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("int").alias("page"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("number"))


@query("""WITH l AS (SELECT p_brand AS doc_id, p_size::VARCHAR AS number, p_name AS title, p_partkey::INTEGER AS toc_page FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1)
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY toc_page))::INTEGER AS ord FROM l""")
def contents_table(spark, sf):
    return O.parse_toc(_parts(spark, sf).select("doc_id", "page", F.format_string("%s  %s ..... %d\nno line of contents", "number", "name", "page").alias("text")))


@query("""WITH l AS (SELECT p_brand AS doc_id, p_size::VARCHAR AS number, p_name AS title, p_partkey, p_size || ' ' || p_name || chr(10) || 'Retail price and type follow.' AS body FROM part),
  p AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0, sum(length(body) + 1) OVER (PARTITION BY doc_id) - 1 AS n FROM l),
  f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY p_partkey) = 1)
  SELECT doc_id, number, title, (p0 + length(number) + 1 + length(title) + 1)::INTEGER AS "start", coalesce(lead(p0) OVER (PARTITION BY doc_id ORDER BY p_partkey), n)::INTEGER AS "end" FROM f""")
def heading_locations(spark, sf):
    pages = _parts(spark, sf).select("doc_id", "page", F.concat("number", F.lit(" "), "name", F.lit("\nRetail price and type follow.")).alias("text"))
    bodies, _ = O.build_body(pages)
    return O.locate_headings(bodies, contents_table(spark, sf)).select("doc_id", "number", "title", "start", "end")


# --- references -------------------------------------------------------------------------------------

_POOL = r"""WITH m AS (SELECT conv_id AS doc, turn AS s, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS x FROM conversations), n AS (SELECT DISTINCT doc, s, lower(x) AS e FROM m),
  l AS (SELECT p.conv_id AS doc, p.turn AS sentence, n.e, max(n.s) AS last FROM conversations p JOIN n ON n.doc = p.conv_id AND n.s <= p.turn WHERE p.turn > 0 GROUP BY ALL),
  k AS (SELECT doc, sentence, e AS entity_key, row_number() OVER (PARTITION BY doc, sentence ORDER BY round(2.0::DOUBLE / (1 + sentence - last), 6) DESC, e) AS rank, count(*) OVER (PARTITION BY doc, sentence) AS pool FROM l WHERE last < sentence),
  pick AS (SELECT doc, sentence, max(entity_key) AS entity_key FROM k GROUP BY ALL)"""


def _pool(spark, sf):
    named = _mentions(spark, sf).select("doc", "section", "sentence", "mention", F.lower("text").alias("entity_key"))
    turns = table(spark, sf, "conversations").filter("turn > 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("sentence"), F.lit(1).alias("section"), F.lit(-1).alias("mention")).distinct()
    ranked = C.antecedents(turns, named, (1 << 31) - 1)
    return ranked, ranked.groupBy("doc", "sentence").agg(F.max("entity_key").alias("entity_key"))  # the pick stands in for a model's


@query(_POOL + " SELECT doc, sentence, entity_key, least(CASE WHEN rank <= 5 THEN 5 WHEN rank <= 20 THEN 20 ELSE pool END, pool)::BIGINT AS shown, CASE WHEN rank <= 5 THEN 1 WHEN rank <= 20 THEN 2 ELSE 3 END AS calls FROM k JOIN pick USING (doc, sentence, entity_key)")
def escalation_tiers(spark, sf):
    return C.escalation(*_pool(spark, sf), ["doc", "sentence"])


@query(r"""WITH m AS (SELECT conv_id AS doc, turn AS sentence, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS x, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]+'), 1) - 1 AS mention FROM conversations)
  SELECT doc, sentence, string_agg(mention || ':' || x || '=' || lower(x), '|' ORDER BY mention, x) AS payload FROM m GROUP BY ALL""")
def decontextualised(spark, sf):
    picks = _mentions(spark, sf).select("doc", "sentence", "mention", F.col("text").alias("surface"), F.lower("text").alias("entity_key"))
    shown = F.array_join(F.transform("payload", lambda x: F.concat(x["mention"].cast("string"), F.lit(":"), x["surface"], F.lit("="), x["entity_key"])), "|")
    return C.substitutions(picks, ["doc", "sentence"]).select("doc", "sentence", shown.alias("payload"))


@query("""WITH t AS (SELECT p_brand AS doc, p_partkey, p_partkey % 60 + 1 AS number FROM part) SELECT t.doc, p_partkey, number::VARCHAR AS number FROM t WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_brand = t.doc AND p.p_size = t.number)""")
def internal_refs(spark, sf):
    texts = table(spark, sf, "part").select(F.col("p_brand").alias("doc"), "p_partkey", F.format_string("as Section %d shows", F.col("p_partkey") % 60 + 1).alias("text"))
    sections = _parts(spark, sf).select(F.col("doc_id").alias("doc"), "number")
    return C.internal_refs(texts, sections, r"(?i)section\s+([0-9]+(?:\.[0-9]+)*)").select("doc", "p_partkey", "number")


# --- sources and the cache -----------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), c AS (SELECT h, min(l.quality) AS response FROM r JOIN labels l USING (doc_id) GROUP BY h)
  SELECT doc_id, c.response, c.h IS NOT NULL AS hit FROM r LEFT JOIN c USING (h)""")
def response_cache(spark, sf):
    asked = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    cache = asked.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").groupBy("h").agg(F.min("quality").alias("response"))
    hits, misses = io.cache_split(asked, cache, ["h"])
    return hits.select("doc_id", "response", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(None).cast("bigint").alias("response"), F.lit(False).alias("hit")))


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents) WHERE spent < 100000")
def token_budget(spark, sf):
    return io.budgeted(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100_000).select("doc_id")


@query("""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM s)
  SELECT p_partkey, CASE WHEN n > 1 THEN s || '-' || n ELSE s END AS doc_slug FROM n""")
def document_slugs(spark, sf):
    return io.slugs(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "doc_slug")


@query()
def duplicate_chunks(spark, sf):
    """How many chunks repeat another one's id."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return O.chunks(docs).agg(F.count("*").alias("n_chunks"), (F.count("*") - F.count_distinct("chunk_id")).alias("n_repeated"))


@query("""SELECT doc_id, CASE source_type WHEN 'hypothesis' THEN CASE WHEN kept THEN 'hypothesis' ELSE 'claim' END WHEN 'analysis' THEN 'claim' WHEN 'limitation' THEN 'rebuttal' ELSE 'evidence' END AS type
  FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hypothesis' WHEN 1 THEN 'analysis' WHEN 2 THEN 'limitation' ELSE 'evidence' END AS source_type, doc_id % 8 = 0 AS kept FROM documents)""")
def converted_types(spark, sf):
    n = F.col("doc_id") % 4
    kind = F.when(n == 0, "hypothesis").when(n == 1, "analysis").when(n == 2, "limitation").otherwise("evidence")
    return table(spark, sf, "documents").select("doc_id", C.convert_type(kind, F.col("doc_id") % 8 == 0).alias("type"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 8")
def top_sources(spark, sf):
    return table(spark, sf, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)
