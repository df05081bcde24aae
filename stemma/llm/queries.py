"""The operators over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import chat, decontaminate, licenses, packing, pivots, shards, simhash, suffix, toxicity, urls
from stemma.storage import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Each document's place in a tree: a project per source, modules in it; one file in 97 is its directory's licence file.
_PATH = "concat(source, '/p', doc_id % 13, '/m', doc_id % 3, if(doc_id % 97 = 0, '/LICENSE', concat('/', doc_id, '.txt')))"

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_tree(docs.select("doc_id", F.expr(_PATH).alias("path"), "text"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.with_next_answers(table(spark, sf_dir, "conversations")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 24)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_top_k, op3_suffix_dedup, op4_best_fit_packing, op5_url_filter, op6_preference_format, op7_decontamination, op8_simhash, op9_toxicity, op10_sharding)}


def _license_sql() -> str:
    values = ", ".join(f"({i}, '{n}', '{t}', {k})" for i, (n, c) in enumerate(licenses.template_terms()) for t, k in sorted(c.items()))
    return f"""
WITH tpl(tpl, license, t, k) AS (VALUES {values}),
docs AS (SELECT doc_id, source || '/p' || doc_id % 13 || '/m' || doc_id % 3 || CASE WHEN doc_id % 97 = 0 THEN '/LICENSE' ELSE '/' || doc_id || '.txt' END AS path,
  lower(coalesce(text, '')) AS low FROM documents),
seen AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS t FROM docs) WHERE t IN (SELECT t FROM tpl) GROUP BY t),
n AS (SELECT count(*) AS n FROM docs),
idf AS (SELECT t.t, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT t FROM tpl) t CROSS JOIN n LEFT JOIN seen USING (t)),
tv AS (SELECT tpl, license, t, (1 + ln(k)) * idf AS w FROM tpl JOIN idf USING (t)),
tn AS (SELECT tpl, sqrt(sum(w * w)) AS norm FROM tv GROUP BY tpl),
lines AS (SELECT doc_id, string_split(low, chr(10)) AS l FROM docs),
runs AS (SELECT unnest(range({licenses.RUN})) AS w),
units AS (SELECT DISTINCT doc_id, false AS whole, unnest(list_transform(range(1, len(l) - w + 1), lambda i: array_to_string(l[i:i + w], chr(10)))) AS low FROM lines, runs UNION SELECT doc_id, true, low FROM docs),
terms AS (SELECT doc_id, whole, low, t, count(*) AS k FROM (SELECT doc_id, whole, low, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS t FROM units) GROUP BY ALL),
uv AS (SELECT doc_id, whole, low, t, (1 + ln(k)) * coalesce(idf, ln((1 + n)::DOUBLE / 2) + 1) AS w FROM terms CROSS JOIN n LEFT JOIN idf USING (t)),
un AS (SELECT doc_id, whole, low, sqrt(sum(w * w)) AS norm FROM uv GROUP BY ALL),
cos AS (SELECT u.doc_id, u.whole, tv.license, round(sum(u.w * tv.w) / (any_value(un.norm) * any_value(tn.norm)), 6) AS score
  FROM uv u JOIN tv USING (t) JOIN un ON un.doc_id = u.doc_id AND un.whole = u.whole AND un.low = u.low JOIN tn ON tn.tpl = tv.tpl GROUP BY u.doc_id, u.whole, u.low, tv.tpl, tv.license),
own AS (SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score, bool_or(whole) AS whole FROM cos WHERE score >= {licenses.THRESHOLD} GROUP BY doc_id),
files AS (SELECT d.doc_id, d.path, regexp_replace(d.path, '/[^/]*$', '') AS dir, o.license, o.score, coalesce(o.whole, false) OR d.path LIKE '%/LICENSE' AS lic FROM docs d LEFT JOIN own o USING (doc_id)),
given AS (SELECT dir, min(license) AS given FROM files WHERE lic AND license IS NOT NULL GROUP BY dir),
near AS (SELECT f.dir, arg_max(g.given, length(g.dir)) AS inherited, arg_max(g.dir, length(g.dir)) AS up FROM (SELECT DISTINCT dir FROM files) f JOIN given g ON f.dir = g.dir OR starts_with(f.dir, g.dir || '/') GROUP BY f.dir)
SELECT f.doc_id, f.path, f.license, f.score, coalesce(f.license, n.inherited) AS effective, CASE WHEN f.license IS NULL THEN n.up END AS from_directory FROM files f LEFT JOIN near n USING (dir)"""


_TOP_K_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY own, query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_URL_SQL = """
WITH r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.page_id, u.host, u.path, r.h, r.p, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR suffix(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""

_CHAT_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
l AS (SELECT conv_id, max(i) AS last, arg_max(text, i) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
two AS (SELECT t.conv_id, t.i, t.n, t.role, t.text AS ct, CASE WHEN t.i = l.last THEN coalesce(o.answer, '') ELSE t.text END AS rt FROM t LEFT JOIN l USING (conv_id) LEFT JOIN l o ON o.conv_id = t.conv_id + 1),
k AS (SELECT conv_id, coalesce(min(CASE WHEN ct IS DISTINCT FROM rt THEN i END) - 1, max(n)) AS k FROM two GROUP BY conv_id),
x AS (SELECT two.*, k.k, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(ct, '') || chr(10) AS c, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(rt, '') || chr(10) AS r FROM two JOIN k USING (conv_id)),
y AS (SELECT *, coalesce(sum(CASE WHEN i > k THEN length(c) END) OVER w, 0) AS ca, coalesce(sum(CASE WHEN i > k THEN length(r) END) OVER w, 0) AS ra FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, any_value(k)::BIGINT AS n_common, coalesce(string_agg(CASE WHEN i <= k THEN c END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN i > k THEN c END, '' ORDER BY i), '') AS chosen, coalesce(string_agg(CASE WHEN i > k THEN r END, '' ORDER BY i), '') AS rejected,
  coalesce(string_agg(CASE WHEN i > k AND role = 'assistant' THEN (ca + 14)::BIGINT || '-' || (ca + length(c) - 1)::BIGINT END, ';' ORDER BY i), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN i > k AND role = 'assistant' THEN (ra + 14)::BIGINT || '-' || (ra + length(r) - 1)::BIGINT END, ';' ORDER BY i), '') AS rejected_mask
FROM y GROUP BY conv_id"""

ORACLES = {"op1_license_scan": _license_sql(), "op2_top_k": _TOP_K_SQL, "op5_url_filter": _URL_SQL, "op6_preference_format": _CHAT_SQL}
