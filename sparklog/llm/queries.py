"""The queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hpyp, license_scan, packing, quality, secret_scan, simhash, token_output, url_filter, vector_dedup
from .shared import doc_hash, modest_batches, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages.select("page_id", "url"), RULES, url_filter.html_links(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "via")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = F.transform("base_places", lambda p: p["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), "base_labels", "labels", F.round("score", 6).alias("score"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    token_output.write(_table(spark, sf_dir, "documents"), path, tokenizer(), 2)
    return token_output.digest(spark, path)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(doc_hash(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it contains, near enough."""
    found = decontaminate.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    one = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    return one.withColumn("similarity", F.round(1 - F.col("distance") / F.col("item_words"), 6)).drop("item_words")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(_table(spark, sf_dir, "documents"), tokenizer(), 1)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_hash(F.col("doc_id")) % 10 == 0
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("learn"))
    return hpyp.score(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_license_scan, op3_token_output, op4_vector_dedup, op5_quality, op6_simhash, op7_decontaminate, op8_packing, op9_secret_scan, op10_lm_score)}
#: op2: every template at every word. op1: host, path, rule and verdict with classes of aliases reached over canonical links and
#: redirects. op4: all pairs.
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle(),
    "op1_url_filter": r"""
WITH RECURSIVE rules(action, host, path) AS (VALUES ('block','net','/'),('allow','example.net','/en/'),('block','example.com','/de/'),('allow','org','/fr/')),
p AS (SELECT page_id, url, html, CASE WHEN instr(url,'://')>0 THEN substr(url, instr(url,'://')+3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, url, html, translate(regexp_extract(rest,'^[^/?#]*'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest,'^[^/?#]*([^?#]*)',1) AS path,
  CASE WHEN instr(url,'://')>0 THEN translate(split_part(url,'://',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') END AS scheme, regexp_extract(rest,'^[^/?#]*([^#]*)',1) AS tail FROM p),
raw AS (SELECT page_id, scheme, host, unnest(list_concat(
  list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*(?:["''][^"''>]*\bcanonical\b|canonical\b)')), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
  list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?is)\bcontent\s*=\s*["''][^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1)))) AS t FROM u WHERE scheme IS NOT NULL),
dec AS (SELECT page_id, replace(t, '&amp;', '&') AS t FROM raw),
rel AS (SELECT page_id, t, CASE WHEN path='' THEN '/' ELSE path END AS own, regexp_replace(regexp_replace(CASE WHEN path='' THEN '/' ELSE path END, '[^/]*$', '')||regexp_extract(t,'^[^?#]*'), '(/\.{1,2})$', '\1/') AS j FROM dec JOIN u USING (page_id)),
ft AS (SELECT u.scheme||'://'||u.host||u.tail AS a, CASE WHEN instr(t,'://')>0 THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN t LIKE '//%' THEN u.scheme||':'||t WHEN t LIKE '/%' THEN u.scheme||'://'||u.host||t
  WHEN t LIKE '?%' THEN u.scheme||'://'||u.host||own||t WHEN t NOT LIKE '#%' THEN u.scheme||'://'||u.host||array_to_string(list_reduce(list_transform(string_split(j,'/'), lambda x: [x]), lambda a, x: CASE WHEN x[1]='..' THEN a[1:greatest(len(a)-1,1)] WHEN x[1]='.' THEN a ELSE list_concat(a, x) END),'/')||regexp_extract(t,'^[^?#]*(.*)',1) END AS t FROM rel JOIN u USING (page_id)),
fr AS (SELECT a, t, substr(t, instr(t,'://')+3) AS rest FROM ft WHERE instr(t,'://')>0),
e AS (SELECT a, translate(split_part(t,'://',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')||'://'||translate(regexp_extract(rest,'^[^/?#]*'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')||regexp_extract(rest,'^[^/?#]*([^#]*)',1) AS b FROM fr),
s AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
n AS (SELECT DISTINCT b AS node, regexp_extract(split_part(b,'://',2),'^[^/?#]*') AS host, regexp_extract(split_part(b,'://',2),'^[^/?#]*([^?#]*)',1) AS path FROM reach),
na AS (SELECT node, arg_max(action, length(r.host||r.path)) AS action FROM n JOIN rules r ON (n.host=r.host OR n.host LIKE '%.'||r.host) AND starts_with(n.path, r.path) GROUP BY node),
cls AS (SELECT reach.a AS node, CASE WHEN bool_or(action='allow') THEN 'allow' WHEN bool_or(action='block') THEN 'block' END AS said FROM reach JOIN na ON na.node=reach.b GROUP BY reach.a),
own AS (SELECT page_id, arg_max(r.host||r.path, length(r.host||r.path)) AS rule, arg_max(action, length(r.host||r.path)) AS action FROM u JOIN rules r ON (u.host=r.host OR u.host LIKE '%.'||r.host) AND starts_with(u.path, r.path) GROUP BY page_id)
SELECT u.page_id, coalesce(u.host,'') AS host, coalesce(u.path,'') AS path, own.rule, coalesce(own.action, cls.said, 'allow') AS verdict,
  CASE WHEN own.action IS NOT NULL THEN 'rule' WHEN cls.said IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM u LEFT JOIN own USING (page_id) LEFT JOIN cls ON cls.node = u.scheme||'://'||u.host||u.tail""",
    "op4_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding)=len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) AND len(list_filter(embedding, lambda y: y<>0))>0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label=b.label AND a.vec_id<>b.vec_id AND len(a.x)=len(b.x) AND list_cosine_similarity(a.x,b.x)>=0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b=l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n,0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.a=e.vec_id LEFT JOIN n ON n.a=e.vec_id""",
}
