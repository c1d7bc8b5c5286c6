"""Queries of the training-data operators, as ``__spark_entry__`` registers them, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspan.llm import bpe, decontam, langid, lexical, licenses, media, ngram_join, quality, sst, toxicity, trie, url_filter, warc
from roadspan.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path(spark))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from documents that aren't held out."""
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op9_sst_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    return sst.digests(sst.store(table(spark, sf_dir, "documents"), sst.default_path(spark)))


@query
def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a grey image in tar shards: sizes, digests and features as read back."""
    return media.media_columns(table(spark, sf_dir, "documents"))


@query
def op2_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives."""
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


def _base32(hexadecimal: str) -> str:
    """SQL for the base-32 spelling of 40 hexadecimal digits: five digits give four characters."""
    five = "CAST('0x' || substr({x}, {at}, 5) AS BIGINT)"
    chars = (f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({five.format(x=hexadecimal, at=5 * i + 1)} >> {s}) & 31) + 1 AS BIGINT), 1)" for i in range(8) for s in (15, 10, 5, 0))
    return " || ".join(chars)


ORACLE_SQL["op2_warc_chunked_records"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
f AS (SELECT x, n, min(page_id) AS first FROM h GROUP BY x, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_base32("x")} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (x, n)
"""

#: The rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE_SQL["op4_url_filters"] = f"""
WITH r(v, h, p) AS (VALUES {", ".join(map(str, URL_RULES))}),
n AS MATERIALIZED (SELECT row_number() OVER () AS i, page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM n
  JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM n LEFT JOIN m USING (i)
"""


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels that aren't held out."""
    found = toxicity.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, coverage of every document."""
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the file ``source/lang/doc_id.txt``: licence, origin, score and the file that it comes from."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    return licenses.scan(files, spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")).drop("text")


ORACLE_SQL["op6_license_scan"] = licenses.oracle("SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents")


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels that aren't held out."""
    found = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 50 documents that score highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL["op13_ranked_search"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT i, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
q AS MATERIALIZED (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
p AS MATERIALIZED (SELECT i, t, count(*) AS tf FROM (SELECT i, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY i, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY t, docs),
s AS (SELECT item_id, i, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN n USING (i), g GROUP BY item_id, i)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM s JOIN n USING (i) WHERE score > 0 QUALIFY rank <= 50
"""


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal id: a table of 256 entries made by its rule, then one step a digit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
ORACLE_SQL["op12_conversation_trie"] = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {_CRC} % 6 AS h FROM t, tab),
c AS MATERIALIZED (SELECT h.conv_id, coalesce(b.own[1:h.h], []) || h.own[h.h + 1:] AS s FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS MATERIALIZED (SELECT conv_id, len(s) AS n, d AS depth, sha256(s[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(s[1:d - 1]::VARCHAR) END AS up, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS chars
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM c)),
g AS MATERIALIZED (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY depth, node),
k AS MATERIALIZED (SELECT g.*, (SELECT count(*) FROM g x WHERE x.depth = g.depth + 1 AND x.up = g.node) AS kids FROM g),
-- a node's chain upwards is that of its smallest member
a AS (SELECT k.depth, k.node, x.depth AS top_depth, x.node AS top, k.kids, (k.n - 1) * k.chars AS saved FROM k JOIN m x ON x.conv_id = k.conv_id AND x.depth <= k.depth),
r AS (SELECT top_depth AS depth, top AS node, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM a GROUP BY ALL)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n AS n_convs, k.kids AS n_children, r.leaves AS n_leaves, r.saved::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN r USING (depth, node) LEFT JOIN k p ON p.depth = k.depth - 1 AND p.node = k.up
"""
