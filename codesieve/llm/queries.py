"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_trie, decontaminate, hard_negatives, html_extract, huffman, lm, near_dedup, packing, secret_scan, token_counts, topk, toxicity, warc
from .shared import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read(*huffman.write(table(spark, sf_dir, "documents")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.rolled_up(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back; ``error`` is null where a record keeps the format and its digests."""
    return warc.pages_of(warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; of every seventh the label moves on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_language_model, op4_token_ids, op5_secret_scan, op6_near_dedup, op7_html, op8_packing, op9_top_k, op10_token_counts, op11_warc, op12_hard_negatives, op13_conversation_trie)}


def _secret_sql() -> str:
    """Spans of all rules by splitting at the matches; positions are sums of lengths."""
    found = []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        group = f"regexp_extract_all(text, '{p}', {r.group})"
        found.append(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{p}', 0) AS m, {group} AS g, string_split_regex(text, '{p}') AS gaps FROM t WHERE regexp_matches(text, '{p}')")
    n = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)::BIGINT"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(found)}),
      e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
      p AS (SELECT doc_id, k, kind, {n.format('gaps[1:i]')} + CASE WHEN i > 1 THEN {n.format('m[1:i - 1]')} ELSE 0 END AS a, length(m[i]) AS n FROM e WHERE length(g[i]) >= least),
      s AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < {secret_scan.BASE}), '') AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM p GROUP BY doc_id)
      SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (doc_id)"""


_TOP_K_SQL = """WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""


_WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
  d AS (SELECT *, sha1(html) AS h FROM p), l AS (SELECT h, max(page_id) AS leader FROM d WHERE n >= 1000 GROUP BY h)
  SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN leader <> page_id THEN leader END AS refers_to, url, NULL::VARCHAR AS error
  FROM d LEFT JOIN l ON l.h = d.h"""

_NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
  n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
  SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

#: CRC-32 goes bit by bit. A node's totals are sums over its members: each conversation brings what it is the smallest member of, from a depth downward.
_TRIE_SQL = r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS w FROM conversations WHERE conv_id IS NOT NULL),
  i AS (SELECT DISTINCT conv_id FROM t),
  y AS (SELECT conv_id, p, ascii(substr(conv_id::VARCHAR, p, 1))::BIGINT AS v, length(conv_id::VARCHAR) AS n FROM (SELECT conv_id, unnest(range(1, length(conv_id::VARCHAR) + 1)) AS p FROM i)),
  z AS (SELECT conv_id, 0::BIGINT AS k, 4294967295::BIGINT AS x FROM i UNION ALL SELECT conv_id, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
    FROM (SELECT z.conv_id, z.k, CASE WHEN z.k % 8 = 0 THEN xor(z.x, y.v) ELSE z.x END AS x FROM z JOIN y ON y.conv_id = z.conv_id AND y.p = z.k // 8 + 1)),
  k AS (SELECT conv_id, conv_id - conv_id % 20 AS base, (4294967295 - x) % 4 AS h FROM z WHERE k = 8 * length(conv_id::VARCHAR)),
  b AS (SELECT k.conv_id, t.d, t.h, t.w, 0 AS part FROM k JOIN t ON t.conv_id = k.base AND t.d <= k.h UNION ALL SELECT k.conv_id, t.d, t.h, t.w, 1 FROM k JOIN t ON t.conv_id = k.conv_id AND t.d > k.h),
  r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, d) AS depth, h, w FROM b),
  q AS (SELECT conv_id, depth, w, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
  g AS (SELECT path, depth, any_value(w) AS w, min(conv_id) AS least, count(*) AS n FROM q GROUP BY path, depth),
  l AS (SELECT conv_id, max(depth) AS last FROM q GROUP BY conv_id),
  u AS (SELECT q.conv_id, q.depth, q.path, g.least, g.w * (g.n - 1) AS own, q.depth = l.last AS ends FROM q JOIN g USING (path, depth) JOIN l ON l.conv_id = q.conv_id),
  kids AS (SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS kids FROM g WHERE depth > 0 GROUP BY 1),
  f AS (SELECT u.*, CASE WHEN least = u.conv_id THEN own ELSE 0 END AS mine, CASE WHEN ends AND least = u.conv_id AND kids IS NULL THEN 1 ELSE 0 END AS leaf FROM u LEFT JOIN kids ON kids.path = u.path),
  s AS (SELECT *, sum(mine) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS below, sum(leaf) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS leaves FROM f)
  SELECT s.least AS conv_id, s.depth::BIGINT AS depth, max(up.least) AS parent_conv_id, count(*)::BIGINT AS n_convs, coalesce(max(kids), 0)::BIGINT AS n_children, sum(leaves)::BIGINT AS n_leaves, sum(below)::BIGINT AS saved_tokens,
    sha256(coalesce(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) FILTER (s.ends), '')) AS ends_sha256
  FROM s LEFT JOIN kids ON kids.path = s.path LEFT JOIN g up ON s.depth > 0 AND up.depth = s.depth - 1 AND up.path = substr(s.path, 1, length(s.path) - 32) GROUP BY s.path, s.least, s.depth"""


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scan": _secret_sql(), "op9_top_k": _TOP_K_SQL, "op11_warc": _WARC_SQL, "op12_hard_negatives": _NEGATIVES_SQL, "op13_conversation_trie": _TRIE_SQL}
