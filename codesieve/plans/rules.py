"""Rule predicates over the driver's tables, and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M, rules as O, similar_trees as S
from . import read


def doc_examples(spark, d):
    """Conversations as docs: system turns become headings, every seventh turn a fence."""
    c = read(spark, d, "conversations")
    text = F.concat(F.when(F.col("role") == "system", "## Examples:\n").when(F.col("turn") % 7 == 3, "  ```rust\n").otherwise(""), F.col("text"))
    return c.select("conv_id", "turn", X.example_violation(text).alias("violation")).filter("violation is not null")


def long_modules(spark, d):
    m = read(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"), (F.col("lang") == "de").alias("from_expansion"))
    return O.long_modules(m, 40).select("doc_id", "n_lines")


def misordered_first(spark, d):
    """Events by user: the first purchase behind another event."""
    e = read(spark, d, "events")
    return O.misordered(e.select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase")


def call_sites(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("helper"), (F.col("event_id") % 500).cast("string")).alias("callee"), F.col("user_id").alias("test"), F.unix_timestamp("ts").alias("lo"), (F.unix_timestamp("ts") + 1).alias("hi"), F.col("event_id").alias("id"))
    return O.call_sites(e, 3, 3).select("callee", "n_calls", "n_tests", F.col("first.lo").alias("first_lo"), F.col("first.id").alias("first_id"))


def listed_sites(spark, d):
    """Each helper's sites in source order; users are tests, minutes positions, so that locations repeat."""
    e = read(spark, d, "events").select(F.concat(F.lit("helper"), (F.col("event_id") % 40).cast("string")).alias("callee"), F.col("user_id").cast("string").alias("test"), F.floor(F.unix_timestamp("ts") / 3600).alias("lo"), (F.floor(F.unix_timestamp("ts") / 3600) + 1).alias("hi"), (F.col("user_id") % 3).alias("id"), F.col("event_type").alias("shape"))
    return O.listed_sites(e)


def exclusions(spark, d):
    """Pages whose host and path, read as segments, lie under none of the listed prefixes."""
    p = read(spark, d, "pages").select("page_id", F.replace(F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", ""), F.lit("/"), F.lit("::")).alias("path"))
    hosts = p.filter(F.col("page_id") % 5 == 0).select(F.regexp_extract("path", r"^([^:]+::[^:]+)", 1).alias("prefix")).filter("prefix <> ''").distinct()
    return O.excluded(p, hosts).select("page_id", "path")


def harness_semi(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"), F.year("o_orderdate").alias("lo"), F.month("o_orderdate").alias("hi"))
    return O.harness_functions(o, o.filter("id % 3 = 0"))


def install_rates(spark, d):
    e = read(spark, d, "events")
    mode = F.when(F.col("event_type").isin("view", "click"), "download").otherwise("build")
    runs = e.select((F.col("user_id") % 50).alias("host"), mode.alias("mode"), F.round(F.col("value") * 10).cast("bigint").alias("ms"))
    out = M.summary(M.rates(runs, ["host"]))
    return out.select("host", "installs", "downloads", "builds", "total_ms", F.round("download_rate", 6).alias("download_rate"), X.duration_text(F.col("total_ms")).alias("duration"))


def install_summaries(spark, d):
    """The line that sums up each host's runs."""
    e = read(spark, d, "events")
    runs = e.select((F.col("user_id") % 50).alias("host"), F.when(F.col("event_type").isin("view", "click"), "download").otherwise("build").alias("mode"), F.round(F.col("value") * 10).cast("bigint").alias("ms"))
    return M.summary(M.rates(runs, ["host"])).select("host", "summary")


def library_names(spark, d):
    p = read(spark, d, "part").select("p_partkey", X.library_parts(F.concat(F.lit("lib"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("@"), F.col("p_brand"), F.lit(".so"))).alias("x"))
    return p.filter("x is not null").select("p_partkey", "x.crate", "x.toolchain")


def std_fs_sites(spark, d):
    """Types of parts as labels: every third one names std::fs."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("crate"), F.concat(F.lit("app::m"), (F.col("p_size") % 7).cast("string"), F.lit("::f")).alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("std::fs::"), F.split_part("p_type", F.lit(" "), F.lit(1)))).otherwise(F.concat(F.lit("std::fsx::"), F.col("p_type"))).alias("label"), "p_partkey")
    crates = spark.createDataFrame([("Brand#11",), ("Brand#12",)], "crate string")
    paths = spark.createDataFrame([("app::m3",), ("app::m",), ("bad path",)], "prefix string")
    return O.std_fs_sites(p, crates, paths).select("p_partkey", "crate", "path", "label")


def branch_phrases(spark, d):
    l = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    locale = F.when(F.col("l_orderkey") % 3 == 0, "cy").when(F.col("l_orderkey") % 3 == 1, "gd-GB").otherwise("en-GB")
    return l.select("l_orderkey", X.branch_phrase(F.col("n"), locale).alias("phrase"))


def embedding_cosine(spark, d):
    """Pairs of the same label whose cosine reaches 0.35."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    found = S.vector_pairs(e, 0.35)
    return found.withColumn("cosine", F.round("cosine", 4))  # compared as it is, rounded to be shown


QUERIES = {f.__name__: f for f in (doc_examples, long_modules, misordered_first, call_sites, listed_sites, exclusions, harness_semi, install_rates, install_summaries, library_names, std_fs_sites, branch_phrases, embedding_cosine)}
ORACLE = {
    "doc_examples": r"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '## Examples:' || chr(10) WHEN turn % 7 = 3 THEN '  ```rust' || chr(10) ELSE '' END || text AS x FROM conversations),
      l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(x, chr(10)), lambda s: CASE WHEN regexp_matches(s, '(?i)^\s*#+\s*examples:?\s*$') THEN 'heading' WHEN regexp_matches(s, '^\s*(```|~~~)') THEN 'fence' END), lambda s: s IS NOT NULL) AS v FROM t)
      SELECT conv_id, turn, v[1] AS violation FROM l WHERE len(v) > 0""",
    "long_modules": "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents WHERE length(text) - length(replace(text, chr(10), '')) + 1 > 40 AND lang <> 'de'",
    "misordered_first": "WITH f AS (SELECT user_id, min(event_id) FILTER (event_type <> 'purchase') AS x FROM events GROUP BY 1) SELECT user_id, min(event_id) AS pos FROM events JOIN f USING (user_id) WHERE event_type = 'purchase' AND event_id > x GROUP BY user_id",
    "call_sites": """WITH e AS (SELECT DISTINCT 'helper' || (event_id % 500) AS callee, user_id AS test, epoch(date_trunc('second', ts))::BIGINT AS lo, event_id AS id FROM events)
      SELECT callee, count(*) AS n_calls, count(DISTINCT test) AS n_tests, min(lo) AS first_lo, arg_min(id, {'lo': lo, 'id': id}) AS first_id FROM e GROUP BY callee HAVING count(*) >= 3 AND count(DISTINCT test) >= 3""",
    "exclusions": r"""WITH p AS (SELECT page_id, replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', '::') AS path FROM pages),
      x AS (SELECT DISTINCT regexp_extract(path, '^([^:]+::[^:]+)', 1) AS prefix FROM p WHERE page_id % 5 = 0 AND regexp_extract(path, '^([^:]+::[^:]+)', 1) <> '')
      SELECT page_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE path = prefix OR starts_with(path, prefix || '::'))""",
    "harness_semi": "WITH o AS (SELECT o_orderkey AS id, o_custkey AS name, year(o_orderdate)::INT AS lo, month(o_orderdate)::INT AS hi FROM orders) SELECT * FROM o WHERE EXISTS (SELECT 1 FROM o c WHERE c.id % 3 = 0 AND c.name = o.name AND c.lo = o.lo AND c.hi = o.hi AND c.id <> o.id)",
    "install_rates": """WITH r AS (SELECT user_id % 50 AS host, CASE WHEN event_type IN ('view', 'click') THEN 'download' ELSE 'build' END AS mode, round(value * 10)::BIGINT AS ms FROM events),
      t AS (SELECT host, count(*) AS installs, count(*) FILTER (mode = 'download') AS downloads, count(*) FILTER (mode = 'build') AS builds, sum(ms)::BIGINT AS total_ms FROM r GROUP BY host)
      SELECT *, round(downloads / installs, 6) AS download_rate, CASE WHEN total_ms >= 3600000 THEN (total_ms // 3600000) || 'h ' ELSE '' END || CASE WHEN total_ms >= 60000 THEN (total_ms // 60000 % 60) || 'm ' ELSE '' END || (total_ms // 1000 % 60) || '.' || lpad((total_ms % 1000)::VARCHAR, 3, '0') || 's' AS duration FROM t""",
    "install_summaries": """WITH r AS (SELECT user_id % 50 AS host, CASE WHEN event_type IN ('view', 'click') THEN 'download' ELSE 'build' END AS mode, round(value * 10)::BIGINT AS ms FROM events),
      t AS (SELECT host, count(*) AS n, count(*) FILTER (mode = 'download') AS a, count(*) FILTER (mode = 'build') AS b, sum(ms)::BIGINT AS ms FROM r GROUP BY host)
      SELECT host, printf('%d installs, %.1f%% downloaded, %.1f%% built, ', n, 100.0 * a / n, 100.0 * b / n) || CASE WHEN ms >= 3600000 THEN (ms // 3600000) || 'h ' ELSE '' END || CASE WHEN ms >= 60000 THEN (ms // 60000 % 60) || 'm ' ELSE '' END || (ms // 1000 % 60) || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || 's' AS summary FROM t""",
    "listed_sites": """WITH e AS (SELECT 'helper' || (event_id % 40) AS callee, user_id::VARCHAR AS test, epoch(date_trunc('second', ts))::BIGINT // 3600 AS lo, user_id % 3 AS id, event_type AS shape FROM events),
      s AS (SELECT callee, lo, id, min(test) AS test, arg_min(shape, test || '/' || shape) AS shape FROM e GROUP BY ALL)
      SELECT callee, row_number() OVER (PARTITION BY callee ORDER BY lo, id) AS place, lo, lo + 1 AS hi, id, test, shape FROM s""",
    "library_names": "SELECT p_partkey, replace(p_name, ' ', '_') AS crate, p_brand AS toolchain FROM part WHERE position('@' IN p_name) = 0",
    "std_fs_sites": "SELECT p_partkey, p_brand AS crate, 'app::m' || (p_size % 7) || '::f' AS path, 'std::fs::' || string_split(p_type, ' ')[1] AS label FROM part WHERE p_partkey % 3 = 0 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_size % 7 <> 3",
    "branch_phrases": """SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN CASE WHEN n = 1 THEN 'un gangen' WHEN n = 2 THEN 'dwy gangen' WHEN n = 3 THEN 'tair cangen' WHEN n = 6 THEN 'chwe changen' WHEN n IN (4, 5) THEN n || ' cangen' ELSE n || ' canghennau' END
      WHEN 1 THEN CASE WHEN n = 1 THEN '1 meur' ELSE n || ' meuran' END ELSE CASE WHEN n = 1 THEN '1 branch' ELSE n || ' branches' END END AS phrase FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""",
    "embedding_cosine": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS "left", b.vec_id AS "right", round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 4) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.35""",
}
