"""Queries of single audits: runs, files, payloads within payloads, default mappings, whole plan rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.urls import is_page, names_url
from gleanery.functions.values import decode_object
from gleanery.operators import catalog, coverage, flow, history, mapping, plan, reconcile, search, store, vocab
from gleanery.plans import bindings as B
from gleanery.plans.registry import query
from gleanery.plans.verification import _EXPECT
from gleanery.plans.vocabularies import _tree
from gleanery.session import dealt, table

_FAULTS = f"""faults AS (
  SELECT source_url, CASE WHEN status = 'downloaded' AND filename <> '' THEN CASE WHEN file_url <> '' AND filename <> {_EXPECT} THEN 'canonical_filename' END
    WHEN status = 'load_failed' THEN 'load_failed' WHEN file_url <> '' THEN 'failed_download' END AS fault FROM dl)"""


@query(f"WITH {B.DL_SQL}, {_FAULTS} SELECT source_url, fault FROM faults WHERE fault IS NOT NULL")
def download_faults(spark, sf_dir):
    return reconcile.download_faults(B.downloads(spark, sf_dir))


@query(
    f"""WITH {B.DL_SQL}, {_FAULTS}, c AS (SELECT count(*) FILTER (WHERE status = 'downloaded' AND filename <> '') AS downloaded, count(*) AS total,
  bool_or(file_url <> '' OR filename <> '' OR status NOT IN ('', 'no_files')) AS wants_files FROM dl), f AS (SELECT count(fault) AS faults FROM faults)
SELECT downloaded, total, faults, wants_files, faults = 0 AND (CASE WHEN wants_files THEN downloaded ELSE total END) >= 1 AS passed FROM c, f"""
)
def smoke_counts(spark, sf_dir):
    return reconcile.smoke_counts(B.downloads(spark, sf_dir))


@query(f"WITH {B.DL_SQL} SELECT count(DISTINCT file_url) AS n FROM dl WHERE file_url <> ''")
def distinct_file_urls(spark, sf_dir):
    return reconcile.distinct_urls(B.downloads(spark, sf_dir))


@query(f"WITH {B.DL_SQL} SELECT filename, min(_seq) AS first_seq FROM dl WHERE filename <> '' GROUP BY filename")
def ordered_filenames(spark, sf_dir):
    return reconcile.ordered_filenames(B.downloads(spark, sf_dir))


@query("SELECT strftime(o_orderdate, '%Y') AS year, o_orderpriority AS state, count(*) AS n FROM orders GROUP BY 1, 2")
def pair_counts(spark, sf_dir):
    return coverage.pair_counts(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_orderpriority").alias("state")), "year", "state")


@query(
    f"""WITH {B.DL_SQL}, {B.FILES_SQL}, cand AS (SELECT p_partkey AS probe_ord, p_partkey % 4 AS k, 'https://h.example/f/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.doc' ELSE '' END AS whole FROM part),
c AS (SELECT probe_ord, CASE k WHEN 0 THEN upper(substr(whole, 1, 5)) || substr(whole, 6) WHEN 1 THEN substr(whole, 9) WHEN 2 THEN whole || '#part' ELSE 'https://nowhere.example/' || probe_ord END AS source_url,
  CASE WHEN k < 3 THEN whole END AS whole, k FROM cand),
hit AS (SELECT probe_ord, min(_seq) AS _seq FROM c JOIN dl ON file_url = whole GROUP BY 1),
j AS (SELECT c.*, dl.source_url AS db_source_url, dl._seq, dl.filename AS stored,
  CASE WHEN ends_with(c.source_url, '.doc') THEN 'doc_' || substr(sha1(u), 1, 12) || '.doc' WHEN k = 2 AND ends_with(whole, '.doc') THEN 'doc_' || substr(sha1(whole), 1, 12) || '.doc' ELSE 'pdf_' || substr(sha1(u), 1, 12) || '.pdf' END AS expected
  FROM (SELECT *, CASE k WHEN 1 THEN source_url WHEN 3 THEN source_url ELSE whole END AS u FROM c) c LEFT JOIN hit h ON c.probe_ord = h.probe_ord LEFT JOIN dl ON dl._seq = h._seq),
v AS (SELECT j.*, coalesce(e.basename, s.basename) AS found, CASE WHEN e.basename IS NOT NULL THEN e.is_valid ELSE s.is_valid END AS ok, CASE WHEN e.basename IS NOT NULL THEN e.length ELSE s.length END AS len
  FROM j LEFT JOIN files e ON j.expected = e.basename LEFT JOIN files s ON j.stored = s.basename)
SELECT probe_ord, source_url, CASE WHEN _seq IS NULL THEN 'missing_from_db' WHEN found IS NULL THEN 'file_not_downloaded' WHEN NOT ok THEN 'corrupt_file' WHEN len <= 1024 THEN 'suspiciously_small' ELSE 'present' END AS verdict,
  db_source_url, CASE WHEN _seq IS NOT NULL THEN coalesce(found, stored) END AS filename FROM v"""
)
def spot_checks(spark, sf_dir):
    i = F.col("p_partkey")
    whole = F.concat(F.lit("https://h.example/f/"), i, F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".doc").otherwise(""))
    spelt = F.when(i % 4 == 0, F.concat(F.upper(F.left(whole, F.lit(5))), F.substr(whole, F.lit(6)))).when(i % 4 == 1, F.substr(whole, F.lit(9))).when(i % 4 == 2, F.concat(whole, F.lit("#part")))
    candidates = dealt(table(spark, sf_dir, "part").select("p_partkey")).select(i.alias("probe_ord"), spelt.otherwise(F.concat(F.lit("https://nowhere.example/"), i)).alias("source_url"))
    return coverage.spot_checks(candidates, B.downloads(spark, sf_dir), B.file_listing(spark, sf_dir))


def _run_log(spark, sf_dir):
    i = F.col("o_orderkey")
    line = F.when(i % 11 == 0, F.format_string(" DISCOVERY total_saved=%d ", i % 1000)).otherwise(F.format_string("DISCOVERY target=c%d found=%d saved=%d", F.col("o_custkey") % 30, F.col("o_custkey") % 5, i % 12))
    return table(spark, sf_dir, "orders").select(i.alias("line_no"), line.alias("line"))


@query(
    f"""WITH {B.LINKS_SQL}, o AS (SELECT o_orderkey AS line_no, 'c' || (o_custkey % 30) AS label, o_custkey % 5 AS found, o_orderkey % 12 AS saved FROM orders WHERE o_orderkey % 11 <> 0),
t AS (SELECT label, arg_max(found, line_no) AS found, arg_max(saved, line_no) AS saved FROM o GROUP BY label), g AS (SELECT arg_max(o_orderkey % 1000, o_orderkey) AS total FROM orders WHERE o_orderkey % 11 = 0)
SELECT NULL AS label, CASE WHEN total = 0 THEN 'nothing_collected' WHEN (SELECT count(*) FROM links) = 0 THEN 'nothing_stored' END AS failure FROM g WHERE total = 0 OR (SELECT count(*) FROM links) = 0
UNION ALL SELECT label, 'found_below_minimum' FROM t WHERE found < 2 UNION ALL SELECT label, 'saved_above_found' FROM t WHERE found > 0 AND saved > 2.0 * found"""
)
def run_check(spark, sf_dir):
    return coverage.run_check(_run_log(spark, sf_dir), store.fold_links(B.link_events(spark, sf_dir)), least_found=2)


@query("SELECT DISTINCT 'p' || (o_custkey % 5000) AS path FROM orders WHERE 'p' || (o_custkey % 5000) NOT IN (SELECT 'p' || c_custkey * 3 FROM customer)")
def unvisited_paths(spark, sf_dir):
    declared = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 5000).alias("path"))
    return coverage.unvisited(declared, table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey") * 3).alias("path")))


@query("SELECT 'u' || c_custkey AS url, 'report' AS origin FROM customer UNION ALL SELECT url, 'tool' FROM (SELECT 'u' || (s_suppkey * 10) AS url FROM supplier) WHERE url NOT IN (SELECT 'u' || c_custkey FROM customer)")
def merged_results(spark, sf_dir):
    report = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("url"), F.lit("report").alias("origin"))
    return coverage.merged_results(report, table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey") * 10).alias("url"), F.lit("tool").alias("origin")))


@query("SELECT 's' || p_partkey AS subtask_id, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'failed' WHEN s_suppkey IS NOT NULL THEN 'done' END, 'pending') AS status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def subtask_specs(spark, sf_dir):
    specs = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), "p_partkey").alias("subtask_id"))
    states = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("subtask_id"), F.when(F.col("s_suppkey") % 3 == 0, "failed").otherwise("done").alias("status"))
    return flow.with_specs(specs, states)


@query("SELECT o_custkey AS job, count(*) FILTER (WHERE o_orderstatus <> 'F') AS remaining, avg(o_orderkey % 60) FILTER (WHERE o_orderstatus = 'F') * count(*) FILTER (WHERE o_orderstatus <> 'F') AS seconds FROM orders GROUP BY 1")
def job_eta(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_orderkey") % 60).alias("seconds"))
    return flow.eta(rows)


_DEEP = """deep AS (SELECT p_partkey AS k, p_brand AS a, p_type AS b, p_name AS c FROM part)"""


@query(
    f"""WITH {_DEEP}, v AS (
  SELECT 'tags' AS field, a AS value FROM deep UNION ALL SELECT 'tags', b FROM deep UNION ALL SELECT 'tags', c FROM deep WHERE k % 2 = 0 UNION ALL SELECT 'tags', 'True' FROM deep
  UNION ALL SELECT 'size', CASE WHEN k % 2 = 0 THEN k % 7 || '.5' ELSE '{{''cm'': ' || (k % 7) || '}}' END FROM deep)
SELECT field, value, count(*) AS n FROM v GROUP BY 1, 2"""
)
def values_in_lists(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    inner = F.when(k % 2 == 0, q("p_name")).otherwise(F.lit('null, " "'))
    size = F.when(k % 2 == 0, F.concat(k % 7, F.lit(".5"))).otherwise(F.concat(F.lit('{"cm": '), k % 7, F.lit("}")))
    data = F.concat(F.lit('{"tags": ['), q("p_brand"), F.lit(", ["), q("p_type"), F.lit(", ["), inner, F.lit("]], true, []], "), F.lit('"size": '), size, F.lit("}"))
    return catalog.exploded_deep(p.select(k.alias("_seq"), data.alias("data"))).groupBy("field", "value").agg(F.count("*").alias("n"))


@query(f"WITH {B.REC_SQL} SELECT _seq, event_type AS kind, coalesce(k, 'own') AS k, source_url FROM rec")
def payload_flatten(spark, sf_dir):
    rows = B.records(spark, sf_dir)
    envelope = F.create_map(F.lit("source_url"), F.col("source_url"), F.lit("k"), F.lit("own"), F.lit("event_type"), F.lit("own"))
    flat = rows.select("_seq", catalog.flattened(envelope, decode_object(F.col("data"))).alias("m"))
    return flat.select("_seq", F.col("m")["event_type"].alias("kind"), F.col("m")["k"].alias("k"), F.col("m")["source_url"].alias("source_url"))


@query("SELECT page_id, page_id % 4 <> 0 AS page, page_id % 3 <> 2 AS key FROM pages")
def url_predicates(spark, sf_dir):
    i = F.col("page_id")
    tail = F.element_at(F.array(*map(F.lit, ("/a.PDF?x=1.html", "/b.html#.pdf", "/c.d/e", "/f?x=.zip"))), (i % 4 + 1).cast("int"))
    key = F.element_at(F.array(*map(F.lit, ("core_source_page", "file_url", "page_number"))), (i % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", is_page(F.concat(F.lit("https://h.example"), tail)).alias("page"), names_url(key).alias("key"))


@query("SELECT p_name AS label, min(p_partkey) AS ord FROM part WHERE p_size > 10 GROUP BY 1")
def relationship_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 10, "a").otherwise("b").alias("template"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    return vocab.relationship_labels(rows, "a")


@query(
    """WITH top AS (SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation) ORDER BY n_nationkey LIMIT 1)
SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 5 = 0 THEN 's' END AS source,
  CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN coalesce((SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1), n_name) WHEN 2 THEN 'elsewhere'
    WHEN 3 THEN coalesce((SELECT s_name FROM supplier WHERE s_nationkey = (SELECT k FROM top) ORDER BY s_suppkey LIMIT 1), (SELECT name FROM top)) END AS default_value,
  CASE WHEN n_nationkey % 5 = 1 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'by hand; default moved from group ' || n_name || ' to leaf ' || (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 1)
    WHEN n_nationkey % 5 IN (3, 4) THEN 'no scraped field for this property' ELSE 'by hand' END AS notes FROM nation"""
)
def default_fill(spark, sf_dir):
    n, i = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    props = n.select(
        F.concat(F.lit("n"), i).alias("name"), F.when(i % 5 == 4, "text").otherwise("select").alias("type"), (i % 5 == 3).alias("required"), F.lit("geo").alias("thesaurus_id")
    )
    default = F.when(i % 5 == 1, F.col("n_name")).when(i % 5 == 2, "elsewhere")
    mapped = n.where(i % 5 < 3).select(F.concat(F.lit("n"), i).alias("name"), F.when(i % 5 == 0, "s").alias("source"), default.alias("default_value"), F.lit("by hand").alias("notes"))
    return mapping.fill_defaults(mapped, props, vocab.tree_paths(_tree(spark, sf_dir)))


@query(
    f"""WITH {B.DL_SQL}, have AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'f' || p_partkey ELSE 'pdf_' || substr(sha1('https://h.example/f/' || p_partkey || CASE p_partkey % 3 WHEN 1 THEN '.doc' ELSE '' END), 1, 12) || '.pdf' END AS basename FROM part)
SELECT source_url, coalesce(CASE WHEN filename IN (SELECT basename FROM have) THEN filename END, CASE WHEN 'pdf_' || substr(sha1(file_url), 1, 12) || '.pdf' IN (SELECT basename FROM have) AND file_url <> '' THEN 'pdf_' || substr(sha1(file_url), 1, 12) || '.pdf' END) AS pdf_name FROM dl"""
)
def resolved_files(spark, sf_dir):
    from gleanery.functions.urls import pdf_filename

    i = F.col("p_partkey")
    url = F.concat(F.lit("https://h.example/f/"), i, F.when(i % 3 == 1, ".doc").otherwise(""))
    have = table(spark, sf_dir, "part").select(F.when(i % 3 == 0, F.concat(F.lit("f"), i)).otherwise(pdf_filename(url)).alias("basename"))
    return plan.with_files(B.downloads(spark, sf_dir), have).select("source_url", "pdf_name")


@query(
    """WITH m AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'tool_return' WHEN 1 THEN 'thinking' ELSE 'user' END AS kind, 't' || (turn % 4) AS tool, repeat(text, 5) AS content FROM conversations)
SELECT conv_id, turn, CASE WHEN kind = 'thinking' THEN 'thinking' WHEN kind = 'tool_return' AND length(content) >= 1000 THEN CASE tool WHEN 't0' THEN 'snapshot' WHEN 't1' THEN 'validation' ELSE 'other' END END AS bucket FROM m"""
)
def history_buckets(spark, sf_dir):
    t = F.col("turn")
    kind = F.when(t % 3 == 0, "tool_return").when(t % 3 == 1, "thinking").otherwise("user")
    bucket = history.trim_bucket(kind, F.concat(F.lit("t"), t % 4), F.repeat("text", F.lit(5)), ("t0",), ("t1",))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", bucket.alias("bucket"))


_TIMES = "2 * ((length(t) - length(replace(t, 'tion', ''))) // 4) + 2 * ((length(t) - length(replace(t, 'theandtion', ''))) // 10)"


@query(f"SELECT * FROM (SELECT doc_id, CAST({_TIMES} AS BIGINT) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE lang = 'en') ORDER BY score DESC, doc_id LIMIT 5) WHERE score > 0")
def relevance_of_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), F.col("text").alias("note"))
    return search.top_relevant(rows, "tion, with theandtion", 5, ties="doc_id", weights={"note": 2}, kind="en").select("doc_id", "score")
