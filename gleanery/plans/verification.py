"""Queries that reconcile and verify a crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.urls import expected_filename
from gleanery.functions.values import get_or_blank
from gleanery.operators import coverage, reconcile, store
from gleanery.plans import bindings as B
from gleanery.plans.registry import query
from gleanery.session import table

_EXPECT = """CASE WHEN file_url = '' THEN NULL WHEN file_url LIKE '%.doc' THEN 'doc_' || substr(sha1(file_url), 1, 12) || '.doc' ELSE 'pdf_' || substr(sha1(file_url), 1, 12) || '.pdf' END"""
_VERDICTS = f"""WITH {B.DL_SQL}, {B.FILES_SQL}, want AS (SELECT *, {_EXPECT} AS expected FROM dl),
verdicts AS (
  SELECT source_url, coalesce(w.expected, '') AS expected,
    CASE WHEN file_url = '' THEN 'empty_pdf_url' WHEN f.basename IS NULL THEN 'file_not_downloaded' WHEN NOT f.is_valid THEN 'corrupt_file' WHEN f.length <= 1024 THEN 'suspiciously_small' ELSE 'present' END AS verdict,
    coalesce(filename <> '' AND filename <> w.expected, false) AS filename_mismatch
  FROM want w LEFT JOIN files f ON w.expected = f.basename)"""


def _verdicts(spark, sf_dir):
    return reconcile.verdicts(B.downloads(spark, sf_dir), B.file_listing(spark, sf_dir))


@query(f"{_VERDICTS} SELECT * FROM verdicts")
def reconcile_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(
    f"""{_VERDICTS} SELECT count(*) AS total, {", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ("present", "empty_pdf_url", "file_not_downloaded", "corrupt_file", "suspiciously_small"))},
count(*) FILTER (WHERE filename_mismatch) AS mismatched, count(*) FILTER (WHERE verdict <> 'present') AS missing_count FROM verdicts"""
)
def reconcile_counts(spark, sf_dir):
    return reconcile.verdict_counts(_verdicts(spark, sf_dir))


@query(f"{_VERDICTS} SELECT basename FROM files WHERE basename LIKE '%.pdf' AND basename NOT IN (SELECT expected FROM verdicts WHERE expected <> '')")
def reconcile_orphans(spark, sf_dir):
    claimed = _verdicts(spark, sf_dir).where("expected <> ''").select(F.col("expected").alias("basename"))
    return reconcile.orphans(B.file_listing(spark, sf_dir), claimed)


@query(f"WITH {B.FILES_SQL} SELECT CAST(length AS BIGINT) AS length, count(*) AS n FROM files WHERE length > 0 GROUP BY length HAVING count(*) >= 2")
def size_clusters(spark, sf_dir):
    return reconcile.size_clusters(B.file_listing(spark, sf_dir))


@query(f"WITH {B.DL_SQL} SELECT file_url AS url, count(*) AS n FROM dl WHERE file_url <> '' GROUP BY file_url HAVING count(*) > 1")
def dup_urls(spark, sf_dir):
    return reconcile.duplicate_urls(B.downloads(spark, sf_dir))


@query(
    f"""{_VERDICTS}, {B.LINKS_SQL}, items AS (
  SELECT 0 AS ord, 'duplicate_pdf_url' AS kind, file_url AS item FROM dl WHERE file_url <> '' GROUP BY file_url HAVING count(*) > 1
  UNION ALL SELECT 1, 'orphan_file', basename FROM files WHERE basename LIKE '%.pdf' AND basename NOT IN (SELECT expected FROM verdicts WHERE expected <> '')
  UNION ALL SELECT 2, 'part_leftover', basename FROM files WHERE basename LIKE '%.part'
  UNION ALL SELECT 3, 'identical_size_cluster', count(*) || ' x ' || length FROM files WHERE length > 0 GROUP BY length HAVING count(*) >= 2
  UNION ALL SELECT 4, 'discovered_unprocessed', url FROM links WHERE status = 'discovered'),
r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY item) AS rn FROM items)
SELECT ord, kind, count(*) AS n, string_agg(item, ',' ORDER BY item) FILTER (WHERE rn <= 20) AS items FROM r GROUP BY ord, kind"""
)
def corpus_findings(spark, sf_dir):
    found = reconcile.corpus_findings(B.downloads(spark, sf_dir), B.file_listing(spark, sf_dir), store.fold_links(B.link_events(spark, sf_dir)))
    return found.withColumn("items", F.array_join("items", ","))


#: Probes: each page's URL respelt, cut or extended, or one that no page has.
_PROBES = """probes AS (
  SELECT page_id AS probe_ord, CASE page_id % 4 WHEN 0 THEN upper(substr(url, 1, 5)) || substr(url, 6) WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN url || '/more' ELSE 'https://nowhere.example/q/' || page_id END AS source_url
  FROM pages)"""


def _probes(spark, sf_dir):
    u, i = F.col("url"), F.col("page_id")
    shape = F.when(i % 4 == 0, F.concat(F.upper(F.left(u, F.lit(5))), F.substr(u, F.lit(6)))).when(i % 4 == 1, F.regexp_replace(u, "^https?://", "")).when(i % 4 == 2, F.concat(u, F.lit("/more")))
    return table(spark, sf_dir, "pages").select(i.alias("probe_ord"), shape.otherwise(F.concat(F.lit("https://nowhere.example/q/"), i)).alias("source_url"))


_NORM = r"""CASE WHEN {u} = '' THEN '' ELSE (SELECT CASE WHEN s IN ('http', 'https') THEN 'https://' WHEN s = '' THEN '' ELSE s || '://' END || lower(n) || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END FROM (
  SELECT lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS n,
    regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS p, array_to_string(list_sort(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&')), '&') AS q)) END"""
_FOUND = f"""WITH {_PROBES}, p AS (SELECT *, {_NORM.format(u="source_url")} AS nu, lower(rtrim(source_url, '/')) AS low, rtrim(source_url, '/') AS bare FROM probes),
r AS (SELECT page_id AS _seq, url, {_NORM.format(u="url")} AS nu, lower(rtrim(url, '/')) AS low FROM pages),
hit AS (
  SELECT p.probe_ord, min(r._seq) AS matched_seq FROM p JOIN r ON p.nu = r.nu
    OR (length(p.low) > 8 AND length(r.low) > 8 AND (ends_with(r.low, p.low) OR ends_with(p.low, r.low)))
    OR (length(p.bare) > 8 AND starts_with(r.url, p.bare) AND substr(r.url, length(p.bare) + 1, 1) IN ('', '/', '?'))
  GROUP BY p.probe_ord),
found AS (SELECT s.probe_ord, s.source_url, CASE WHEN h.probe_ord IS NULL THEN 'missing_url' ELSE 'captured' END AS verdict, h.matched_seq FROM probes s LEFT JOIN hit h ON s.probe_ord = h.probe_ord)"""


def _probe(spark, sf_dir):
    return coverage.probe_corpus(_probes(spark, sf_dir), table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("_seq")))


@query(f"{_FOUND} SELECT probe_ord, source_url, verdict, coalesce(matched_seq, -1) AS matched_seq FROM found")
def probe_corpus(spark, sf_dir):
    return _probe(spark, sf_dir).withColumn("matched_seq", F.coalesce("matched_seq", F.lit(-1).cast("bigint")))


@query(f"{_FOUND} SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'captured') AS captured, count(*) FILTER (WHERE verdict <> 'captured') AS failed FROM found")
def probe_counts(spark, sf_dir):
    return coverage.probe_counts(_probe(spark, sf_dir))


@query(
    """WITH v AS (SELECT DISTINCT CAST(o_custkey * 3 AS INTEGER) AS v FROM orders) SELECT CAST(g AS BIGINT) AS missing FROM (SELECT unnest(range((SELECT min(v) FROM v), (SELECT max(v) FROM v) + 1)) AS g) WHERE g NOT IN (SELECT v FROM v)"""
)
def numeric_gaps(spark, sf_dir):
    return coverage.numeric_gaps(table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).cast("string").alias("value")))


@query("SELECT v + 1 AS lo, w - 1 AS hi FROM (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM (SELECT DISTINCT o_orderkey * 1000003 AS v FROM orders)) WHERE w > v + 1")
def numeric_gap_spans(spark, sf_dir):
    return coverage.gap_spans(table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000003).cast("string").alias("value")))


_MONTHS = "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS prio FROM orders"


@query(f"WITH seen AS ({_MONTHS}) SELECT d.day, p.prio FROM (SELECT DISTINCT day FROM seen) d CROSS JOIN (SELECT DISTINCT prio FROM seen) p EXCEPT SELECT day, prio FROM seen")
def cross_gaps(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("prio"))
    return coverage.cross_gaps(pairs, "day", "prio")


#: A discovery log out of orders: one line for each.
_LOG = "log AS (SELECT o_orderkey AS line_no, 'c' || (o_custkey % 30) AS label, o_custkey % 50 AS found, o_orderkey % 120 AS saved FROM orders)"


def _log(spark, sf_dir):
    line = F.format_string("DISCOVERY target=c%d found=%d saved=%d", F.col("o_custkey") % 30, F.col("o_custkey") % 50, F.col("o_orderkey") % 120)
    return coverage.discovery_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), line.alias("line")))


@query(f"WITH {_LOG}, {B.LINKS_SQL}, t AS (SELECT label, arg_max(found, line_no) AS found, arg_max(saved, line_no) AS saved FROM log GROUP BY label), c AS (SELECT 'c' || substr(filter_label, 2) AS label, count(*) AS n FROM links GROUP BY 1) SELECT * FROM (SELECT coalesce(t.label, c.label) AS label, CAST(greatest(coalesce(found, 0), coalesce(saved, 0)) AS BIGINT) AS expected, CAST(coalesce(n, 0) AS BIGINT) AS stored FROM t FULL JOIN c ON t.label = c.label) WHERE stored < expected")
def discovery_undercollect(spark, sf_dir):
    counts = store.links_by_label(store.fold_links(B.link_events(spark, sf_dir))).select(F.concat(F.lit("c"), F.substr(F.col("filter_label"), F.lit(2))).alias("filter_label"), "n")
    return coverage.under_collected(_log(spark, sf_dir), counts)


@query(
    f"""WITH {_LOG}, t AS (SELECT label, arg_max(found, line_no) AS found, arg_max(saved, line_no) AS saved FROM log GROUP BY label)
SELECT label, 'found_below_minimum' AS failure FROM t WHERE found < 5 UNION ALL SELECT label, 'saved_above_found' FROM t WHERE found > 0 AND saved > 2.0 * found"""
)
def self_check_failures(spark, sf_dir):
    return coverage.self_check(_log(spark, sf_dir), least_found=5)


@query(
    """WITH rows AS (SELECT doc_id, 'page_' || (doc_id % 300) AS html_filename, CASE WHEN doc_id % 2 = 0 THEN '</html>' ELSE 'no such reference' END AS document_ref FROM documents),
cap AS (SELECT 'page_' || page_id AS basename, html FROM pages)
SELECT CAST(doc_id AS VARCHAR) AS source_url, CASE WHEN c.basename IS NULL THEN 'html_missing' ELSE 'reference_not_found' END AS problem FROM rows r LEFT JOIN cap c ON r.html_filename = c.basename
WHERE c.basename IS NULL OR (NOT contains(c.html, r.document_ref) AND NOT contains(replace(c.html, ' ', ''), replace(r.document_ref, ' ', '')))"""
)
def html_gate(spark, sf_dir):
    ref = F.when(F.col("doc_id") % 2 == 0, "</html>").otherwise("no such reference")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_url"), F.concat(F.lit("page_"), F.col("doc_id") % 300).alias("html_filename"), ref.alias("document_ref"))
    return coverage.html_gate(rows, table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), "page_id").alias("basename"), "html"))


@query(f"WITH {B.DL_SQL} SELECT count(*) >= 100 AS enough, bool_or(file_url <> '') AS has_core_file_url, bool_or(filename <> '') AS has_core_pdf_filename, false AS has_author FROM dl")
def expected_output(spark, sf_dir):
    return coverage.expected_output(B.downloads(spark, sf_dir), ["core_file_url", "core_pdf_filename", "author"], 100)


@query(
    r"""WITH h AS (SELECT page_id % 10 AS page, page_id AS pos, url AS href, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS i FROM pages)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY pos) AS INTEGER) AS n, href,
  CASE WHEN strpos(href, '/en/') > 0 THEN substr(href, 1, strpos(href, '/en/') - 1) || '/full/' || substr(href, strpos(href, '/en/') + 4) ELSE href END AS url,
  CAST(row_number() OVER (PARTITION BY page ORDER BY pos) AS VARCHAR) || ',' || coalesce(CAST(i AS VARCHAR), '') || ',' || href AS label
FROM h WHERE i IS NULL OR (i BETWEEN 100 AND 800)"""
)
def listing_enumeration(spark, sf_dir):
    hrefs = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("page"), F.col("page_id").alias("pos"), F.col("url").alias("href"))
    return coverage.listing_targets(hrefs, "/([0-9]+)", 100, 800, "/en/", "/full/")


@query(f"WITH {B.DL_SQL} SELECT source_url, {_EXPECT} AS expected FROM dl WHERE file_url <> ''")
def expected_filenames(spark, sf_dir):
    url = get_or_blank(F.col("data"), "core_file_url")
    return B.downloads(spark, sf_dir).where(url != "").select("source_url", expected_filename(url).alias("expected"))
