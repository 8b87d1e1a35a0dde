"""Queries on single shapes: bytes of files, names, times, elements, snapshots, drafts, plan rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import urls as U
from gleanery.functions import values as V
from gleanery.operators import catalog, coverage, html, lint, mapping, plan, reconcile, store, vocab
from gleanery.operators.filters import holds_text
from gleanery.plans import bindings as B
from gleanery.plans.registry import query
from gleanery.plans.vocabularies import _TREE, _tree
from gleanery.session import table

#: Contents of files: whole, cut, small, with the end mark too far from the end, office documents, empty ones.
_BYTES = """bytes AS (SELECT CASE WHEN i % 7 < 5 THEN 'f' || i || CASE WHEN i % 2 = 0 THEN '.pdf' ELSE '.PDF' END ELSE 'f' || i || '.doc' END AS basename,
  CASE i % 7 WHEN 0 THEN '%PDF-1.' || repeat('x', 900 + i % 400) || '%%EOF' WHEN 1 THEN '%PDF' || repeat('y', i % 3000) WHEN 2 THEN 'PDF%' || repeat('z', 2000) || '%%EOF'
    WHEN 3 THEN '%PDF' || repeat('x', 3000) || '%%EOF' || repeat(' ', 900 + i % 1300) WHEN 4 THEN '' WHEN 5 THEN 'PK' || chr(3) || chr(4) || repeat('d', i % 2000) ELSE repeat('q', i % 5) END AS content FROM (SELECT p_partkey AS i FROM part)),
seen AS (SELECT basename, length(content) AS length, starts_with(content, '%PDF') AS magic, contains(right(content, 2048), '%%EOF') AS ends, contains(right(content, 1024), '%%EOF') AS ends_near, starts_with(content, 'PK' || chr(3) || chr(4)) AS office FROM bytes),
checked AS (SELECT *, CASE WHEN lower(basename) LIKE '%.pdf' THEN magic AND ends ELSE length > 0 END AS is_valid FROM seen)"""


@query(f"WITH {_BYTES} SELECT basename, CAST(length AS BIGINT) AS length, is_valid, is_valid AND length <= 1024 AS is_small, magic AND ends_near AS is_pdf, office AS is_office FROM checked")
def file_integrity(spark, sf_dir):
    i = F.col("p_partkey")
    k = i % 7
    x = lambda char, n: F.repeat(F.lit(char), n.cast("int") if hasattr(n, "cast") else F.lit(n))
    content = (
        F.when(k == 0, F.concat(F.lit("%PDF-1."), x("x", 900 + i % 400), F.lit("%%EOF")))
        .when(k == 1, F.concat(F.lit("%PDF"), x("y", i % 3000)))
        .when(k == 2, F.concat(F.lit("PDF%"), x("z", 2000), F.lit("%%EOF")))
        .when(k == 3, F.concat(F.lit("%PDF"), x("x", 3000), F.lit("%%EOF"), x(" ", 900 + i % 1300)))
        .when(k == 4, "")
        .when(k == 5, F.concat(F.lit("PK\x03\x04"), x("d", i % 2000)))
        .otherwise(x("q", i % 5))
    )
    name = F.concat(F.lit("f"), i, F.when(k >= 5, ".doc").when(i % 2 == 0, ".pdf").otherwise(".PDF"))
    files = table(spark, sf_dir, "part").select(name.alias("basename"), content.cast("binary").alias("content")).withColumn("length", F.length("content").cast("bigint"))
    more = files.select("basename", reconcile.is_pdf_bytes(F.col("content")).alias("is_pdf"), reconcile.is_office_bytes(F.col("content")).alias("is_office"))
    return reconcile.checked_files(files).join(more, "basename")


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 100000 AS s, 'Pkg' || (o_orderkey % 50) || CASE o_orderkey % 5 WHEN 0 THEN '[extra]>=1' WHEN 1 THEN '==2.0' WHEN 2 THEN ' ~=3' WHEN 3 THEN '!=1,<2' ELSE '' END AS spec, 'Order ' || o_orderkey || '/' || o_orderstatus || '-x_y.pdf' AS name FROM orders)
SELECT o_orderkey, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') AS safe, right(name, 7) AS tail, 'Pkg' || (o_orderkey % 50) AS package,
  CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS took,
  CASE o_orderkey % 4 WHEN 0 THEN 'a,B' WHEN 1 THEN 'B,a' ELSE 'A' || (o_orderkey % 3) || ',b' END AS names FROM t"""
)
def text_shapes(spark, sf_dir):
    k = F.col("o_orderkey")
    spec = F.concat(F.lit("Pkg"), k % 50, F.when(k % 5 == 0, "[extra]>=1").when(k % 5 == 1, "==2.0").when(k % 5 == 2, " ~=3").when(k % 5 == 3, "!=1,<2").otherwise(""))
    name = F.concat(F.lit("Order "), k, F.lit("/"), F.col("o_orderstatus"), F.lit("-x_y.pdf"))
    own = F.concat(F.lit("A"), k % 3)
    names = F.when(k % 4 == 0, F.array(*map(F.lit, ["a", "B", "A", "b"]))).when(k % 4 == 1, F.array(*map(F.lit, ["B", "a", "b"]))).otherwise(F.array(own, F.lit("b"), F.lower(own), F.lit("B")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.safe_filename(name).alias("safe"), T.tail(name, 7).alias("tail"), T.requirement_name(spec).alias("package"), T.duration(k % 100000).alias("took"), F.array_join(T.distinct_folded(names), ",").alias("names")
    )


@query(
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN origin || '/a/b' WHEN 1 THEN 'https://x.example/y?q=1' WHEN 2 THEN origin || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || 'c.pdf' WHEN 3 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example/z' ELSE regexp_replace(url, '#.*$', '') || '#top' END AS absolute,
  page_id % 4 <> 3 AS loopback FROM u"""
)
def link_absolute(spark, sf_dir):
    i = F.col("page_id")
    href = F.when(i % 5 == 0, "/a/b").when(i % 5 == 1, "https://x.example/y?q=1").when(i % 5 == 2, "c.pdf").when(i % 5 == 3, "//cdn.example/z").otherwise("#top")
    near = F.when(i % 4 == 0, "http://localhost:80/x").when(i % 4 == 1, "HTTP://user@127.0.0.1/").when(i % 4 == 2, "http://[::1]:8080/a").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.absolutise(F.col("url"), href).alias("absolute"), U.is_loopback(near).alias("loopback"))


@query("""SELECT event_id, sha256('{"id":"' || event_id || '","kind":"' || event_type || '","zone":"z' || (user_id % 3) || '"}') AS sha, contains(lower(event_type), 'ic') AS holds FROM events""")
def payload_fingerprints(spark, sf_dir):
    payload = F.create_map(F.lit("zone"), F.concat(F.lit("z"), F.col("user_id") % 3), F.lit("kind"), F.col("event_type"), F.lit("id"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", V.fingerprint(payload).alias("sha"), holds_text(F.col("event_type"), "IC").alias("holds"))


@query("SELECT 'p' || n_nationkey AS name FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 4 <> 1")
def uncovered_properties(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("p"), "n_nationkey").alias("name"), F.when(F.col("n_nationkey") % 6 == 0, "title").otherwise("text").alias("type"))
    return mapping.uncovered(n, n.where("n_nationkey % 4 = 1")).select("name")


#: Two templates that share names, and drafts for either, later ones of a target first in order.
_DRAFTS = """pri AS (SELECT n_nationkey AS ord, 'n' || n_nationkey AS name, CASE WHEN n_nationkey = 4 THEN 'title' ELSE 'text' END AS type FROM nation WHERE n_nationkey < 18),
reg AS (SELECT n_nationkey AS ord, 'n' || n_nationkey AS name, CASE WHEN n_nationkey = 20 THEN 'title' ELSE 'date' END AS type FROM nation WHERE n_nationkey >= 12),
drafts AS (SELECT 'n' || (s_suppkey % 25) AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'Registry' ELSE 'Primary' END AS template, CASE WHEN s_suppkey % 4 < 2 THEN 's' || s_suppkey END AS source, CASE WHEN s_suppkey % 4 = 2 THEN 'd' END AS default_value, s_suppkey AS ord FROM supplier),
every AS (SELECT target, arg_max({'s': source, 'd': default_value}, ord) AS d FROM drafts GROUP BY target), own AS (SELECT target, arg_max({'s': source, 'd': default_value}, ord) AS d FROM drafts WHERE template = 'Registry' GROUP BY target),
entries AS (
  SELECT p.name, p.type, CASE WHEN p.name IN (SELECT name FROM reg WHERE type <> 'title') THEN 'Primary,Registry' ELSE 'Primary' END AS templates, e.d FROM pri p LEFT JOIN every e ON p.name = e.target
  UNION ALL SELECT r.name, r.type, 'Registry', o.d FROM reg r LEFT JOIN own o ON r.name = o.target WHERE r.type <> 'title' AND r.name NOT IN (SELECT name FROM pri))"""


@query(f"WITH {_DRAFTS} SELECT name, type, templates, d.s AS source, CASE WHEN type = 'title' THEN -1 WHEN d.s IS NOT NULL THEN 0 WHEN d.d IS NOT NULL THEN 1 ELSE 2 END AS rank FROM entries")
def draft_templates(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("name"), F.lit(False).alias("required"))
    primary = n.where("ord < 18").withColumn("type", F.when(F.col("ord") == 4, "title").otherwise("text"))
    registry = n.where("ord >= 12").withColumn("type", F.when(F.col("ord") == 20, "title").otherwise("date"))
    k = F.col("s_suppkey")
    drafts = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), k % 25).alias("target"), F.when(k % 3 == 0, "Registry").otherwise("Primary").alias("template"), F.when(k % 4 < 2, F.concat(F.lit("s"), k)).alias("source"), F.when(k % 4 == 2, "d").alias("default_value"), k.alias("ord")
    )
    out = mapping.assemble_templates(drafts, primary, "Primary", registry, "Registry")
    return out.select("name", "type", F.array_join("templates", ",").alias("templates"), "source", "rank")


@query("""SELECT action, count(*) AS n, count(*) FILTER (WHERE bad) AS with_issues FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'create' ELSE 'update' END AS action, o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 AS bad FROM orders) GROUP BY action""")
def issue_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 3 == 0, "create").otherwise("update").alias("action"), F.when(k % 4 == 0, " ").otherwise("t").alias("title"), k.cast("string").alias("key"), F.when(k % 5 == 0, "").otherwise("f.pdf").alias("file_name"))
    return plan.issue_counts(plan.row_issues(rows.withColumn("metadata", F.create_map().cast("map<string,string>")), []))


@query("""SELECT o_orderkey, (a OR (m = 0 AND g = 0)) AND c AND (NOT h OR ok) AS passed FROM (SELECT o_orderkey, o_orderkey % 5 = 0 AS a, o_orderkey % 3 AS m, o_orderkey % 2 AS g, o_orderkey % 7 <> 0 AS c, o_orderkey % 11 < 5 AS h, o_orderkey % 4 > 0 AS ok FROM orders)""")
def pass_rule(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", coverage.passes(k % 5 == 0, k % 3, k % 2, k % 7 != 0, k % 11 < 5, k % 4 > 0).alias("passed"))


@query(f"WITH {_TREE} SELECT 'geo' AS thesaurus_id, node_id FROM tree WHERE label = 'Supplier#000000007' UNION ALL SELECT 'geo', node_id FROM tree WHERE label = (SELECT max(n_name) FROM nation)")
def label_search(spark, sf_dir):
    paths = vocab.tree_paths(_tree(spark, sf_dir))
    last = table(spark, sf_dir, "nation").agg(F.max("n_name")).first()[0]
    return vocab.find_label(paths, "Supplier#000000007").select("thesaurus_id", "node_id").unionByName(vocab.find_label(paths, last).select("thesaurus_id", "node_id"))


@query(
    """SELECT s_suppkey, array_to_string(list_filter(['d' || s_suppkey || '.pdf:PDF', CASE WHEN s_suppkey % 2 = 0 THEN 'h.html:HTML' END, CASE WHEN s_suppkey % 3 = 0 THEN 'noext:BIN' WHEN s_suppkey % 3 = 1 THEN repeat('n', 255) || ':DOC' END], lambda x: x IS NOT NULL), ',') AS attached,
  CASE WHEN s_suppkey % 4 > 0 THEN 'p' || s_suppkey END AS link, sha256('content ' || s_suppkey) AS document_hash, CAST(s_suppkey * 86400 AS BIGINT) AS registry_date FROM supplier"""
)
def push_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    files = plan.attachments(F.concat(F.lit("d"), k, F.lit(".pdf")), F.when(k % 2 == 0, "h.html").otherwise(""), F.when(k % 3 == 0, "noext").when(k % 3 == 1, F.lit("n" * 300 + ".doc")).otherwise(""))
    rows = table(spark, sf_dir, "supplier").select(k, files.alias("files"), F.when(k % 4 > 0, F.concat(F.lit("p"), k)).alias("primary_shared_id"), F.concat(F.lit("content "), k).cast("binary").alias("content"))
    sent = plan.registry_enrich(rows, now=F.timestamp_seconds(k * 86400))
    return sent.select(
        "s_suppkey", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["filename"], f["kind"])), ",").alias("attached"), F.get(F.col("registry_link"), F.lit(0))["value"].alias("link"), "document_hash", "registry_date"
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'a key is missing' WHEN 1 THEN 'a step took too long' WHEN 2 THEN NULL WHEN 3 THEN 'an answer was not JSON' WHEN 4 THEN 'nothing listens there' ELSE 'a package is missing' END AS diagnosis,
  CASE o_orderkey % 6 WHEN 0 THEN 'KeyError: x' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN NULL WHEN 3 THEN 'ValueError: y' WHEN 4 THEN 'ConnectionRefusedError: z' ELSE 'ModuleNotFoundError: w' END AS line FROM orders"""
)
def run_diagnoses(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    output = (
        F.when(k == 0, "Traceback\nValueError: first\nKeyError: x\nend")
        .when(k == 1, "TimeoutError")
        .when(k == 2, "  KeyErro: none\nall is well")
        .when(k == 3, "json JSONDecodeError in text\nValueError: y")
        .when(k == 4, "a\nConnectionRefusedError: z")
        .otherwise("ModuleNotFoundError: w\n ValueError: indented")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", lint.diagnosis(output).alias("diagnosis"), lint.error_line(output).alias("line"))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN 'pagination' WHEN event_id % 7 IN (2, 3, 4) THEN 'filter' ELSE 'other' END AS kind FROM events"""
)
def interactive_kinds(spark, sf_dir):
    k = F.col("event_id") % 7
    text = F.when(k == 0, F.concat(F.lit(" "), (F.col("event_id") % 90 + 1))).when(k == 2, "Sort By").otherwise("Open")
    attrs = F.when(k == 1, "btn next-page").when(k == 3, "card-Filter x").otherwise("plain")
    tag = F.when(k == 4, "select").otherwise("a")
    return table(spark, sf_dir, "events").select("event_id", html.classify_interactive(tag, text, attrs).alias("kind"))


@query(
    """WITH c AS (SELECT user_id % 50 AS page, user_id // 50 AS snap, event_id AS pos, event_type || (event_id % 40) AS card FROM events)
SELECT page, snap, pos, card FROM (SELECT *, row_number() OVER (PARTITION BY page, card ORDER BY snap DESC, pos DESC) AS nth FROM c) WHERE nth = 1"""
)
def snapshot_cards(spark, sf_dir):
    cards = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("page"), F.floor(F.col("user_id") / 50).alias("snap"), F.col("event_id").alias("pos"), F.concat("event_type", F.col("event_id") % 40).alias("card"))
    return html.consolidate_snapshots(cards)


@query("""SELECT field, CASE field WHEN 'k0' THEN 'code' WHEN 'k1' THEN 'short' ELSE 'string' END AS value_type FROM (SELECT DISTINCT 'k' || (p_partkey % 3) AS field FROM part)""")
def value_types_custom(spark, sf_dir):
    """A user's own kinds of values, tried in order."""
    k = F.col("p_partkey")
    samples = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), k % 3).alias("field"), F.when(k % 3 == 0, F.concat(F.lit("AB-"), k)).when(k % 3 == 1, F.left("p_name", F.lit(3))).otherwise(F.concat("p_name", F.lit(" and more of it"))).alias("value"))
    return catalog.value_types(samples, {"code": lambda v: v.rlike("^[A-Z]{2}-[0-9]+$"), "short": lambda v: F.length(v) <= 3})


@query(
    f"""WITH {B.DL_SQL}, {B.FILES_SQL}, {B.LINKS_SQL}, r AS (SELECT source_url AS url, CASE WHEN status = 'no_files' THEN NULL WHEN status IN ('failed', 'load_failed') OR trim(filename) = '' THEN 'download_failed' WHEN filename NOT IN (SELECT basename FROM files) THEN 'file_missing' END AS reason FROM dl)
SELECT url, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT url, 'pending' FROM links WHERE status = 'discovered'"""
)
def refresh_assessment(spark, sf_dir):
    return store.refresh_assessment(B.downloads(spark, sf_dir), B.file_listing(spark, sf_dir), store.fold_links(B.link_events(spark, sf_dir)))
