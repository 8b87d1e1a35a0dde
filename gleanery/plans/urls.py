"""Queries on URL identity and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import urls as U
from gleanery.operators.filters import keep_drop
from gleanery.plans.registry import query
from gleanery.session import table

_RX = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?'"


def _canon(u: str, query_sql: str = "q", loopback: bool = False) -> str:
    return f"""(SELECT CASE WHEN s IN ('http', 'https') THEN 'https' ELSE s END || '://' || lower(n)
      || replace(replace(replace(url_encode(url_decode(replace(p, '+', '%2B'))), '%2F', '/'), '%40', '@'), '%25', '%')
      || CASE WHEN q <> '' THEN '?' || {query_sql} ELSE '' END
   FROM (SELECT lower(regexp_extract({u}, {_RX}, 1)) AS s, regexp_extract({u}, {_RX}, 2) AS n, regexp_extract({u}, {_RX}, 3) AS p, regexp_extract({u}, {_RX}, 4) AS q))"""


_SORTED = "array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&')"


@query(f"SELECT page_id, {_canon('url')} AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(
    f"""SELECT page_id, 'pdf_' || substr(sha1(c), 1, 12) AS pdf_id, 'doc_' || substr(sha1(c), 1, 12) AS doc_id, 'pdf_' || substr(sha1(c), 1, 12) || '.pdf' AS pdf_filename,
  'html_' || substr(sha1(c), 1, 12) || '.html' AS html_filename, 'doc_' || substr(sha1(c), 1, 12) || '.bin' AS file_filename
FROM (SELECT page_id, {_canon("url")} AS c FROM pages)"""
)
def url_ids(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.pdf_id(u).alias("pdf_id"), U.doc_id(u).alias("doc_id"), U.pdf_filename(u).alias("pdf_filename"), U.html_filename(u).alias("html_filename"), U.file_filename(u).alias("file_filename")
    )


@query(f"SELECT page_id, {_canon('u', _SORTED)} AS normalized FROM (SELECT page_id, url || CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN '' ELSE '?z=1&a=2&&m=' || page_id END AS u FROM pages)")
def url_normalize_sorted_query(spark, sf_dir):
    u = F.when(F.col("url").rlike("[?#]"), F.col("url")).otherwise(F.concat("url", F.lit("?z=1&a=2&&m="), "page_id"))
    return table(spark, sf_dir, "pages").select("page_id", U.normalized_url(u).alias("normalized"))


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'normalized' WHEN 1 THEN 'suffix' ELSE 'none' END AS mode FROM pages"""
)
def url_match_modes(spark, sf_dir):
    u, i = F.col("url"), F.col("page_id")
    stored = F.when(i % 3 == 0, F.regexp_replace(U.canonical_url(u), "^https", "HTTP")).when(i % 3 == 1, F.regexp_replace(u, "^https?://", "")).otherwise(F.concat(F.lit("https://other.example/x/"), i))
    return table(spark, sf_dir, "pages").select("page_id", U.match_mode(u, stored).alias("mode"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '.doc' WHEN 4 THEN '.xls' ELSE '' END AS ext,
  CASE doc_id % 6 WHEN 1 THEN '.doc' WHEN 4 THEN '.xls' ELSE '.bin' END AS stored_ext FROM documents"""
)
def file_ext_classify(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, (".pdf", ".DOC", ".docx/x", "/", ".xls?x=1", ".html"))), (F.col("doc_id") % 6 + 1).cast("int"))
    u = F.concat(F.lit("https://h.example/f/"), "doc_id", tail)
    return table(spark, sf_dir, "documents").select("doc_id", U.file_ext(u).alias("ext"), F.regexp_extract(U.file_filename(u), r"(\.\w+)$", 1).alias("stored_ext"))


@query("SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]+)', 1) AS origin, (url LIKE '%.html') AS is_html FROM pages")
def url_origin(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.origin(F.col("url")).alias("origin"), F.col("url").endswith(".html").alias("is_html"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normal, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def text_normalize_tokens(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(t).alias("normal"), T.estimate_tokens(t).alias("tokens"))


@query(
    f"""SELECT doc_id, array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: w NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)})), 1, 20), ' ') AS words FROM documents"""
)
def text_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("words"))


@query(
    r"""SELECT doc_id, CASE WHEN m <> '' THEN rtrim(m, ' ' || chr(10)) ELSE substr(text, 1, 200) END AS sentence, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS short
FROM (SELECT doc_id, text, regexp_extract(text, '^([^.!?\n]+[.!?\n])', 1) AS m FROM documents)"""
)
def text_first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"), T.truncate(F.col("text"), 80).alias("short"))


@query(
    """SELECT p_type, CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS dropped
FROM (SELECT p_type, regexp_matches(lower(p_name), '^(small|red|blue) .*$') AND NOT regexp_matches(lower(p_name), '^.* ring$') AS kept FROM part) GROUP BY p_type"""
)
def filter_rows_keep_drop(spark, sf_dir):
    kept, dropped = keep_drop(table(spark, sf_dir, "part"), "p_name", keep=["(SMALL|RED|BLUE) .*"], drop=[".* ring"])
    both = kept.select("p_type", F.lit(1).alias("k")).unionByName(dropped.select("p_type", F.lit(0).alias("k")))
    return both.groupBy("p_type").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("dropped"))
