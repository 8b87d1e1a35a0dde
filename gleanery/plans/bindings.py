"""How the driver's tables stand in for the library's relations, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import table

#: rec: records out of events, one payload each; keys repeat by user.
REC_SQL = """rec AS (
  SELECT 'https://h.example/u/' || user_id AS source_url, event_id AS _seq, event_type,
         CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value, json_extract_string(props, '$.k') AS k
  FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_url, _seq, data): events as records."""
    e = table(spark, sf_dir, "events")
    payload = F.struct(F.col("event_type"), F.col("value").cast("decimal(12,2)").cast("string").alias("value"), F.get_json_object("props", "$.k").alias("k"))
    return e.select(F.concat(F.lit("https://h.example/u/"), F.col("user_id")).alias("source_url"), F.col("event_id").alias("_seq"), F.to_json(payload).alias("data"))


#: lev: link events by user.
LEV_SQL = """lev AS (
  SELECT 'https://h.example/u/' || user_id AS url, event_id AS _seq, 'b' || (event_id % 7) AS filter_label,
         CASE WHEN event_type = 'click' THEN 'discovered' WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'processed' ELSE 'sample' END AS op
  FROM events)"""

#: links: the folded queue.
LINKS_SQL = (
    LEV_SQL
    + """, ins AS (SELECT url, min(_seq) AS s0 FROM lev WHERE op <> 'processed' GROUP BY url),
pro AS (SELECT l.url, min(l._seq) AS ps FROM lev l JOIN ins i ON l.url = i.url WHERE l.op = 'processed' AND l._seq > i.s0 GROUP BY l.url),
live AS (
  SELECT l.* FROM lev l JOIN ins i ON l.url = i.url LEFT JOIN pro p ON l.url = p.url
  WHERE l.op <> 'processed' AND (p.ps IS NULL OR l._seq < p.ps) AND (l.op = 'discovered' OR l._seq = i.s0)),
links AS (
  SELECT i.url, CASE WHEN max(p.ps) IS NOT NULL THEN 'processed' ELSE arg_max(v.op, v._seq) END AS status, arg_max(v.filter_label, v._seq) AS filter_label
  FROM ins i JOIN live v ON i.url = v.url LEFT JOIN pro p ON i.url = p.url GROUP BY i.url)"""
)


def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = (F.col("event_type") == "purchase") & (F.col("event_id") % 40 == 0)
    op = F.when(F.col("event_type") == "click", "discovered").when(ends, "processed").otherwise("sample")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://h.example/u/"), F.col("user_id")).alias("url"), op.alias("op"), F.concat(F.lit("b"), F.col("event_id") % 7).alias("filter_label"), F.col("event_id").alias("_seq")
    )


#: dl: download records, one for each event; f: their files.
DL_SQL = """dl AS (
  SELECT 'https://h.example/d/' || event_id AS source_url, event_id AS _seq,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE 'https://h.example/f/' || (event_id % 900) || CASE event_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.doc' ELSE '' END END AS file_url,
         CASE event_type WHEN 'click' THEN 'downloaded' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'no_files' WHEN 'view' THEN 'load_failed' ELSE '' END AS status,
         CASE WHEN value > 20 THEN 'f' || json_extract_string(props, '$.k') ELSE '' END AS filename
  FROM events)"""


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_url, _seq, data) of download records."""
    e = table(spark, sf_dir, "events")
    ext = F.when(F.col("event_id") % 3 == 0, ".pdf").when(F.col("event_id") % 3 == 1, ".doc").otherwise("")
    url = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("https://h.example/f/"), F.col("event_id") % 900, ext))
    kind = F.col("event_type")
    status = F.when(kind == "click", "downloaded").when(kind == "error", "failed").when(kind == "purchase", "no_files").when(kind == "view", "load_failed").otherwise("")
    name = F.when(F.col("value") > 20, F.concat(F.lit("f"), F.get_json_object("props", "$.k"))).otherwise("")
    payload = F.struct(url.alias("core_file_url"), status.alias("core_download_status"), name.alias("core_pdf_filename"))
    return e.select(F.concat(F.lit("https://h.example/d/"), F.col("event_id")).alias("source_url"), F.col("event_id").alias("_seq"), F.to_json(payload).alias("data"))


#: files: a listing whose names are those of some file URLs, with sizes and marks.
FILES_SQL = """files AS (
  SELECT CASE i % 3 WHEN 0 THEN 'pdf_' || substr(sha1('https://h.example/f/' || i || '.pdf'), 1, 12) || '.pdf'
                    WHEN 1 THEN 'doc_' || substr(sha1('https://h.example/f/' || i || '.doc'), 1, 12) || '.doc'
                    ELSE 'pdf_' || substr(sha1('https://h.example/f/' || i), 1, 12) || '.pdf' END AS basename,
         CASE WHEN i % 10 = 1 THEN 0 ELSE 1000 + (i % 50) * 10 END AS length,
         CASE WHEN i % 3 = 1 THEN i % 10 <> 1 ELSE i % 4 <> 0 END AS is_valid
  FROM (SELECT DISTINCT p_partkey AS i FROM part)
  UNION ALL
  SELECT 'extra_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.pdf.part' END, 5000 + p_partkey, true
  FROM part)"""


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basename, length, is_valid, is_small) as byte checks would give them."""
    from gleanery.functions.urls import expected_filename

    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    ext = F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".doc").otherwise("")
    listed = p.select("p_partkey").distinct().select(
        expected_filename(F.concat(F.lit("https://h.example/f/"), i, ext)).alias("basename"),
        F.when(i % 10 == 1, 0).otherwise(1000 + (i % 50) * 10).cast("bigint").alias("length"),
        F.when(i % 3 == 1, i % 10 != 1).otherwise(i % 4 != 0).alias("is_valid"),
    )
    tail = F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".PDF").otherwise(".pdf.part")
    extra = p.select(F.concat(F.lit("extra_"), i, tail).alias("basename"), (5000 + i).cast("bigint").alias("length"), F.lit(True).alias("is_valid"))
    return listed.unionByName(extra).withColumn("is_small", F.col("is_valid") & (F.col("length") <= 1024))
