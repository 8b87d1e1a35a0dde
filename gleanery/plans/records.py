"""Queries on the record store and its queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import reconcile, store
from gleanery.plans import bindings as B
from gleanery.plans.registry import query
from gleanery.session import table


@query(f"WITH {B.REC_SQL} SELECT source_url, _seq, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY _seq DESC) AS rn FROM rec) WHERE rn = 1")
def record_upsert_latest(spark, sf_dir):
    rows = store.upsert_records(B.records(spark, sf_dir))
    return rows.select("source_url", "_seq", *(F.get_json_object("data", f"$.{k}").alias(k) for k in ("event_type", "value", "k")))


@query(f"WITH {B.LINKS_SQL} SELECT url, status, filter_label FROM links")
def link_state_fold(spark, sf_dir):
    return store.fold_links(B.link_events(spark, sf_dir))


@query(f"WITH {B.LINKS_SQL} SELECT url, filter_label FROM links WHERE status = 'discovered'")
def link_pending(spark, sf_dir):
    return store.pending_links(store.fold_links(B.link_events(spark, sf_dir)))


@query(f"WITH {B.LINKS_SQL} SELECT filter_label, count(*) AS n FROM links GROUP BY filter_label")
def link_counts_by_label(spark, sf_dir):
    return store.links_by_label(store.fold_links(B.link_events(spark, sf_dir)))


_SEEDS = """seeds AS (SELECT 'https://h.example/u/' || c_custkey AS url, c_mktsegment AS filter_label, c_custkey AS _seq FROM customer)"""


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("https://h.example/u/"), "c_custkey").alias("url"), F.col("c_mktsegment").alias("filter_label"), F.col("c_custkey").alias("_seq"))


@query(
    f"""WITH {B.LINKS_SQL}, {_SEEDS}
SELECT url, status, filter_label FROM links UNION ALL SELECT url, 'sample', filter_label FROM seeds WHERE url NOT IN (SELECT url FROM links)"""
)
def preseed_insert_ignore(spark, sf_dir):
    return store.preseed_links(store.fold_links(B.link_events(spark, sf_dir)), _seeds(spark, sf_dir))


@query(f"WITH {B.LINKS_SQL}, {_SEEDS} SELECT url, filter_label FROM seeds WHERE url NOT IN (SELECT url FROM links)")
def link_new_across_runs(spark, sf_dir):
    return store.new_links(_seeds(spark, sf_dir).select("url", "filter_label"), store.fold_links(B.link_events(spark, sf_dir)))


@query(f"WITH {B.DL_SQL} SELECT source_url FROM dl WHERE status <> 'no_files' AND (status = 'failed' OR filename = '')")
def retry_queue(spark, sf_dir):
    return B.downloads(spark, sf_dir).where(store.wants_retry(F.col("data"))).select("source_url")


@query(
    f"""WITH {B.DL_SQL}, have AS (SELECT DISTINCT 'f' || (p_partkey * 2) AS basename FROM part)
SELECT source_url, reason FROM (
  SELECT source_url, CASE WHEN status = 'no_files' THEN NULL WHEN status IN ('failed', 'load_failed') OR trim(filename) = '' THEN 'download_failed'
                          WHEN filename NOT IN (SELECT basename FROM have) THEN 'file_missing' END AS reason FROM dl) WHERE reason IS NOT NULL"""
)
def refresh_gap_reason(spark, sf_dir):
    have = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey") * 2).alias("basename"))
    return store.refresh_reasons(B.downloads(spark, sf_dir), have)


_HANDLED = f"""WITH {B.LINKS_SQL}, src AS (
  SELECT 'https://h.example/u/' || (o_custkey * 2) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/pdf/pdf_' || o_orderkey ELSE '/page/' || o_orderkey END AS source_url FROM orders)
SELECT url, EXISTS (SELECT 1 FROM src WHERE source_url = url OR starts_with(source_url, url || '/pdf/')) AS stale FROM links WHERE status = 'discovered'"""


@query(_HANDLED)
def unprocessed_vs_stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tail = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/pdf/pdf_"), "o_orderkey")).otherwise(F.concat(F.lit("/page/"), "o_orderkey"))
    src = o.select(F.concat(F.lit("https://h.example/u/"), F.col("o_custkey") * 2, tail).alias("source_url"))
    unhandled, stale = store.split_pending(store.fold_links(B.link_events(spark, sf_dir)), src)
    return unhandled.select("url", F.lit(False).alias("stale")).unionByName(stale.select("url", F.lit(True).alias("stale")))


@query(
    f"""WITH {B.DL_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE filename <> '') AS with_file, count(DISTINCT filename) FILTER (WHERE filename <> '') AS files,
  (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT 'task-' || (_seq % 12) AS t FROM dl)) AS slugs FROM dl"""
)
def run_summary(spark, sf_dir):
    rows = B.downloads(spark, sf_dir).withColumn("task_slug", F.concat(F.lit("task-"), F.col("_seq") % 12))
    return reconcile.run_summary(rows).withColumn("slugs", F.array_join("slugs", ","))
