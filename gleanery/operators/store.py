"""The record store: last-wins upsert, the link state machine, queues for retry and refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.urls import canonical_url
from gleanery.functions.values import get_or_blank


def last_wins(rows: DataFrame, key: str, order: str = "_seq") -> DataFrame:
    """The last whole row of each key; one aggregation with map-side combine, no sort."""
    others = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
    return picked.select(key, *(F.col(f"_row.{c}").alias(c) for c in others)).select(*rows.columns)


def upsert_records(events: DataFrame, key: str = "source_url", order: str = "_seq") -> DataFrame:
    """Replace by canonical key: the row with the largest ``order`` stays whole."""
    return last_wins(events.withColumn(key, canonical_url(F.col(key))), key, order)


def in_time_order(records: DataFrame) -> DataFrame:
    """Records as they were scraped, later writes last among equals."""
    return records.orderBy("scraped_at", "_seq")


def canonical_payload(payload: Column) -> Column:
    """A decoded payload with its file URL in canonical form."""
    return F.transform_values(payload, lambda k, v: F.when(k == "core_file_url", canonical_url(v)).otherwise(v))


def fold_links(events: DataFrame) -> DataFrame:
    """(url, status, filter_label) after replaying link events (url, op, filter_label, _seq) in order.

    A first event that is not ``processed`` inserts. Later ``sample`` events are ignored, ``discovered``
    ones refresh the label and status, ``processed`` ends it; a ``processed`` before any insert does nothing.
    """
    # Of an end only the first behind the insert matters, so one pass gives the insert and a second the rest; rows
    # meet by url in both, whose aggregates are partial on the map side, and nothing is sorted.
    seq, ends = F.col("_seq"), F.col("op") == "processed"
    begun = events.groupBy("url").agg(F.min(F.when(~ends, seq)).alias("s0")).where("s0 is not null")
    ended = events.where(ends).join(begun, "url").where("_seq > s0").groupBy("url").agg(F.min("_seq").alias("ps"))
    spans = begun.join(ended, "url", "left")
    live = events.where(~ends).join(spans, "url").where("(ps is null or _seq < ps) and (op = 'discovered' or _seq = s0)")
    last = live.groupBy("url").agg(F.max("ps").alias("ps"), F.max(F.struct("_seq", "op", "filter_label")).alias("l"))
    return last.select("url", F.when(F.col("ps").isNotNull(), "processed").otherwise(F.col("l.op")).alias("status"), F.col("l.filter_label").alias("filter_label"))


def pending_links(links: DataFrame) -> DataFrame:
    return links.where("status = 'discovered'").select("url", "filter_label")


def links_by_label(links: DataFrame) -> DataFrame:
    return links.groupBy("filter_label").agg(F.count("*").alias("n"))


def preseed_links(links: DataFrame, seeds: DataFrame, status: str = "sample") -> DataFrame:
    """links with the seeds (url, filter_label, _seq) it does not hold yet; the first of a url wins."""
    first = seeds.groupBy("url").agg(F.min_by("filter_label", "_seq").alias("filter_label"))
    fresh = first.join(links.select("url"), "url", "left_anti")
    return links.select("url", "status", "filter_label").unionByName(fresh.withColumn("status", F.lit(status)))


def new_links(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.join(before.select("url"), "url", "left_anti")


def wants_retry(data: Column) -> Column:
    """Failed downloads and rows without a file name, unless the page has no files."""
    status, name = get_or_blank(data, "core_download_status"), get_or_blank(data, "core_pdf_filename")
    return (status != "no_files") & ((status == "failed") | (name == ""))


def refresh_reasons(records: DataFrame, files: DataFrame) -> DataFrame:
    """(source_url, reason) of records whose file must be fetched again: download_failed or file_missing."""
    status, name = get_or_blank(F.col("data"), "core_download_status"), get_or_blank(F.col("data"), "core_pdf_filename")
    rows = records.select("source_url", status.alias("status"), name.alias("basename"))
    on_disk = files.select("basename").distinct().withColumn("on_disk", F.lit(True))
    reason = (
        F.when(F.col("status") == "no_files", None)
        .when(F.col("status").isin("failed", "load_failed") | (F.trim("basename") == ""), "download_failed")
        .when(F.col("on_disk").isNull(), "file_missing")
    )
    return rows.join(on_disk, "basename", "left").select("source_url", reason.alias("reason")).where("reason is not null")


def refresh_assessment(records: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """(url, reason): all that a refresh has to do, files to fetch again and links still pending; nothing to do gives no row."""
    again = refresh_reasons(records, files).select(F.col("source_url").alias("url"), "reason")
    return again.unionByName(pending_links(links).select("url", F.lit("pending").alias("reason")))


def handled_keys(source_url: Column) -> Column:
    """A record's url and each base before a ``/pdf/`` in it: what a link may equal to count as handled."""
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(source_url), F.lit(1))), lambda n: F.substr(source_url, n, F.lit(5)) == "/pdf/")
    return F.concat(F.array(source_url), F.transform(cuts, lambda n: F.left(source_url, n - 1)))


def split_pending(links: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending links no record handles, and those that one does (stale); an equi join, not a prefix loop."""
    keys = records.select(F.explode(handled_keys(F.col("source_url"))).alias("url")).distinct()
    pending = links.where("status = 'discovered'")
    return pending.join(keys, "url", "left_anti"), pending.join(keys, "url", "left_semi")
