"""Queries that go through stores: streams, the compacted table, logs and vocabularies written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.plans import bindings as B
from gleanery.plans.registry import query
from gleanery.session import SETTINGS, scratch_path, table, with_settings
from gleanery.sources import readers, writers
from gleanery.streaming import links, upserts

BATCHES = 3
#: A stream's state stays in as many partitions as it began with.
STATE_PARTITIONS = "8"


@query(f"WITH {B.LINKS_SQL} SELECT url, status, filter_label FROM links")
def links_streamed(spark, sf_dir):
    """All link events as a stream whose micro-batches come in no order; each batch's states go to a compacted table, whose last rows are the queue."""
    source, out = scratch_path(spark, "link-events"), scratch_path(spark, "link-table")
    events = B.link_events(spark, sf_dir)
    events.repartition(BATCHES, F.xxhash64("_seq")).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    states = links.fold_link_stream(stream)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in states.schema)

    def write(batch, epoch: int) -> None:
        upserts.write_delta(batch, epoch, out, "url")

    # The stream runs to its end here, so its settings hold for it alone.
    with with_settings(spark, spark_sql_shuffle_partitions=STATE_PARTITIONS, spark_sql_streaming_stateStore_providerClass=SETTINGS["spark.sql.streaming.stateStore.providerClass"]):
        run = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch_path(spark, "link-offsets")).trigger(availableNow=True).start()
        run.awaitTermination()
    upserts.compact(spark, out, schema, 8, "url")
    return upserts.latest(spark, out, schema, "url").select("url", "status", "filter_label")


@query(f"WITH {B.REC_SQL} SELECT source_url, _seq, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY _seq DESC) AS rn FROM rec) WHERE rn = 1")
def upsert_table(spark, sf_dir):
    """All records in six deltas that mix old and new, folded after four; one epoch is tried again after that."""
    path, rows = scratch_path(spark, "record-table"), B.records(spark, sf_dir)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    epoch = F.pmod(F.xxhash64("_seq"), F.lit(6))
    for n in (0, 1, 2, 3):
        upserts.write_delta(rows.where(epoch == n), n, path)
    upserts.compact(spark, path, schema, 8)
    for n in (2, 4, 5):
        upserts.write_delta(rows.where(epoch == n), n, path)
    return upserts.latest(spark, path, schema).select("source_url", "_seq", *(F.get_json_object("data", f"$.{k}").alias(k) for k in ("event_type", "value", "k")))


@query("SELECT r_name AS property_name, n_name AS crawl_value, CASE WHEN n_nationkey % 3 > 0 THEN 'c ' || n_name || ' \"q\"' END AS canonical_value FROM nation JOIN region ON n_regionkey = r_regionkey")
def vocabulary_round_trip(spark, sf_dir):
    path = scratch_path(spark, "vocabulary")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    canonical = F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("c "), "n_name", F.lit(' "q"')))
    writers.write_vocabulary(rows.select(F.col("r_name").alias("property_name"), F.col("n_name").alias("crawl_value"), canonical.alias("canonical_value")), path)
    return readers.read_vocabulary(spark, path).select("property_name", "crawl_value", "canonical_value")


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 5 = 0")
def json_log(spark, sf_dir):
    """Two appends to a log of JSON lines, and lines of another kind among them, which do not count."""
    path = scratch_path(spark, "log")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    writers.append_log(rows, path)
    writers.append_log(rows.where("event_id % 5 = 0"), path)
    rows.where("event_id % 7 = 0").select(F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit('{"event_id": broken '), "event_id")).alias("value")).write.mode("append").text(path)
    return readers.read_json_log(spark, path, "event_id bigint, event_type string")


@query(f"WITH {B.REC_SQL} SELECT source_url, max(_seq) AS _seq, count(*) FILTER (WHERE false) AS absent FROM rec WHERE _seq % 3 = 1 GROUP BY source_url")
def run_of_log(spark, sf_dir):
    """The last records of one run out of a log kept by run, compacted; and a table that is not there, as an empty one."""
    log, out = scratch_path(spark, "runs"), scratch_path(spark, "run")
    rows = B.records(spark, sf_dir).withColumns({"task_slug": F.concat(F.lit("run"), F.col("_seq") % 3), "scraped_at": F.timestamp_seconds(F.col("_seq"))})
    rows.write.partitionBy("task_slug").parquet(log)
    schema = "source_url string, scraped_at timestamp, data string, _seq bigint"
    one = readers.records_of_run(readers.read_or_empty(spark, log, f"{schema}, task_slug string"), "run1")
    one.write.parquet(f"{log}-one")
    writers.compact_records(spark, f"{log}-one", out, schema)
    absent = readers.read_or_empty(spark, f"{out}-none", schema)
    return spark.read.schema(schema).parquet(out).select("source_url", "_seq").join(absent.select("source_url", F.lit(1).alias("x")), "source_url", "left").select("source_url", "_seq", F.when(F.col("x").isNull(), 0).otherwise(1).cast("bigint").alias("absent"))
