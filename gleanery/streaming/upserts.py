"""A last-wins table fed by a stream: small deltas, compacted into hash buckets that a manifest names.

Layout below the table's folder: ``delta/epoch=N`` holds what micro-batch N brought, one row a key; ``base-V`` holds the folded rows, one
file a bucket; ``manifest/v=V`` is one row that names a base, its buckets and the last epoch in it. A manifest is written after its base is whole, and readers
take the newest one, so a compaction that dies leaves the table as it was, and its next try writes the same folder anew. An epoch that is
tried again after it was folded only rewrites a delta that readers pass over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.store import last_wins
from gleanery.sources.readers import read_or_empty

MANIFEST = "base string, buckets int, upto bigint, v bigint"


def manifest(spark: SparkSession, path: str) -> tuple[str | None, int, int, int]:
    """(base, buckets, last epoch in it, version) of the newest manifest; without any there is no base, and no epoch is folded."""
    row = read_or_empty(spark, f"{path}/manifest", MANIFEST).orderBy(F.desc("v")).limit(1).collect()
    return (row[0]["base"], row[0]["buckets"], row[0]["upto"], row[0]["v"]) if row else (None, 0, -1, 0)


def write_delta(batch: DataFrame, epoch: int, path: str, key: str = "source_url") -> None:
    """The rows of one micro-batch, the last of each key; a repeated try overwrites its own folder."""
    last_wins(batch, key).write.mode("overwrite").parquet(f"{path}/delta/epoch={epoch}")


def _deltas(spark: SparkSession, path: str, schema: str, after: int) -> DataFrame:
    """Deltas of later epochs; the epoch is a partition, so folded ones are not opened."""
    return read_or_empty(spark, f"{path}/delta", f"{schema}, epoch bigint").where(F.col("epoch") > after)


def _base(spark: SparkSession, path: str, schema: str, base: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{base}").drop("bucket")


def compact(spark: SparkSession, path: str, schema: str, buckets: int, key: str = "source_url") -> None:
    """Folds the base and all later deltas into a new base of so many buckets, then names it."""
    base, _, upto, v = manifest(spark, path)
    deltas = _deltas(spark, path, schema, upto)
    last = deltas.agg(F.max("epoch")).first()[0]
    if last is None:
        return
    rows = deltas.where(F.col("epoch") <= last).drop("epoch")
    if base:
        rows = rows.unionByName(_base(spark, path, schema, base))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    folded = last_wins(rows, key).select("*", bucket).repartition(buckets, "bucket")
    name = f"base-{v + 1}"
    folded.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    named = spark.range(1).select(F.lit(name).alias("base"), F.lit(buckets).alias("buckets"), F.lit(last).cast("bigint").alias("upto"))
    named.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={v + 1}")


def latest(spark: SparkSession, path: str, schema: str, key: str = "source_url") -> DataFrame:
    """The last row of each key. Right after a compaction that is the base as it lies, a file a bucket; else deltas of later epochs go over it."""
    base, _, upto, _ = manifest(spark, path)
    deltas = _deltas(spark, path, schema, upto).drop("epoch")
    if base is None:
        return last_wins(deltas, key)
    folded = _base(spark, path, schema, base)
    return folded if deltas.isEmpty() else last_wins(folded.unionByName(deltas), key)


def upsert_stream(records: DataFrame, path: str, checkpoint: str, key: str = "source_url", buckets: int = 64, every: int = 32):
    """Writes a stream of records to the table and compacts it every so many epochs; :func:`latest` reads it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)

    def write(batch: DataFrame, epoch: int) -> None:
        write_delta(batch, epoch, path, key)
        if (epoch + 1) % every == 0:
            compact(batch.sparkSession, path, schema, buckets, key)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
