"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for local sessions that name none, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one the context was told.

    A local session without either gets one of its own; a cluster must name one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = FALLBACK_DIR
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A list of short rows goes to all executors up to this many; a longer one is shuffled.
BROADCAST_ROWS = 1 << 21


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most that many rows; they are counted, so give a stored df."""
    return F.broadcast(df) if df.count() <= most else df


#: Arrow batches end at this size however long the texts are: it bounds what a worker holds at once.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size; the setting is the session's, and is left as it is needed later."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_arrow(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return in_arrow(df.select(*columns), fn, schema)


def spare_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with none of ``taken``."""
    lower = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        out.append(name)
    return out


def whole_text(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes over the given columns: rows alike in them share a key, nulls included."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(17), *cols[::-1]).alias("k2")]


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def put_file(uri: str, data) -> None:
    """Write whole, then rename: a task that runs twice leaves one complete file."""
    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(data)


def open_mapped(uri: str):
    """A read-only memory map of a shared file; from other stores through an unlinked local copy."""
    import mmap

    path = local_path(uri)
    if path:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(inner) as src, tempfile.TemporaryFile() as f:
        while block := src.read(1 << 22):
            f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b""
