"""Prefix joins of long keys: a range join of sorted keys that gives a least partner, with one row a key whatever its length.

Keys that start with a key ``a`` follow it without a gap in the order of all keys. So the distinct keys are dealt by range, and each part is read in
order with a stack of the keys that the current one starts with: a key hands its least partner up when it is closed, and takes the least
of those below it on the stack. The stack is no deeper than a key is long, and nothing else is held. A key is also sent to those later parts
whose first key starts with it, so what it finds there counts, too. Suffixes are prefixes of reversed texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys a part, and keys of the sample that the ranges are cut from: 16 a part up to a thousand parts.
PART_KEYS = 1 << 17
SAMPLE = 1 << 14
KEYS = "key string, partner bigint, asked boolean, upward boolean, part int"


def _bounds(rows: DataFrame, part_keys: int) -> list[str]:
    """First keys of all parts but the first, out of a bounded sample by hash."""
    n = rows.count()
    parts = min(-(-n // part_keys), SAMPLE // 16)
    if parts < 2:
        return []
    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).select("key").distinct()
    sample = sorted(few.toArrow().column(0).to_pylist())
    return sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []


def _dealt(bounds: list[str]):
    """Each key in its part, and in the later ones whose first key starts with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for row, key in enumerate(batch.column(0).to_pylist()):
                part = bisect_right(bounds, key)
                rows.append(row)
                parts.append(part)
                while part < len(bounds) and bounds[part].startswith(key):
                    part += 1
                    rows.append(row)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(parts, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, partner, asked, upward, part) in order of part and key: (key, partner) of those asked, the least found."""
    stack: list[list] = []  # key, asked, upward, least partner of the keys that start with it, least partner of it and those it starts with
    found: list[tuple] = []
    last = None

    def close() -> None:
        key, asked, upward, inner, outer = stack.pop()
        if stack:
            stack[-1][3] = _least(stack[-1][3], inner)
        best = _least(inner, outer) if upward else inner
        if asked and best is not None:
            found.append((key, best))

    def flushed() -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ((), ())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()), strict=True)], names=["key", "partner"])
        found.clear()
        return out

    for batch in batches:
        for key, partner, asked, upward, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and (part != last or not key.startswith(stack[-1][0])):
                close()
            last = part
            stack.append([key, asked, upward, partner, _least(partner, stack[-1][4] if stack else None)])
        yield flushed()
    while stack:
        close()
    yield flushed()


def least_partners(probes: DataFrame, records: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """(key, partner) of probes (key, upward): the least partner of the records (key, partner) whose key starts with it, or, upward, also the other way round.

    Null keys match nothing, and an empty key is one that all others start with. Keys without a partner give no row. A key's ``upward`` is one and the same in all rows.
    """
    asked = probes.where("key is not null").select("key", F.lit(None).cast("bigint").alias("partner"), F.lit(True).alias("asked"), "upward")
    known = records.where("key is not null").select("key", F.col("partner").cast("bigint").alias("partner"), F.lit(False).alias("asked"), F.lit(False).alias("upward"))
    rows = asked.unionByName(known)
    keys = rows.groupBy("key").agg(F.min("partner").alias("partner"), F.bool_or("asked").alias("asked"), F.bool_or("upward").alias("upward"))
    bounds = _bounds(rows, part_keys)
    parted = keys.mapInArrow(_dealt(bounds), KEYS).repartition(len(bounds) + 1, "part") if bounds else keys.withColumn("part", F.lit(0)).coalesce(1)
    return parted.sortWithinPartitions("part", "key").mapInArrow(_matched, "key string, partner bigint").groupBy("key").agg(F.min("partner").alias("partner"))
