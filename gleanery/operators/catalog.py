"""Profiles of schemaless payloads: coverage, samples, histograms and value types."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.values import decode_object, list_items, looks_like_date, looks_like_number, python_text
from gleanery.functions.urls import strip


def exploded_fields(records: DataFrame) -> DataFrame:
    """(_seq, field, value) for each key with a value that is neither null nor empty."""
    return records.select("_seq", F.explode(decode_object(F.col("data"))).alias("field", "value")).where("value is not null and value <> ''")


def exploded_values(records: DataFrame) -> DataFrame:
    """(_seq, field, pos, value): list elements one by one, stripped, blanks dropped."""
    cells = exploded_fields(records).select("_seq", "field", F.posexplode(list_items(F.col("value"))).alias("pos", "item"))
    return cells.select("_seq", "field", "pos", strip(python_text(F.col("item"))).alias("value")).where("value <> ''")


def exploded_deep(records: DataFrame) -> DataFrame:
    """(_seq, field, pos, value): every element of lists within lists, as Python prints it, stripped, blanks dropped.

    Payloads that are no objects have no fields. JSON of any depth needs a walk, done once a payload in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(seq, field, i, text) for seq, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for field, i, text in _walked(data)]
            cols = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.string(), pa.int32(), pa.string()), strict=True)], names=["_seq", "field", "pos", "value"])

    return records.select("_seq", "data").mapInArrow(run, f"_seq {records.schema['_seq'].dataType.simpleString()}, field string, pos int, value string")


def _walked(data: str | None) -> Iterator[tuple[str, int, str]]:
    try:
        payload = json.loads(data or "")
    except (ValueError, RecursionError):
        return
    for field, value in payload.items() if isinstance(payload, dict) else ():
        todo, i = [value], 0
        while todo:
            item = todo.pop()
            if isinstance(item, list):
                todo += item[::-1]
            elif item is not None and (text := str(item).strip()):
                yield field, i, text
                i += 1


def flattened(envelope: Column, payload: Column) -> Column:
    """One map of a row's own columns and its payload; the payload wins."""
    return F.map_concat(F.map_filter(envelope, lambda k, _: ~F.map_contains_key(payload, k)), payload)


def field_coverage(records: DataFrame) -> DataFrame:
    """(field, n): rows that carry each field."""
    return exploded_fields(records).groupBy("field").agg(F.countDistinct("_seq").alias("n"))


def top_fields(records: DataFrame, k: int = 60) -> DataFrame:
    """The k fields in most rows; ties by first appearance, then name."""
    counted = exploded_fields(records).groupBy("field").agg(F.countDistinct("_seq").alias("n"), F.min("_seq").alias("first_seq"))
    return counted.orderBy(F.desc("n"), "first_seq", "field").limit(k)


def first_samples(records: DataFrame, n: int = 5) -> DataFrame:
    """(field, rank, value): the first n distinct values of each field in scan order."""
    first = exploded_values(records).groupBy("field", "value").agg(F.min(F.struct("_seq", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy("at", "value"))
    return first.withColumn("rank", rank).where(F.col("rank") <= n).select("field", "rank", "value")


#: value type -> what each of its values must look like, in order of trial.
LOOKS: dict[str, Callable[[Column], Column]] = {"date": looks_like_date, "numeric": looks_like_number}


def value_types(samples: DataFrame, looks: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(field, value_type) by vote of its samples: the first type that all of them look like, else string."""
    kind = F.lit("string")
    for name, fits in reversed((looks or LOOKS).items()):
        kind = F.when(F.bool_and(fits(F.col("value"))), name).otherwise(kind)
    return samples.groupBy("field").agg(kind.alias("value_type"))


def value_histogram(records: DataFrame) -> DataFrame:
    return exploded_values(records).groupBy("field", "value").agg(F.count("*").alias("n"))


def merged_histogram(histogram: DataFrame, properties: DataFrame) -> DataFrame:
    """(property, value, n) summed over each property's source fields; its default tokens count once at least.

    ``properties``: (property, sources array, defaults array).
    """
    by_source = properties.select("property", F.explode("sources").alias("field")).join(histogram, "field").select("property", "value", "n")
    defaults = properties.select("property", F.explode("defaults").alias("value")).select("property", "value", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("least"))
    both = by_source.withColumn("least", F.lit(0)).unionByName(defaults)
    return both.groupBy("property", "value").agg(F.greatest(F.sum("n"), F.max("least").cast("bigint")).alias("n"))


def distribution(histogram: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` values of each field, and one row with how many more there are (value null)."""
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    ranked = histogram.withColumn("rank", rank)
    rest = ranked.where(F.col("rank") > top).groupBy("field").agg(F.count("*").alias("n")).select("field", F.lit(None).cast("string").alias("value"), "n")
    return ranked.where(F.col("rank") <= top).select("field", "value", "n").unionByName(rest)
