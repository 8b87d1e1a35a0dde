"""Dates, numbers and schemaless JSON payloads as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.urls import let, strip

ANY_MAP = "map<string,string>"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy")


def coerce_date(text: Column) -> Column:
    """ISO date of the first format that fits; other text passes through; null and empty give null."""
    return let(text, _iso_date)


def _iso_date(text: Column) -> Column:
    s = strip(text)
    shapes = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$")
    tries = [F.when(s.rlike(shape), F.try_to_date(s, fmt)) for shape, fmt in zip(shapes, DATE_FORMATS, strict=True)]
    return F.when(s == "", None).otherwise(F.coalesce(*(t.cast("string") for t in tries), text))


def looks_like_date(text: Column) -> Column:
    """ISO date or time, or numbers joined by ``-`` or ``/`` (blanks between them allowed)."""
    iso = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    shape = iso.rlike(r"^\d{4}-?\d{2}-?\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,6})?)?)?(?:[+-]\d{2}:?\d{2})?)?$")
    valid = F.try_to_date(F.regexp_replace(F.regexp_extract(iso, r"^(\d{4}-?\d{2}-?\d{2})", 1), "-", ""), "yyyyMMdd").isNotNull()
    joined = F.replace(text, F.lit("/"), F.lit("-")).rlike(r"^\d*(?:-\d*)+$")
    return (F.length(text) > 0) & ((shape & valid) | joined)


def looks_like_number(text: Column) -> Column:
    """What a float parser takes once commas are out: signs, exponents, inf and nan, single underscores."""
    s = F.lower(strip(F.replace(text, F.lit(","), F.lit(""))))
    digits = r"\d+(?:_\d+)*"
    return (F.length(text) > 0) & s.rlike(rf"^[+-]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?|inf(?:inity)?|nan)$")


def decode_object(data: Column) -> Column:
    """A JSON object as a map of texts; bad JSON, null and other JSON values as the empty map."""
    return F.coalesce(F.from_json(data, ANY_MAP), F.create_map().cast(ANY_MAP))


def get_or_blank(data: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(data, f"$.{key}"), F.lit(""))


def non_empty(value: Column) -> Column:
    """Null for what a source rule skips: null, the empty text and the empty list; 0 and false stay."""
    return F.when((value != "") & (value != "[]"), value)


def coalesce_sources(payload: Column, keys: list[str]) -> Column:
    """The first value among keys of a decoded payload that is not empty."""
    return F.coalesce(*(non_empty(payload[k]) for k in keys))


def sorted_keys(payload: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(payload)), ", ")


def python_text(value: Column) -> Column:
    """JSON scalars as Python prints them: booleans get a capital."""
    return F.when(value == "true", "True").when(value == "false", "False").otherwise(value)


def fingerprint(mapping: Column) -> Column:
    """SHA-256 of a map's JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping)))), 256)


def list_items(value: Column) -> Column:
    """A JSON list's elements as texts, any other value as a list of itself; null stays null."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value))
