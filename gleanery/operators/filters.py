"""Row filters by patterns and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import normalize_text


def _any(value: Column, patterns: list[str]) -> Column:
    """Whole-text match of any pattern, without regard to case."""
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(f"(?i)^(?:{p})$")
    return out


def keep_drop(rows: DataFrame, column: str, keep: list[str] | None = None, drop: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows whose normalised text fits a ``keep`` pattern and no ``drop`` pattern.

    Without patterns all rows stay; an empty ``keep`` list drops all.
    """
    value = normalize_text(F.col(column))
    wanted = F.lit(True) if keep is None else _any(value, keep)
    good = wanted & ~_any(value, drop or [])
    return rows.where(good), rows.where(~good)


def holds_text(value: Column, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(needle.lower()))


def within(index: Column, lo: int | None, hi: int | None) -> Column:
    """Inclusive range; rows without an index stay."""
    fits = F.lit(True)
    if lo is not None:
        fits = fits & (index >= lo)
    if hi is not None:
        fits = fits & (index <= hi)
    return index.isNull() | fits
