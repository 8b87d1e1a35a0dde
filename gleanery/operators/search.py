"""Relevance of earlier work to a task: weighted substring counts of its keywords."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import STOP_WORDS, substring_count

MOST_TERMS = 20
WEIGHTS = {"task_summary": 3, "subtask_description": 2, "site_overview": 1}


def relevance(rows: DataFrame, task: str, weights: dict[str, int] | None = None) -> DataFrame:
    """rows with score: for each keyword of the task, its occurrences times the column's weight.

    The task's keywords are constants, so each is a term of one expression over texts lower-cased once.
    """
    terms = [w for w in re.findall("[a-z]{4,}", task.lower()) if w not in STOP_WORDS][:MOST_TERMS]
    weights = weights or WEIGHTS
    lower = {c: f"_lower_{c}" for c in weights}
    staged = rows.withColumns({name: F.lower(F.coalesce(F.col(c), F.lit(""))) for c, name in lower.items()})
    score = F.lit(0).cast("bigint")
    for column, weight in weights.items():
        for term in terms:
            score = score + weight * substring_count(F.col(lower[column]), F.lit(term))
    return staged.withColumn("score", score).drop(*lower.values())


def top_relevant(rows: DataFrame, task: str, k: int = 8, ties: str = "_seq", weights: dict[str, int] | None = None, kind: str | None = None) -> DataFrame:
    """The k best rows, of one kind if that is given, earliest first among equals; those without any occurrence are dropped after that."""
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return relevance(rows, task, weights).orderBy(F.desc("score"), ties).limit(k).where("score > 0")
