"""Checks of stored scripts by a table of patterns, compiled into one Column expression.

Only checks that a pattern can make are here; those that need a syntax tree are left out, as is
said in the README.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Fires where ``found`` matches and ``unless`` does not. kinds: d(iscovery), p(rocessing)."""

    rule: str
    severity: str
    kinds: str
    message: str
    found: str
    unless: str | None = None


#: What the checks look for.
RULES = (
    Rule("11", "error", "p", "the record writer is not awaited", r"await\s+save_record\s*\("),
    Rule("2b", "error", "d", "no link is saved", r"^", r"save_discovered_link\s*\("),
    Rule("14", "error", "p", "a file name is stored without a download status", r"core_pdf_filename", r"core_download_status"),
    Rule("14", "error", "p", "a heading or title serves as readiness selector", r"ready_selector\s*=\s*['\"](?:h[1-6]|title)['\"]"),
    Rule("14", "error", "dp", "select takes one argument", r"\.select\(\s*['\"][^'\"]*['\"]\s*,\s*['\"]"),
    Rule("4b", "error", "dp", "elements have no such method", r"\.text_content\s*\("),
    Rule("8", "error", "dp", "HTTP clients are not to be imported", r"(?m)^\s*(?:import|from)\s+(?:requests|httpx|aiohttp|urllib3)\b"),
    Rule("7", "error", "dp", "this pseudo-selector is not supported", r":has-text\(|:text\(|>>\s*nth="),
    Rule("10", "error", "dp", "the arrow function is never called", r"evaluate\(\s*['\"]{1,3}\s*\(?\w*\)?\s*=>", r"\)\s*\(\s*\)\s*['\"]{1,3}\s*\)"),
    Rule("8a", "error", "p", "the retry helper is imported but not called", r"import[^\n]*\bload_failed_downloads\b", r"load_failed_downloads\s*\("),
    Rule("12", "error", "dp", "a bare downloads path", r"['\"](?:\./)?downloads/?['\"]"),
    Rule("15i", "warning", "p", "tabs are never recycled", r"\bworker\b", r"recycle|new_tab"),
    Rule("17", "warning", "p", "a suffix selector without the i flag", r"href\$=\s*\\?['\"]\.\w+\\?['\"]\s*\]"),
    Rule("13", "error", "p", "a downloaded file is renamed", r"\.rename\(|os\.rename|shutil\.move"),
    Rule("14", "error", "p", "an empty file URL is stored", r"['\"]core_file_url['\"]\s*:\s*['\"]{2}"),
)


def findings(code: Column, kind: Column) -> Column:
    """array<struct<rule, severity, message, line>>: line is that of the first match, 1 where a thing is missing."""
    cells = []
    for r in RULES:
        hit = code.rlike(r.found) & kind.isin(*({"d": "discovery", "p": "processing"}[k] for k in r.kinds))
        if r.unless:
            hit = hit & ~code.rlike(r.unless)
        before = F.regexp_extract(code, rf"([\s\S]*?)(?:{r.found})", 1)
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        cells.append(F.when(hit, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), line.cast("int").alias("line"))))
    return F.array_compact(F.array(*cells))


def lint(scripts: DataFrame) -> DataFrame:
    """(name, rule, severity, message, line) of scripts (name, kind, code)."""
    return scripts.select("name", F.explode(findings(F.col("code"), F.col("kind"))).alias("f")).select("name", "f.*")


#: Texts in a failed run's output and what they mean.
DIAGNOSES = (
    ("TimeoutError", "a step took too long"),
    ("ConnectionRefusedError", "nothing listens there"),
    ("JSONDecodeError", "an answer was not JSON"),
    ("ModuleNotFoundError", "a package is missing"),
    ("KeyError", "a key is missing"),
)


def diagnosis(output: Column) -> Column:
    """What the first known text in the output means, null if none."""
    out = F.lit(None).cast("string")
    for text, meaning in reversed(DIAGNOSES):
        out = F.when(F.contains(output, F.lit(text)), meaning).otherwise(out)
    return out


def error_line(output: Column) -> Column:
    """The last line that looks like an exception."""
    lines = F.filter(F.split(output, "\n"), lambda x: x.rlike(r"^\w*(?:Error|Exception)\b"))
    return F.try_element_at(lines, F.lit(-1))
