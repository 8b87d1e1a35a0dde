"""Summaries of long tool returns: by sections and lines, with caps, or by functions that a user names for a tool."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import strip

# Caps on kept lines, and texts that tool returns and summaries are made of.
LINKS, LINKS_HARD, ELEMENTS, HEAD_LINES = 30, 6, 20, 6
PLACEHOLDER = "[trimmed — see latest snapshot]"
BLANK_THINKING = "[trimmed thinking]"
ANALYSED = "analyzed page structure"
PATTERNS = "# Link URL patterns"
EXTRACTED = "# Extracted elements"
PAGE_LINKS = "# Page links"

#: What ends a line, as Python's splitlines has it.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
STYLES = ("analysis", "snapshot", "lines", "analysis_hard", "snapshot_hard")


def split_lines(text: Column) -> Column:
    """The lines of a text; an end at its end begins no further line."""
    lines = F.split(text, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def style_of(bucket: Column, content: Column, hard: bool = False) -> Column:
    """How a return is summarised: snapshots as pages or, by their first line, as analyses of one; all others by their first lines."""
    first = F.regexp_extract(content, r"^[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]*", 0)
    end = "_hard" if hard else ""
    return F.when(bucket != "snapshot", "lines").when(F.contains(first, F.lit(ANALYSED)), f"analysis{end}").otherwise(f"snapshot{end}")


def _places(lines: str, wanted: Callable[[Column], Column]) -> Column:
    """Where the wanted lines are, from 0."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(wanted(x), i)))


def _blank(line: Column) -> Column:
    return strip(line) == ""


def _begins(line: Column) -> Column:
    """A section begins at a header, or at any line that is neither indented nor blank."""
    return line.startswith("#") | (~line.startswith("  ") & ~_blank(line))


def _capped(section: Column) -> Column:
    """The lines kept of a section, a struct of its lines and the places of indented ones."""
    lines, inner = section["lines"], section["inner"]
    cut, last = F.size(inner) - ELEMENTS, F.get(inner, F.lit(ELEMENTS - 1))
    short = F.filter(lines, lambda x, i: ~x.startswith("  ") | (i <= last))
    return F.when((cut <= 0) | F.get(lines, F.lit(0)).startswith(PATTERNS), lines).otherwise(F.concat(short, F.array(F.format_string("[%d more trimmed]", cut))))


def summaries(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, summary) of tool returns (key, content, style), whose style is one of ``STYLES``.

    An analysis keeps its headers and, below each, the first indented lines, with the number of those cut where a section ends; link
    patterns are kept whole. A page keeps its header lines and the first entries of the one list behind them, up to the first line that is neither. All others keep
    their first lines. All is worked out within a row, each step in one pass over the lines of that text: no line is shuffled, and a task holds one text at a time.
    """
    none = F.array().cast("array<string>")
    rows = parts.select(*key, "style", F.coalesce(split_lines("content"), none).alias("_ls"))
    n, style = F.size("_ls"), F.col("style")
    opens = lambda x: x.startswith(EXTRACTED) | x.startswith(PAGE_LINKS)
    page, analysis = style.startswith("snapshot"), style == "analysis"
    rows = rows.select(
        *key, "style", "_ls",
        F.when(analysis, F.concat(F.array(F.lit(0)), F.filter(_places("_ls", _begins), lambda i: i > 0))).alias("_starts"),
        F.when(page, F.get(_places("_ls", opens), F.lit(0))).alias("_opener"),
        F.when(page, F.get(_places("_ls", lambda x: ~_blank(x) & ~x.startswith("#")), F.lit(0))).alias("_body"),
    )
    # The header of a page is over at the opener, unless its body comes first.
    at = F.when(F.col("_body").isNull() | (F.col("_opener") < F.col("_body")), F.col("_opener"))
    rows = rows.select(*key, "style", "_ls", "_starts", "_body", at.alias("_at"))
    behind = F.filter(F.slice("_ls", F.col("_at") + 2, n), lambda x: ~_blank(x))
    indent = F.when(F.get("_ls", F.col("_at")).startswith(EXTRACTED), "  <").otherwise("  ")
    sections = F.transform("_starts", lambda s, j: F.slice("_ls", s + 1, F.coalesce(F.get("_starts", j + 1), n) - s))
    rows = rows.select(
        *key, "style", "_ls",
        F.transform(sections, lambda x: F.struct(x.alias("lines"), _places(x, lambda y: y.startswith("  ")).alias("inner"))).alias("_sections"),
        F.filter(F.slice("_ls", 1, F.coalesce(F.col("_at") + 1, "_body", n)), lambda x: x.startswith("#")).alias("_header"),
        behind.alias("_behind"), indent.alias("_indent"),
    )
    stop = F.coalesce(F.get(_places("_behind", lambda x: ~x.startswith(F.col("_indent"))), F.lit(0)), F.size("_behind"))
    listed = F.slice("_behind", F.lit(1), F.least(stop, F.when(style == "snapshot", LINKS).otherwise(LINKS_HARD)))
    text = (
        F.when(analysis, F.flatten(F.transform("_sections", _capped)))
        .when(style == "analysis_hard", F.filter("_ls", lambda x: x.startswith("#")))
        .when(style == "lines", F.slice(F.filter("_ls", lambda x: ~_blank(x)), 1, HEAD_LINES))
        .otherwise(F.concat("_header", F.coalesce(listed, none)))
    )
    return rows.select(*key, F.array_join(F.when(analysis, text).otherwise(F.concat(text, F.array(F.lit(PLACEHOLDER)))), "\n").alias("summary"))


Summariser = Callable[[Column], Column]


class Summarisers:
    """Functions from a column of texts to one of summaries, by the name of a tool: built-in expressions or pandas UDFs alike."""

    def __init__(self, **by_tool: Summariser):
        self.by_tool = dict(by_tool)

    def register(self, tool: str, summariser: Summariser) -> None:
        self.by_tool[tool] = summariser

    def applied(self, parts: DataFrame, key: list[str], hard: bool = False) -> DataFrame:
        """(key, summary) of parts (key, bucket, tool_name, content): a tool's own function, blank thinking, else :func:`summaries`."""
        own = F.col("tool_name").isin(*self.by_tool) & (F.col("bucket") != "thinking") if self.by_tool else F.lit(False)
        own = F.coalesce(own, F.lit(False))
        text = F.when(F.col("bucket") == "thinking", BLANK_THINKING)
        for tool, summariser in self.by_tool.items():
            text = text.when(F.col("tool_name") == tool, summariser(F.col("content")))
        named = parts.where(own | (F.col("bucket") == "thinking")).select(*key, text.alias("summary"))
        rest = parts.where(~own & (F.col("bucket") != "thinking")).withColumn("style", style_of(F.col("bucket"), F.col("content"), hard))
        return named.unionByName(summaries(rest, key))
