"""Text functions over Columns."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.urls import strip

#: Words that carry no meaning in a task description.
STOP_WORDS = (
    "this", "that", "with", "from", "each", "have", "been", "they", "will", "what", "when", "where", "which", "there", "their", "about", "should",
    "would", "could", "into", "also", "than", "then", "just", "only", "over", "very", "your", "some",
)


def normalize_text(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def contains_needle(hay: Column, needle: Column) -> Column:
    """Containment after normalising both, else after taking out all spaces."""
    h, n = normalize_text(hay), normalize_text(needle)
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return (n != "") & (F.contains(h, n) | F.contains(bare(h), bare(n)))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def keywords(text: Column, limit: int = 20) -> Column:
    """Words of four letters and more without stop words; the first ``limit``, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)), 1, limit)


def first_sentence(text: Column) -> Column:
    s = strip(text)
    found = F.regexp_extract(s, r"^([^.!?\n]+[.!?\n])", 1)
    return F.when(found != "", strip(found)).otherwise(F.left(s, F.lit(200)))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def table_cell(value: Column, limit: int = 120) -> Column:
    """One cell of a pipe table: NULL, line breaks as spaces, pipes escaped, long values cut."""
    v = F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("NULL")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.left(v, F.lit(limit - 3)), F.lit("...")))


def tail(text: Column, limit: int = 8000) -> Column:
    return F.right(text, F.lit(limit))


def comma_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda t: t != "")


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What full case folding makes of lower-case characters that it changes: to one character, and to several."""
    lower = {c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if c.lower() == c and c.casefold() != c}
    return {c: f for c in sorted(lower) if len(f := c.casefold()) == 1}, {c: f for c in sorted(lower) if len(f := c.casefold()) > 1}


def fold(text: Column) -> Column:
    """Key for comparison without regard to case: full case folding, stripped.

    Lower case is all that a text of ASCII needs. Only texts with a character that folding spells otherwise go through the
    replacements, and of those with several letters only through such as they hold.
    """
    one, more = _folds()
    lower = F.lower(strip(text))
    single = F.translate(lower, "".join(one), "".join(one.values()))
    # Two constants that are split, as a literal a pair would take longer to plan than to run.
    words = lambda texts: F.split(F.lit(" ".join(texts)), " ")
    pairs = F.filter(F.arrays_zip(words(more).alias("a"), words(more.values()).alias("b")), lambda p: F.contains(lower, p["a"]))
    whole = F.aggregate(pairs, single, lambda s, p: F.replace(s, p["a"], p["b"]))
    return F.when(F.octet_length(text) == F.length(text), lower).when(lower.rlike("[" + "".join(one) + "".join(more) + "]"), whole).otherwise(lower)


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def requirement_name(spec: Column) -> Column:
    """Package name of a requirement: without extras and version bounds."""
    return strip(F.regexp_extract(spec, r"^([^\[=<>!~]*)", 1))


def distinct_folded(names: Column) -> Column:
    """Ordered distinct names without regard to case, the first spelling kept."""
    lower = F.transform(names, F.lower)
    return F.filter(names, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(hours > 0, F.format_string("%dh%dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm%ds", minutes, s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def substring_count(text: Column, term: Column) -> Column:
    """Occurrences of term that do not overlap."""
    return F.when(term == "", 0).otherwise((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")
