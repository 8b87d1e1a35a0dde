"""URL identity as Column functions: canonical forms, stable ids, match modes and link patterns.

Everything here is built from JVM expressions except :func:`absolutise`, for which RFC 3986 joins
have no built-in; that one is an Arrow pandas UDF over the standard library.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Hosts that keep plain http, and office document suffixes.
LOOPBACK = ("127.0.0.1", "localhost", "0.0.0.0", "::1")
OFFICE_SUFFIXES = (".doc", ".docx", ".rtf", ".odt", ".odp", ".ods", ".xls", ".xlsx", ".ppt", ".pptx")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
#: White space as Python's strip() sees it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(url: Column) -> Column:
    """[scheme, authority, path, query] by one match; what is absent is empty."""
    return F.split(F.regexp_replace(strip(url), _PARTS, "$1\x00$2\x00$3\x00$4"), "\x00", 4)


def requote(path: Column) -> Column:
    """Percent-decode, then encode anew, leaving ``/ % @`` and unreserved characters alone.

    A malformed escape leaves the path as it is.
    """
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    out = F.url_encode(decoded)
    for found, put in (("+", "%20"), ("%2F", "/"), ("%40", "@"), ("%7E", "~"), ("*", "%2A"), ("%25", "%")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return F.when(path == "", path).otherwise(out)


def _rebuilt(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""))
    return F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _host(authority: Column) -> Column:
    netloc = F.regexp_replace(F.lower(authority), "^[^@]*@", "")
    return F.when(netloc.startswith("["), F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(netloc, ":[0-9]*$", ""))


def host(url: Column) -> Column:
    """The host without user info or port, lower-case; empty where there is none."""
    return let(parts(url), lambda p: _host(p[1]))


def is_loopback(url: Column) -> Column:
    return host(url).isin(*LOOPBACK)


def _canonical(p: Column, keep_loopback: bool) -> Column:
    scheme = F.lower(p[0])
    web = scheme.isin("http", "https")
    if keep_loopback:
        web = web & ~_host(p[1]).isin(*LOOPBACK)
    return _rebuilt(F.when(web, F.lit("https")).otherwise(scheme), F.lower(p[1]), requote(p[2]), p[3])


def canonical_url(url: Column, keep_loopback: bool = True) -> Column:
    """One key for the spellings of a URL; null and empty pass through.

    Strips, lower-cases scheme and host, upgrades http (not on loopback hosts, unless told to), puts
    the path in one percent-coding, keeps the query, drops the fragment.
    """
    return F.when(url.isNull() | (url == ""), url).otherwise(let(parts(url), lambda p: _canonical(p, keep_loopback)))


def sorted_query(query: Column) -> Column:
    """Parameters in order of (name, value), empty ones dropped; without ``=`` before those with it."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    cut = F.transform(pairs, lambda p: F.split(p, "=", 2))
    return F.array_join(F.transform(F.array_sort(cut), lambda kv: F.array_join(kv, "=")), "&")


def _normalized(p: Column) -> Column:
    scheme = F.lower(p[0])
    return _rebuilt(F.when(scheme == "http", F.lit("https")).otherwise(scheme), F.lower(p[1]), requote(p[2]), sorted_query(p[3]))


def normalized_url(url: Column) -> Column:
    """The form for comparison: canonical with https everywhere and the query sorted; null and empty give empty."""
    return F.when(url.isNull() | (url == ""), F.lit("")).otherwise(let(parts(url), _normalized))


def _short_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.encode(text, "utf-8")), 1, 12)


def pdf_id(url: Column, keep_loopback: bool = True) -> Column:
    return F.concat(F.lit("pdf_"), _short_hash(canonical_url(url, keep_loopback)))


def doc_id(url: Column, keep_loopback: bool = True) -> Column:
    return F.concat(F.lit("doc_"), _short_hash(canonical_url(url, keep_loopback)))


def pdf_filename(url: Column, keep_loopback: bool = True) -> Column:
    return F.concat(pdf_id(url, keep_loopback), F.lit(".pdf"))


def html_filename(url: Column) -> Column:
    return F.concat(F.lit("html_"), _short_hash(canonical_url(url)), F.lit(".html"))


def _ext(path: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    suffix = F.lower(F.regexp_extract(decoded, r"[^/](\.[^./]+)/*$", 1))
    return F.when(suffix.isin(*OFFICE_SUFFIXES), suffix).otherwise("")


def file_ext(url: Column) -> Column:
    """The office suffix of the path in lower case, else empty (so also for .pdf)."""
    return let(parts(url), lambda p: _ext(p[2]))


def file_filename(url: Column, keep_loopback: bool = True) -> Column:
    ext = file_ext(url)
    return F.concat(doc_id(url, keep_loopback), F.when(ext == "", F.lit(".bin")).otherwise(ext))


def expected_pdf_filename(url: Column) -> Column:
    """From the comparison form, so it differs from :func:`pdf_filename` for loopback hosts and unsorted queries."""
    return F.concat(F.lit("pdf_"), _short_hash(normalized_url(url)), F.lit(".pdf"))


def expected_filename(url: Column) -> Column:
    """The name on disk that a download of url should have; its two historic spellings are one."""
    blank = url.isNull() | (url == "")
    named = lambda p: F.when(
        _ext(p[2]) != "", F.concat(F.lit("doc_"), _short_hash(_canonical(p, False)), _ext(p[2]))
    ).otherwise(F.concat(F.lit("pdf_"), _short_hash(_normalized(p)), F.lit(".pdf")))
    return F.when(blank, F.concat(F.lit("pdf_"), _short_hash(F.lit("")), F.lit(".pdf"))).otherwise(let(parts(url), named))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([^:/?#]+://[^/?#]+)", 1)


@F.pandas_udf(StringType())
def absolutise(base: pd.Series, href: pd.Series) -> pd.Series:
    """href resolved against base, spelt as it is."""
    from urllib.parse import urljoin

    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href, strict=True)], dtype=object)


def suffix_match(a: Column, b: Column) -> Column:
    """One is the tail of the other, ignoring case and closing slashes, and longer than 8 characters."""
    x, y = (F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")) for c in (a, b))
    short = F.when(F.length(x) > F.length(y), y).otherwise(x)
    long = F.when(F.length(x) > F.length(y), x).otherwise(y)
    return (F.length(short) > 8) & F.endswith(long, short)


def match_mode(candidate: Column, stored: Column) -> Column:
    """normalized, suffix or none."""
    n = normalized_url(candidate)
    return F.when((n != "") & (n == normalized_url(stored)), "normalized").when(suffix_match(candidate, stored), "suffix").otherwise("none")


def prefix_match(candidate: Column, stored: Column) -> Column:
    """stored, without closing slashes and longer than 8, opens candidate up to a boundary (end, ``/`` or ``?``)."""
    s = F.regexp_replace(stored, "/+$", "")
    after = F.substr(candidate, F.length(s) + 1, F.lit(1))
    return (F.length(s) > 8) & F.startswith(candidate, s) & after.isin("", "/", "?")


def href_index(href: Column, pattern: str) -> Column:
    """First group of pattern as an integer, null where it does not match."""
    return F.regexp_extract(href, pattern, 1).try_cast("int")


def pattern_keys(href: Column) -> Column:
    """Grouping keys of a link: ``path:<directory>/`` from two segments on, and ``ext:<suffix>``."""
    path = F.regexp_replace(F.regexp_replace(href, r"^[\s\S]*?://", ""), r"[?#][\s\S]*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folder = F.when(F.size(parts) >= 2, F.concat(F.lit("path:"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), F.lit("/")))
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.array_compact(F.array(folder, F.when(ext != "", F.concat(F.lit("ext:"), ext))))


#: Suffixes of what is no page to open.
NO_PAGE_SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".gz", ".tar", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp3", ".mp4", ".avi", ".mov", ".csv", ".json", ".xml")


def is_page(url: Column) -> Column:
    """Whether a URL may be opened as a page, by the suffix of its path."""
    return ~F.regexp_extract(F.lower(parts(url)[2]), r"(\.[a-z0-9]+)$", 1).isin(*NO_PAGE_SUFFIXES)


def names_url(key: Column) -> Column:
    """Whether a payload key holds a URL, by its name."""
    return key.endswith("_url") | key.endswith("_page") | key.isin("url", "href", "link")
