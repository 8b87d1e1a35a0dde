"""Column functions against the plain rules they stand for."""

import hashlib
import random
from urllib.parse import quote, unquote, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import urls as U
from gleanery.functions import values as V


def one(spark, column, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], schema or ", ".join(f"{n} string" for n in names))
    return df.select(column(*(F.col(n) for n in names)).alias("x")).first().x


def many(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", column(F.col("c")).alias("x")).orderBy("i").collect()]


def canonical(url, keep=True):
    if not url:
        return url
    p = urlsplit(url.strip())
    scheme = p.scheme.lower()
    if scheme in ("http", "https") and not (keep and p.hostname in U.LOOPBACK):
        scheme = "https"
    return urlunsplit((scheme, p.netloc.lower(), quote(unquote(p.path), safe="/%@") if p.path else "", p.query, ""))


URLS = [
    "HTTP://Ex.COM/a b/é.pdf?q=a+b#x", "http://127.0.0.1:8765/doc/1?p=2", "https://h/bel%C3%A9m", "https://h/belém", "https://h/?b=2&a=1", "", None, " https://H/x%2Fy/@me~*'() ",
    "http://[::1]:80/x", "http://localhost/a", "https://h/a+b;c=d", "mailto:x@y.z", "/rel/path?x#y", "https://h", "https://user@H.com:8080/p", "http://h/%41%7e%2a", "ftp://H/x y",
]


def test_canonical_urls(spark):
    assert many(spark, U.canonical_url, URLS) == [canonical(u) for u in URLS]
    assert many(spark, lambda c: U.canonical_url(c, False), URLS) == [canonical(u, False) for u in URLS]


def test_canonical_random_urls(spark):
    rng = random.Random(2)
    urls = ["http://Host.example/" + "".join(rng.choice("aZ09-._~ +*@:!$&'(),;=/é漢") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert many(spark, U.canonical_url, urls) == [canonical(u) for u in urls]


def test_malformed_escape_keeps_the_path(spark):
    assert one(spark, U.canonical_url, "https://h/a%zz") == "https://h/a%zz"


def test_ids(spark):
    url = "http://Ex.com/A b.pdf"
    h = hashlib.sha1(canonical(url).encode()).hexdigest()[:12]
    assert one(spark, U.pdf_filename, url) == f"pdf_{h}.pdf"
    assert one(spark, U.html_filename, url) == f"html_{h}.html"
    assert one(spark, U.file_filename, "https://h/x.DOCX") .endswith(".docx")
    assert one(spark, U.file_filename, "https://h/x").endswith(".bin")
    local = "http://localhost/f.pdf?b=1&a=2"
    assert one(spark, U.expected_pdf_filename, local) != one(spark, U.pdf_filename, local)
    assert one(spark, U.expected_filename, "https://h/x.xls").startswith("doc_")


def test_normalized_and_match_modes(spark):
    assert one(spark, U.normalized_url, "http://H/p?b=2&a=1&&a=0#f") == "https://h/p?a=0&a=1&b=2"
    assert many(spark, U.normalized_url, ["", None]) == ["", ""]
    cases = [("http://h/a?x=1&y=2", "https://H/a?y=2&x=1", "normalized"), ("/long/tail.pdf/", "https://h/long/TAIL.pdf", "suffix"), ("tail.pdf", "https://h/tail.pdf", "none"), ("/tail.pdf", "https://h/tail.pdf", "suffix"), (None, "x", "none")]
    for a, b, mode in cases:
        assert one(spark, U.match_mode, a, b) == mode
    for a, b, ok in [("https://h/file.docx", "https://h/file.doc", False), ("https://h/file/x", "https://h/file", True), ("https://h/file?x", "https://h/file/", True), ("short/x", "short", False)]:
        assert one(spark, U.prefix_match, a, b) is ok


@pytest.mark.parametrize(
    "href, keys",
    [
        ("https://h/reports/pdfs/a.pdf?x=1", ["path:h/reports/pdfs/", "ext:.pdf"]),
        ("/reports/a.pdf", ["path:reports/", "ext:.pdf"]),
        ("a", []),
        ("/x/y.z/w", ["path:x/y.z/"]),
        ("#top", []),
    ],
)
def test_pattern_keys(spark, href, keys):
    assert one(spark, U.pattern_keys, href) == keys


def test_absolutise(spark):
    cases = [("https://h/a/b", "c", "https://h/a/c"), ("https://h/a/b", "/x y", "https://h/x y"), ("https://h/a", "?q=1", "https://h/a?q=1"), ("https://h/a", "http://o/z", "http://o/z")]
    assert [one(spark, U.absolutise, b, h) for b, h, _ in cases] == [w for _, _, w in cases]


def test_text_functions(spark):
    assert one(spark, T.normalize_text, " a  b\n\tc ") == "a b c"
    assert one(spark, T.normalize_text, None) == ""
    assert one(spark, T.contains_needle, "a b\nc d", "b  c") and one(spark, T.contains_needle, "ab cd", "a bc d")
    assert one(spark, T.keywords, "This Task lists each report with reports x1 abc") == ["task", "lists", "report", "reports"]
    assert one(spark, T.first_sentence, " One! Two.") == "One!"
    assert one(spark, lambda c: T.truncate(c, 4), "abcdef") == "abc…"
    assert one(spark, T.table_cell, "a|b\nc") == "a\\|b c" and one(spark, T.table_cell, None) == "NULL"
    assert one(spark, T.comma_tokens, " a, ,b,") == ["a", "b"]
    assert one(spark, T.fold, " Straße ") == "strasse"
    assert one(spark, T.safe_filename, "a b/ç.é-_") == "a_b_ç_é-_"
    assert one(spark, T.requirement_name, "pkg[extra]>=1.0") == "pkg"
    assert [one(spark, lambda c: T.duration(c.cast("int")), str(s)) for s in (5, 65, 3700)] == ["5s", "1m5s", "1h1m"]
    assert one(spark, lambda a, b: T.substring_count(a, b), "aaaa", "aa") == 2
    assert one(spark, lambda c: T.distinct_folded(F.split(c, ",")), "A,a,B,b,A") == ["A", "B"]


def test_dates_and_numbers(spark):
    dates = {"2024-01-05": "2024-01-05", "2024/1/5": "2024-01-05", "31-12-2024": "2024-12-31", "5/1/2024": "2024-01-05", "Jan 5 2024": "Jan 5 2024", "": None, None: None, "32/1/2024": "32/1/2024", "1/1/24": "1/1/24"}
    assert many(spark, V.coerce_date, list(dates)) == list(dates.values())
    looks = {"2024-01-05": True, "2024-01": True, "2024-": True, "12-34-56-78": True, "2024-01-05T10:20:30Z": True, "20240105": True, "x": False, "2024": False, "": False}
    assert many(spark, V.looks_like_date, list(looks)) == list(looks.values())
    numbers = {"1,234": True, "1e3": True, "1_000": True, "12d": False, "nan": True, "-inf": True, " 5 ": True, "": False, ".5": True, "5.": True, "0x1": False, "1__0": False}
    assert many(spark, V.looks_like_number, list(numbers)) == list(numbers.values())


def test_json_payloads(spark):
    assert [len(x) for x in many(spark, V.decode_object, ["", "{bad", "[1]", "null", None, '{"a": 1}'])] == [0, 0, 0, 0, 0, 1]
    payload = lambda c: V.coalesce_sources(V.decode_object(c), ["a", "b", "c"])
    cases = {'{"a": null, "b": "", "c": 0}': "0", '{"a": [], "b": false}': "false", '{"a": " "}': " ", "{}": None}
    assert many(spark, payload, list(cases)) == list(cases.values())
    assert one(spark, lambda c: V.sorted_keys(V.decode_object(c)), '{"b": 1, "a": 2}') == "a, b"
    assert one(spark, V.list_items, '["x", "y"]') == ["x", "y"] and one(spark, V.list_items, "z") == ["z"]
    assert one(spark, lambda c: V.fingerprint(V.decode_object(c)), '{"b": 1, "a": 2}') == hashlib.sha256(b'{"a":"2","b":"1"}').hexdigest()


def test_fold_is_full_case_folding(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ", "σίσυφος", "ﬁne ﬀ", "İstanbul", "ŉ", "Ꭰ ꭰ", "µ", "x" * 50] + [chr(a) + chr(a + 1) for a in range(0x41, 0x24F, 2)]
    assert many(spark, T.fold, texts) == [t.strip().casefold() for t in texts]
