"""Extraction from stored HTML: records, links, cleaned bodies, page structure, challenge pages.

Selectors and links need a tree, which no built-in function gives: those operators parse each page once in an
Arrow batch with the standard library's parser, and walk it without recursion, so pages may nest as deep as they like.
What needs no tree is built from Column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.urls import pattern_keys

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags without structure or text of their own.
NON_STRUCTURAL = ("script", "style", "svg", "path", "noscript", "iframe", "template", "link")
#: How many elements of each kind a page's structure lists.
CAPS = {"links": 50, "buttons": 15, "inputs": 15, "headings": 20, "tables": 5}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def _content(self) -> Iterator[Node | str]:
        """Elements and texts below this one, in document order."""
        todo = self.children[::-1]
        while todo:
            item = todo.pop()
            yield item
            if isinstance(item, Node):
                todo += item.children[::-1]

    def walk(self) -> Iterator[Node]:
        return (c for c in self._content() if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        return (c for c in self._content() if isinstance(c, str))

    def text(self) -> str:
        return "".join(self.strings())

    def clean_text(self) -> str:
        return " ".join(self.text().split())

    def _opening(self) -> str:
        return f"<{self.tag}" + "".join(f' {k}="{v}"' for k, v in self.attrs.items()) + ">"

    def outer(self) -> str:
        return self._opening() + ("" if self.tag in VOID else f"{self.inner()}</{self.tag}>")

    def inner(self) -> str:
        out, todo = [], self.children[::-1]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            out.append(item._opening())
            if item.tag not in VOID:
                todo.append(f"</{item.tag}>")
                todo += item.children[::-1]
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


_SIMPLE = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:[#.][\w-]+|\[[^\]]+\])*)$")
_ATTR = re.compile(r"\[\s*([\w-]+)\s*(?:([*^$]?)=\s*(?:'([^']*)'|\"([^\"]*)\"|([^\]\s]*))\s*)?\]")


class Selector:
    """tag, #id, .class, [a], [a=v], [a*=v], [a^=v], [a$=v], descendant, child and comma; no more."""

    def __init__(self, text: str):
        self.options = [self._chain(t.strip()) for t in text.split(",")]

    @staticmethod
    def _chain(text: str) -> list[tuple[str, tuple]]:
        parts, link = [], " "
        for token in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", text):
            if token == ">":
                link = ">"
                continue
            m = _SIMPLE.match(token)
            if not m:
                raise ValueError(f"selector not supported: {text}")
            rest = m["rest"]
            attrs = [(a, op, next((v for v in vs if v), "") if any(vs) else None) for a, op, *vs in _ATTR.findall(rest)]
            bare = _ATTR.sub("", rest)
            parts.append((link, (m["tag"], re.findall(r"#([\w-]+)", bare), re.findall(r"\.([\w-]+)", bare), attrs)))
            link = " "
        if not parts:
            raise ValueError("empty selector")
        return parts

    @staticmethod
    def _fits(node: Node, simple: tuple) -> bool:
        tag, ids, classes, attrs = simple
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        own = node.attrs.get("class", "").split()
        if any(node.attrs.get("id") != i for i in ids) or any(c not in own for c in classes):
            return False
        for name, op, want in attrs:
            have = node.attrs.get(name)
            if have is None:
                return False
            ok = want is None or (want in have if op == "*" else have.startswith(want) if op == "^" else have.endswith(want) if op == "$" else have == want)
            if not ok:
                return False
        return True

    def _matches(self, node: Node, chain: list, i: int) -> bool:
        if not self._fits(node, chain[i][1]):
            return False
        if i == 0:
            return True
        up = node.parent
        while up is not None and up.tag:
            if self._matches(up, chain, i - 1):
                return True
            if chain[i][0] == ">":
                return False
            up = up.parent
        return False

    def find_all(self, root: Node) -> list[Node]:
        return [n for n in root.walk() if any(self._matches(n, c, len(c) - 1) for c in self.options)]


def _value(node: Node, spec: dict) -> str:
    source = spec.get("source", "text")
    name = "href" if source == "href" else spec.get("attr", "")
    return (node.attrs.get(name, "") if source in ("attr", "href", "list_attr") else node.clean_text()).strip()


def extract_fields(pages: DataFrame, specs: list[dict], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, fields map, lists map): for each spec {field, selector, source, attr} the first match's value, or all.

    Sources: text, attr, href, list_text, list_attr. A scalar without match is empty; lists leave blanks out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(s, Selector(s["selector"])) for s in specs]
        for batch in batches:
            scalars, lists = [], []
            for html in batch.column(1).to_pylist():
                root = parse(html)
                one, many = [], []
                for spec, selector in compiled:
                    found = selector.find_all(root)
                    if spec.get("source", "text").startswith("list_"):
                        many.append((spec["field"], [v for n in found if (v := _value(n, spec))]))
                    else:
                        one.append((spec["field"], _value(found[0], spec) if found else ""))
                scalars.append(one)
                lists.append(many)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scalars, pa.map_(pa.string(), pa.string())), pa.array(lists, pa.map_(pa.string(), pa.list_(pa.string())))], names=[id_col, "fields", "lists"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, fields map<string,string>, lists map<string,array<string>>")


def extract_rows(pages: DataFrame, row_selector: str, cells: list[dict], include_html: bool = False, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, cells map): one row for each match of ``row_selector``, its cells found within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Selector(row_selector)
        compiled = [(c, Selector(c["selector"])) for c in cells]
        for batch in batches:
            ids, pos, out = [], [], []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, row in enumerate(rows.find_all(parse(html))):
                    record = [(c["field"], _value(found[0], c) if (found := s.find_all(row)) else "") for c, s in compiled]
                    ids.append(page)
                    pos.append(i)
                    out.append(record + ([("core_source_html", row.outer())] if include_html else []))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(pos, pa.int32()), pa.array(out, pa.map_(pa.string(), pa.string()))], names=[id_col, "pos", "cells"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, pos int, cells map<string,string>")


def anchors(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, pos, href, text) of the links of a page, absolute, the first of each kept; pos counts all anchors with an href.

    Empty, fragment, ``javascript:`` and ``mailto:`` ones are skipped. A link that is no URL is left out. The texts
    within an anchor are stripped and joined. A null page has no links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, hrefs, texts = [], [], [], []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = set()
                for i, node in enumerate(n for n in parse(html).walk() if n.tag == "a" and "href" in n.attrs):
                    raw = node.attrs["href"].strip()
                    if not raw or raw.startswith(("#", "javascript:", "mailto:")):
                        continue
                    try:
                        href = urljoin(url or "", raw)
                    except ValueError:
                        continue
                    if href not in seen:
                        seen.add(href)
                        ids.append(page)
                        pos.append(i)
                        hrefs.append(href[:200])
                        texts.append("".join(t.strip() for t in node.strings())[:80])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(pos, pa.int32()), pa.array(hrefs, pa.string()), pa.array(texts, pa.string())], names=[id_col, "pos", "href", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, pos int, href string, text string")


def limited_anchors(pages: DataFrame, limit: int, **columns) -> DataFrame:
    found = anchors(pages, **columns)
    id_col = found.columns[0]
    return found.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).where(F.col("n") <= limit).drop("n")


def link_patterns(links: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, key, n, samples): keys that at least two links of a page share, with the first three links."""
    keyed = links.select(id_col, "pos", "href", F.explode(pattern_keys(F.col("href"))).alias("key"))
    nth = F.row_number().over(Window.partitionBy(id_col, "key").orderBy("pos"))
    counted = keyed.withColumn("nth", nth).groupBy(id_col, "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("pos", "href")))).alias("s"))
    return counted.where("n >= 2").select(id_col, "key", "n", F.transform("s", lambda x: x["href"]).alias("samples"))


def _clean(root: Node) -> str:
    for node in [*list(root.walk())[::-1], root]:  # what lies within a node comes before it
        kept = []
        for c in node.children:
            if isinstance(c, str):
                kept.append(" ".join(c.split()))
            elif c.tag not in NON_STRUCTURAL and (c.attrs or any(isinstance(x, Node) for x in c.children) or c.text().strip()):
                kept.append(c)
        node.children = kept
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return body.inner()


def clean_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, cleaned): the body without scripts, styles, comments and empty leaves, white space collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_clean(parse(h)) for h in batch.column(1).to_pylist()], pa.string())], names=[id_col, "cleaned"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, cleaned string")


def truncate_at_tag(html: Column, cap: int) -> Column:
    """Up to ``cap`` characters, cut behind the last ``>``, else before the last ``<``, else hard."""
    head = F.left(html, F.lit(cap))
    last = lambda c: F.when(F.locate(c, F.reverse(head)) > 0, F.length(head) - F.locate(c, F.reverse(head)) + 1).otherwise(0)
    cut = F.when(last(">") > 1, F.left(head, last(">"))).when(last("<") > 1, F.left(head, last("<") - 1)).otherwise(head)
    return F.when(F.length(html) <= cap, html).otherwise(cut)


def selector_of(node: Node) -> str:
    if node.attrs.get("id"):
        return f"{node.tag}#{node.attrs['id']}"
    classes = node.attrs.get("class", "").split()
    if classes:
        return ".".join([node.tag, *classes])
    return f"{node.tag}[name={node.attrs['name']}]" if node.attrs.get("name") else node.tag


_ELEMENT = pa.struct([("tag", pa.string()), ("text", pa.string()), ("href", pa.string()), ("selector", pa.string()), ("extra", pa.map_(pa.string(), pa.string()))])
_PARTS = {
    "links": lambda n: n.tag == "a" and "href" in n.attrs,
    "buttons": lambda n: n.tag == "button" or (n.tag == "input" and n.attrs.get("type") in ("button", "submit")),
    "inputs": lambda n: n.tag in ("input", "select", "textarea"),
    "headings": lambda n: re.fullmatch("h[1-6]", n.tag) is not None,
    "tables": lambda n: n.tag == "table",
}


def page_structure(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, links, buttons, inputs, headings, tables): arrays of elements, each list cut at its cap."""

    def element(node: Node) -> dict:
        extra = []
        if node.tag == "table":
            rows = [n for n in node.walk() if n.tag == "tr"]
            extra = [("rows", str(len(rows))), ("headers", " | ".join([n.clean_text() for n in node.walk() if n.tag == "th"][:10]))]
        elif node.tag == "input":
            extra = [("type", node.attrs.get("type", "text"))]
        return {"tag": node.tag, "text": node.clean_text()[:80], "href": node.attrs.get("href", "")[:200], "selector": selector_of(node), "extra": extra}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: [] for k in _PARTS}
            for html in batch.column(1).to_pylist():
                nodes = list(parse(html).walk())
                for k, wanted in _PARTS.items():
                    columns[k].append([element(n) for n in [n for n in nodes if wanted(n)][: CAPS[k]]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(_ELEMENT)) for c in columns.values())], names=[id_col, *columns])

    kind = pages.schema[id_col].dataType.simpleString()
    item = "array<struct<tag:string,text:string,href:string,selector:string,extra:map<string,string>>>"
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{k} {item}" for k in _PARTS))


def classify_interactive(tag: Column, text: Column, attrs: Column) -> Column:
    """pagination, filter or other, for an element of a page's structure; attrs is its class and id."""
    t, a = F.lower(F.trim(text)), F.lower(attrs)
    paging = t.rlike(r"^(?:next|previous|prev|first|last|more|load more|show more|[0-9]+|»|«|›|‹)$") | a.rlike("pagina|pager|next-page|load-more")
    filtering = a.rlike("filter|sort") | t.isin("filter", "sort", "filter by", "sort by") | (tag == "select")
    return F.when(paging, "pagination").when(filtering, "filter").otherwise("other")


def consolidate_snapshots(cards: DataFrame, page: str = "page", snapshot: str = "snap") -> DataFrame:
    """(page, snap, pos, card) of a virtualised list: the last snapshot whole, before it the earlier cards it lacks.

    A card that several snapshots hold is taken from the last of them.
    """
    latest = F.row_number().over(Window.partitionBy(page, "card").orderBy(F.desc(snapshot), F.desc("pos")))
    return cards.withColumn("_nth", latest).where("_nth = 1").drop("_nth")


def selector_probe(html: Column, selector: str) -> Column:
    """Cheap test whether a page may match: for some option of the selector all names and values of its last step occur.

    A page that passes need not match; one that does not pass has no such element spelt that way.
    """
    fits = F.lit(False)
    for chain in Selector(selector).options:
        tag, ids, classes, attrs = chain[-1][1]
        marks = [*ids, *classes, *(v if v else name for name, _, v in attrs)] or ([f"<{tag}"] if tag and tag != "*" else [])
        holds = F.lit(True)
        for mark in marks:
            holds = holds & F.contains(html, F.lit(mark))
        fits = fits | holds
    return fits


def context_window(html: Column, needle: Column, around: int) -> Column:
    """The text around the first occurrence of needle."""
    at = F.position(needle, html)
    return F.when(at > 0, F.substr(html, F.greatest(F.lit(1), at - around), F.length(needle) + 2 * around))


#: Signs of a challenge page: (where, marker, kind, confidence), title and text in lower case.
CHALLENGE_RULES = (
    ("title", "just a moment", "cloudflare_iuam", 0.95),
    ("title", "attention required!", "cloudflare_iuam", 0.95),
    ("title", "checking your browser", "cloudflare_iuam", 0.85),
    ("title", "please wait", "generic_wait", 0.6),
    ("title", "verify you are human", "generic_wait", 0.9),
    ("title", "human verification", "generic_wait", 0.9),
    ("title", "are you human", "generic_wait", 0.9),
    ("title", "security check", "generic_wait", 0.7),
    ("title", "captcha", "unknown", 0.6),
    ("html", "cf-challenge-running", "cloudflare_turnstile", 0.85),
    ("html", "turnstile-wrapper", "cloudflare_turnstile", 0.85),
    ("html", "cf-turnstile-response", "cloudflare_turnstile", 0.85),
    ("html", "cf-chl-widget-", "cloudflare_turnstile", 0.85),
    ("html", "challenges.cloudflare.com/cdn-cgi/challenge-platform", "cloudflare_iuam", 0.85),
    ("html", "g-recaptcha", "recaptcha", 0.85),
    ("html", "google.com/recaptcha", "recaptcha", 0.85),
    ("html", "recaptcha.net", "recaptcha", 0.85),
    ("html", "h-captcha", "hcaptcha", 0.85),
    ("html", "hcaptcha.com/checkcaptcha", "hcaptcha", 0.85),
    ("html", "captcha", "unknown", 0.85),
    ("text", r"just\s+a\s+moment", "cloudflare_iuam", 0.95),
    ("text", r"performing\s+security\s+verification", "cloudflare_turnstile", 0.95),
    ("text", r"verifies\s+you\s+are\s+not\s+a\s+bot", "cloudflare_turnstile", 0.95),
    ("text", r"waiting\s+for\s+.*?\s+to\s+respond", "cloudflare_iuam", 0.85),
    ("text", r"please\s+verify\s+(?:you are|that you'?re)\s+human", "generic_wait", 0.9),
    ("text", r"verify\s+(?:you are|you'?re)\s+human", "generic_wait", 0.85),
    ("text", r"prove\s+(?:you are|you'?re)\s+not\s+a\s+robot", "generic_wait", 0.85),
    ("text", r"checking\s+your\s+browser\s+before\s+accessing", "cloudflare_iuam", 0.9),
    ("text", r"ray\s+id", "cloudflare_iuam", 0.8),
    ("text", "cf-turnstile", "cloudflare_turnstile", 0.95),
    ("text", "turnstile", "cloudflare_turnstile", 0.75),
    ("text", "recaptcha", "recaptcha", 0.9),
    ("text", "hcaptcha", "hcaptcha", 0.9),
    ("text", "g-recaptcha", "recaptcha", 0.95),
    ("text", r"im\s+under\s+attack", "cloudflare_iuam", 0.9),
    ("text", r"ddos\s+protection", "cloudflare_iuam", 0.7),
    ("text", r"please\s+enable\s+cookies", "generic_wait", 0.5),
    ("url", "challenges.cloudflare.com/cdn-cgi/challenge-platform", "cloudflare_turnstile", 0.9),
    ("url", "cloudflarechallenge.com", "cloudflare_iuam", 0.9),
    ("url", "google.com/recaptcha", "recaptcha", 0.9),
    ("url", "recaptcha.net", "recaptcha", 0.9),
    ("url", "hcaptcha.com/checkcaptcha", "hcaptcha", 0.9),
)


def challenge(url: Column, title: Column, html: Column) -> Column:
    """struct(kind, confidence) of the surest kind of challenge, the first rule's among equals; null if none.

    The rules are compiled into one expression, so pages are read once and nothing is joined.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    places = {"title": F.lower(blank(title)), "html": blank(html), "url": F.lower(blank(url)), "text": F.lower(F.concat_ws(" ", blank(title), blank(html)))}
    hits = []
    for i, (where, marker, kind, confidence) in enumerate(CHALLENGE_RULES):
        hit = places[where].rlike(marker) if where == "text" else F.contains(places[where], F.lit(marker))
        hits.append(F.when(hit, F.struct(F.lit(-confidence).alias("c"), F.lit(i).alias("i"), F.lit(kind).alias("kind"))))
    best = F.array_min(F.array_compact(F.array(*hits)))
    return F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), (-best["c"]).alias("confidence")))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
