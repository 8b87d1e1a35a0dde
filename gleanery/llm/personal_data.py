"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, scheme separators and the cue
words of identifiers. A deterministic local parser then grows each anchor to the boundaries of an
email, an address, a card, a phone or an account number and validates it. Text without anchors is
never looked at twice.

Kinds. Base: ``email``, ``ip``, ``card``, ``phone``. Added: ``userinfo`` (``scheme://name[:word]@host``),
``iban`` (mod-97 valid), ``account`` (6 to 17 digits right after an account cue).

Edge cases: a null or empty text has no spans; rows are handled one by one, so repeated rows repeat
their result, an empty table gives an empty result, and further input columns are not read.
Positions are code points, ends exclusive. Ties at one start go by the order of kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import map_arrow
from gleanery.session import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "userinfo", "iban", "account")
RANK = {k: i for i, k in enumerate(KINDS)}

ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?i:[ _-]?(?:no|number|nr|num)?)\.?[\s:#=]{1,3}([0-9]{6,17})(?![0-9])")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead; a run of digits of any length is never read as one number."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def build_automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for c in "0123456789":
        machine.add_word(c, ("digit", 1))
    machine.add_word("@", ("at", 1))
    machine.add_word("+", ("plus", 1))
    machine.add_word("://", ("scheme", 3))
    for cue, kind in [("iban", "iban"), *((c, "account") for c in ACCOUNT_CUES)]:
        for form in {cue, cue.capitalize(), cue.upper()}:
            machine.add_word(form, (kind, len(form)))
    machine.make_automaton()
    return machine


def find_spans(text: str, machine) -> list[tuple[int, int, str, int]]:
    """Spans (start, rank, kind, end) of one text, sorted."""
    spans: list[tuple[int, int, str, int]] = []
    email_end = ip_from = card_from = phone_end = 0

    def add(kind: str, start: int, end: int) -> None:
        spans.append((start, RANK[kind], kind, end))

    for last, (anchor, size) in machine.iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= card_from:
                m = _CARD.match(text, at)
                if m:
                    card_from = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, m.end())
            if at >= ip_from:
                m = _IP.match(text, at)
                if m:
                    ip_from = m.end()
                    if all(map(octet, m.group().split("."))):
                        add("ip", at, m.end())
                else:  # no start within this run of digits can match either
                    ip_from = _DIGITS.match(text, at).end()
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                add("email", start, m.end())
        elif anchor == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    add("phone", at, m.end())
        elif anchor == "scheme":
            head = at
            while head > 0 and text[head - 1] in _SCHEME:
                head -= 1
            while head < at and not text[head].isalpha():  # a scheme opens with a letter
                head += 1
            if head < at and (m := _USERINFO.match(text, at + 3)):
                add("userinfo", head, m.end())
        elif anchor == "iban":
            m = _IBAN.match(text, at + size)
            if m and iban_valid(m.group(1)):
                add("iban", m.start(1), m.end(1))
        elif m := _ACCOUNT.match(text, at + size):
            add("account", m.start(1), m.end(1))
    spans.sort()
    return spans


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) for each row; spans are sorted structs (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = build_automaton()
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for s, _, k, e in find_spans(t, machine)] if t else []
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs, [id_col, text_col], run, f"`{id_col}` {kind}, spans {SPANS}")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_personal_data(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


QUERIES = {"op7_personal_data": op7_personal_data}
