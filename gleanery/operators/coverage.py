"""Verification of a crawl: probes, gaps, discovery audit, captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import contains_needle
from gleanery.functions.urls import expected_filename, normalized_url
from gleanery.functions.values import get_or_blank
from gleanery.operators.affix import least_partners
from gleanery.session import checkpointed

#: Shorter URLs are compared as a whole only.
LEAST = 9
#: Lines of a discovery log.
TOTAL = r"^DISCOVERY total_saved=(\d+)$"
TARGET = r"DISCOVERY target=(.*?) found=(\d+) saved=(\d+)"


def first_hits(probes: DataFrame, records: DataFrame, prefixes: bool = True) -> DataFrame:
    """(probe_ord, matched_seq): the first record (url, _seq) whose URL each probe (probe_ord, source_url) matches; no row without one.

    By normalised equality, by suffix either way round, or by prefix up to a boundary. Both sides are laid out as keys, a few a URL
    whatever its length: reversed ones for suffixes, and for a prefix the probe with each mark that may follow it. Equal and
    prefix-related keys are found in one range join, which holds no pairs.
    """
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    kind = lambda mark, key: F.concat(F.lit(mark), key)
    url, norm = F.col("url"), normalized_url(F.col("url"))
    low = F.lower(bare(url))
    end = F.lit("\0")  # ends what must be equal; no URL holds it
    suffix = F.when(F.length(low) >= LEAST, kind("<", F.reverse(low)))
    keys = [(F.when(norm != "", F.concat(F.lit("="), norm, end)), False), (suffix, True)]
    if prefixes:
        stem = F.when(F.length(bare(url)) >= LEAST, kind(">", bare(url)))
        keys += [(F.concat(stem, F.lit(mark)), False) for mark in ("\0", "/", "?")]
    p = probes.select("probe_ord", F.col("source_url").alias("url")).select("probe_ord", F.explode(F.array(*(F.struct(k.alias("key"), F.lit(u).alias("upward")) for k, u in keys))).alias("k"))
    p = p.select("probe_ord", "k.key", "k.upward").where("key is not null")
    own = [keys[0][0], suffix, *([F.concat(kind(">", url), end)] if prefixes else [])]
    # Read once, as a row a URL: the range join looks at its input several times.
    known = checkpointed(records.where("url is not null and url <> ''").groupBy("url").agg(F.min("_seq").alias("_seq")))
    r = known.select(F.explode(F.array(*own)).alias("key"), F.col("_seq").alias("partner"))
    return p.hint("merge").join(least_partners(p.select("key", "upward"), r), "key").groupBy("probe_ord").agg(F.min("partner").alias("matched_seq"))


def probe_corpus(probes: DataFrame, records: DataFrame) -> DataFrame:
    """(probe_ord, source_url, verdict, matched_seq): is each expected URL captured, and by which first record?

    ``probes``: (probe_ord, source_url). ``records``: (url, _seq), one row for each URL of a record.
    """
    return probes.join(first_hits(probes, records), "probe_ord", "left").select(
        "probe_ord", "source_url", F.when(F.col("matched_seq").isNotNull(), "captured").otherwise("missing_url").alias("verdict"), "matched_seq"
    )


def spot_checks(candidates: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """(probe_ord, source_url, verdict, db_source_url, filename) of candidate file URLs (probe_ord, source_url).

    A candidate belongs to the first record (source_url, data, _seq) whose file URL it equals or ends like. Its
    file is looked for by the expected name, then by the name the record has; ``files`` are checked ones.
    """
    url, name = get_or_blank(F.col("data"), "core_file_url"), get_or_blank(F.col("data"), "core_pdf_filename")
    rows = records.select("_seq", F.col("source_url").alias("db_source_url"), url.alias("url"), name.alias("stored_name"))
    first = first_hits(candidates, rows.select("url", "_seq"), prefixes=False).withColumnRenamed("matched_seq", "_seq")
    # Merged, as tables small on disk would be sent whole to each task, however many rows are made of them. Records come to the hits alone, and a name that fits no file is replaced by one of the row's own: else all rows without one would meet in one task.
    joined = candidates.join(first.join(rows.drop("url").hint("merge"), "_seq"), "probe_ord", "left").withColumn("expected_name", expected_filename(F.col("source_url")))
    joined = joined.withColumns({c: F.when(F.coalesce(F.col(n), F.lit("")) == "", F.concat(F.lit("\0"), F.monotonically_increasing_id())).otherwise(F.col(n)) for c, n in (("_expected", "expected_name"), ("_stored", "stored_name"))})
    for kind in ("expected", "stored"):
        disk = files.where("basename <> ''").select(F.col("basename").alias(f"_{kind}"), F.struct(F.col("basename"), "is_valid", "is_small").alias(kind))
        joined = joined.join(disk.hint("merge"), f"_{kind}", "left")
    f = F.coalesce("expected", "stored")
    verdict = (
        F.when(F.col("_seq").isNull(), "missing_from_db").when(f.isNull(), "file_not_downloaded").when(~f["is_valid"], "corrupt_file").when(f["is_small"], "suspiciously_small").otherwise("present")
    )
    shown = F.when(F.col("_seq").isNotNull(), F.coalesce(f["basename"], F.col("stored_name")))
    return joined.select("probe_ord", "source_url", verdict.alias("verdict"), "db_source_url", shown.alias("filename"))


def probe_counts(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict") == "captured").alias("captured"), F.count_if(F.col("verdict") != "captured").alias("failed")
    )


def _by_range(values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values dealt by range, with their ``part``; and a row a part (part, first, n), which is all that a global window sees."""
    parted = checkpointed(values.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    return parted, parted.groupBy("part").agg(F.min(column).alias("first"), F.count("*").alias("n"))


def gap_spans(values: DataFrame, least: int = 3) -> DataFrame:
    """(lo, hi): runs of 64-bit integers that are missing between at least ``least`` distinct ones of a column ``value`` of texts.

    Texts that are no such integer do not count. Values are dealt by range; each looks at the next of its part, and the last of a part at the
    first of the next part that has any.
    """
    parted, parts = _by_range(values.select(F.col("value").try_cast("bigint").alias("v")).where("v is not null").distinct(), "v")
    parts = parts.select("part", F.lead("first").over(Window.orderBy("part")).alias("beyond"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("n")).where(F.col("n") >= least)
    following = F.coalesce(F.lead("v").over(Window.partitionBy("part").orderBy("v")), F.col("beyond"))
    # Within the test v < following, so neither sum can overflow.
    return parted.join(F.broadcast(parts), "part").select("v", following.alias("w")).where("v < w - 1").select((F.col("v") + 1).alias("lo"), (F.col("w") - 1).alias("hi"))


#: Spans are cut at multiples of these sizes in turn, so no array has more than 2^16 entries.
PIECES = (48, 32, 16)


def _listed(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): the integers of spans (keys, lo, hi) one by one; long spans are cut into pieces that are dealt over the tasks."""
    for bits in PIECES:
        at = F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits)))
        first = F.shiftleft("at", bits)
        spans = spans.select(*keys, "lo", "hi", at.alias("at")).select(*keys, F.greatest("lo", first).alias("lo"), F.least("hi", first.bitwiseOR(F.lit((1 << bits) - 1))).alias("hi"))
    return spans.repartition(F.xxhash64(*keys, "lo")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("n"))


def numeric_gaps(values: DataFrame, least: int = 3) -> DataFrame:
    """(missing): the integers of :func:`gap_spans` one by one."""
    return _listed(gap_spans(values, least)).withColumnRenamed("n", "missing")


def cross_gaps(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) combinations of observed values that never occur together.

    The values of b are numbered in order, and each value of a has gaps between the numbers it occurs with; only those are listed, so the work is
    that of the pairs seen and of the pairs reported, and no product is formed.
    """
    seen = checkpointed(pairs.where(f"{a} <> '' and {b} <> ''").select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    parted, parts = _by_range(seen.select("b").distinct(), "b")
    starts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("b")) - 1
    numbers = checkpointed(parted.join(F.broadcast(starts), "part").select("b", (F.col("start") + nth).alias("n"), "total"))
    along = Window.partitionBy("a").orderBy("n")
    placed = seen.join(numbers, "b").select("a", "n", F.lead("n").over(along).alias("after"), F.lag("n").over(along).alias("before"), "total")
    # Behind each number up to the next, and before the first.
    gaps = F.array(F.struct((F.col("n") + 1).alias("lo"), (F.coalesce("after", "total") - 1).alias("hi")), F.when(F.col("before").isNull(), F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("n") - 1).alias("hi"))))
    spans = placed.select("a", F.explode(F.array_compact(gaps)).alias("g")).select("a", "g.lo", "g.hi").where("lo <= hi")
    return _listed(spans, "a").join(numbers.select("b", "n"), "n").select(F.col("a").alias(a), F.col("b").alias(b))


def discovery_lines(lines: DataFrame) -> DataFrame:
    """(label, found, saved) out of a discovery log (line_no, line); the last line of a label wins."""
    parsed = lines.where(F.col("line").rlike(TARGET)).select(
        "line_no", F.regexp_extract("line", TARGET, 1).alias("label"), *(F.regexp_extract("line", TARGET, i).cast("bigint").alias(n) for i, n in ((2, "found"), (3, "saved")))
    )
    return parsed.groupBy("label").agg(F.max_by("found", "line_no").alias("found"), F.max_by("saved", "line_no").alias("saved"))


def under_collected(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, expected, stored) where the store holds fewer links than discovery found or saved."""
    both = targets.join(counts.withColumnRenamed("filter_label", "label"), "label", "full")
    stored = F.coalesce("n", F.lit(0).cast("bigint"))
    expected = F.greatest(F.coalesce("found", F.lit(0)), F.coalesce("saved", F.lit(0))).cast("bigint")
    return both.select("label", expected.alias("expected"), stored.alias("stored")).where("stored < expected")


def discovery_total(lines: DataFrame) -> DataFrame:
    """One row (total): the last reported sum of saved links, null where no line reports one."""
    said = F.when(F.trim("line").rlike(TOTAL), F.regexp_extract(F.trim("line"), TOTAL, 1).cast("bigint"))
    return lines.select("line_no", said.alias("total")).agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("line_no"))).alias("total"))


def self_check(targets: DataFrame, least_found: int = 1, most_ratio: float = 2.0) -> DataFrame:
    """(label, failure): found too few, or saved more than ``most_ratio`` times what was found; both may hold."""
    checks = F.array(
        F.when(F.col("found") < least_found, "found_below_minimum"),
        F.when((F.col("found") > 0) & (F.col("saved") > most_ratio * F.col("found")), "saved_above_found"),
    )
    return targets.select("label", F.explode(F.array_compact(checks)).alias("failure"))


def run_check(lines: DataFrame, links: DataFrame, least_found: int = 1, most_ratio: float = 2.0) -> DataFrame:
    """(label, failure) of a discovery log against the stored links; those of the whole run have no label.

    Without a total nothing else is judged. A total of zero fails, and so does one above zero with no link stored.
    """
    both = discovery_total(lines).select("total", F.lit(0).cast("bigint").alias("stored")).unionByName(links.agg(F.count("*").alias("stored")).select(F.lit(None).cast("bigint").alias("total"), "stored"))
    failure = F.when(F.col("total").isNull(), "total_missing").when(F.col("total") == 0, "nothing_collected").when(F.col("stored") == 0, "nothing_stored")
    run = both.agg(F.max("total").alias("total"), F.max("stored").alias("stored")).select(F.lit(None).cast("string").alias("label"), failure.alias("failure")).where("failure is not null")
    judged = self_check(discovery_lines(lines), least_found, most_ratio).where(discovery_total(lines).scalar().isNotNull())
    return run.unionByName(judged)


def pair_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows that have both values."""
    return pairs.where(f"{a} <> '' and {b} <> ''").groupBy(a, b).agg(F.count("*").alias("n"))


def unvisited(declared: DataFrame, visited: DataFrame, path: str = "path") -> DataFrame:
    """Declared paths that are still to be visited, each once."""
    return declared.select(path).distinct().join(visited.select(path), path, "left_anti")


def merged_results(report: DataFrame, results: DataFrame, key: str = "url") -> DataFrame:
    """The report, and behind it the results for keys it lacks."""
    return report.unionByName(results.join(report.select(key), key, "left_anti"))


def html_gate(records: DataFrame, captured: DataFrame) -> DataFrame:
    """(source_url, problem) of records whose captured page is absent or does not hold their reference.

    ``records``: (source_url, html_filename, document_ref). ``captured``: (basename, html).
    """
    joined = records.join(captured.select(F.col("basename").alias("html_filename"), "html"), "html_filename", "left")
    problem = (
        F.when(F.coalesce(F.col("html_filename"), F.lit("")) == "", "no_html")
        .when(F.col("html").isNull(), "html_missing")
        .when(~contains_needle(F.col("html"), F.col("document_ref")), "reference_not_found")
    )
    return joined.select("source_url", problem.alias("problem")).where("problem is not null")


def passes(complete: Column, missing: Column, gaps: Column, captured: Column, html_required: Column, html_ok: Column) -> Column:
    return (complete | ((missing == 0) & (gaps == 0))) & captured & (~html_required | html_ok)


def has_value(text: Column) -> Column:
    """Whether a field of a payload holds anything: no blank text, empty list or empty object."""
    return ~F.trim(F.coalesce(text, F.lit(""))).isin("", "[]", "{}")


def expected_output(records: DataFrame, fields: list[str], least: int) -> DataFrame:
    """One row: enough records, and for each field whether any record has a value."""
    return records.agg((F.count("*") >= least).alias("enough"), *(F.coalesce(F.bool_or(has_value(F.get_json_object("data", f"$.{f}"))), F.lit(False)).alias(f"has_{f}") for f in fields))


def listing_targets(hrefs: DataFrame, index_pattern: str, lo: int | None, hi: int | None, find: str, put: str) -> DataFrame:
    """(n, href, url, label): links within an index range (those without index stay), numbered and transformed.

    ``hrefs``: (pos, href). Numbering is that of the kept rows in order of pos.
    """
    index = F.regexp_extract("href", index_pattern, 1).try_cast("int")
    kept = hrefs.withColumn("i", index)
    if lo is not None:
        kept = kept.where(F.col("i").isNull() | (F.col("i") >= lo))
    if hi is not None:
        kept = kept.where(F.col("i").isNull() | (F.col("i") <= hi))
    at = F.locate(find, F.col("href"))
    url = F.when(at > 0, F.concat(F.left("href", at - 1), F.lit(put), F.substr(F.col("href"), at + len(find)))).otherwise(F.col("href"))
    # One listing page is one small numbered list; a corpus of listings passes its page as partition.
    n = F.row_number().over(Window.partitionBy("page").orderBy("pos"))
    return kept.withColumn("n", n).select("page", "n", "href", url.alias("url"), F.concat_ws(",", F.col("n"), F.coalesce(F.col("i").cast("string"), F.lit("")), F.col("href")).alias("label"))
