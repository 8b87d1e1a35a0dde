"""Reconciliation of records with the files on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.urls import expected_filename
from gleanery.functions.values import get_or_blank
from gleanery.operators.store import split_pending
from gleanery.session import checkpointed

SMALL_BYTES = 1024
ITEMS = 20


def has_pdf_magic(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 4)) == "25504446", F.lit(False))


def has_eof_marker(content: Column, last: int = 2048) -> Column:
    """``%%EOF`` within the last bytes; hex is compared at even offsets so that no half bytes match."""
    end = F.decode(F.when(F.length(content) > last, F.substring(content, -last, last)).otherwise(content), "iso-8859-1")
    return F.coalesce(F.contains(end, F.lit("%%EOF")), F.lit(False))


def is_office_bytes(content: Column) -> Column:
    """OLE2 or ZIP magic."""
    return F.hex(F.substring(content, 1, 4)).isin("D0CF11E0", "504B0304")


def integrity(basename: Column, length: Column, content: Column) -> Column:
    """struct(is_valid, is_small): PDFs need both marks, other documents some bytes; small is valid and up to 1 KiB."""
    pdf = F.lower(basename).endswith(".pdf")
    valid = F.when(pdf, has_pdf_magic(content) & has_eof_marker(content)).otherwise(length > 0)
    return F.struct(valid.alias("is_valid"), (valid & (length <= SMALL_BYTES)).alias("is_small"))


def checked_files(files: DataFrame) -> DataFrame:
    """(basename, length, is_valid, is_small) of listed files with content."""
    check = integrity(F.col("basename"), F.col("length"), F.col("content"))
    return files.select("basename", "length", check.alias("c")).select("basename", "length", "c.is_valid", "c.is_small")


def is_pdf_bytes(content: Column) -> Column:
    """The stricter test before a file is kept: magic, and the end mark within the last 1024 bytes."""
    return has_pdf_magic(content) & has_eof_marker(content, 1024)


def distinct_urls(records: DataFrame) -> DataFrame:
    """(n): how many different file URLs the records have."""
    url = get_or_blank(F.col("data"), "core_file_url")
    return records.select(F.nullif(url, F.lit("")).alias("url")).agg(F.countDistinct("url").alias("n"))


def ordered_filenames(records: DataFrame) -> DataFrame:
    """(filename, first_seq) of distinct file names, in order of first appearance."""
    name = get_or_blank(F.col("data"), "core_pdf_filename")
    return records.select(name.alias("filename"), "_seq").where("filename <> ''").groupBy("filename").agg(F.min("_seq").alias("first_seq")).orderBy("first_seq", "filename")


def download_faults(records: DataFrame) -> DataFrame:
    """(source_url, fault): a wrong name of a downloaded file, a page that did not load, a file that was not fetched."""
    url, name, status = (get_or_blank(F.col("data"), f"core_{k}") for k in ("file_url", "pdf_filename", "download_status"))
    rows = records.select("source_url", url.alias("url"), name.alias("name"), status.alias("status"))
    done = (F.col("status") == "downloaded") & (F.col("name") != "")
    fault = (
        F.when(done, F.when((F.col("url") != "") & (F.col("name") != expected_filename(F.col("url"))), "canonical_filename"))
        .when(F.col("status") == "load_failed", "load_failed")
        .when(F.col("url") != "", "failed_download")
    )
    return rows.select("source_url", fault.alias("fault")).where("fault is not null")


def smoke_counts(records: DataFrame) -> DataFrame:
    """One row (downloaded, total, faults, wants_files, passed) of a trial run.

    It passes without faults, with a record, and with a downloaded file if any record speaks of files.
    """
    url, name, status = (get_or_blank(F.col("data"), f"core_{k}") for k in ("file_url", "pdf_filename", "download_status"))
    speaks = (url != "") | (name != "") | ~status.isin("", "no_files")
    seen = records.select(((status == "downloaded") & (name != "")).cast("int").alias("downloaded"), F.lit(1).alias("total"), F.lit(0).alias("faults"), speaks.cast("int").alias("wants"))
    faults = download_faults(records).select(F.lit(0).alias("downloaded"), F.lit(0).alias("total"), F.lit(1).alias("faults"), F.lit(0).alias("wants"))
    sums = seen.unionByName(faults).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("downloaded", "total", "faults", "wants")))
    sums = sums.select("downloaded", "total", F.when(F.col("total") == 0, 1).otherwise(F.col("faults")).cast("bigint").alias("faults"), (F.col("wants") > 0).alias("wants_files"))
    return sums.withColumn("passed", (F.col("faults") == 0) & F.when(F.col("wants_files"), F.col("downloaded") >= 1).otherwise(F.col("total") >= 1))


def run_summary(records: DataFrame) -> DataFrame:
    """One row (total, with_file, files, slugs): counts of a run, and its task names in order."""
    name = get_or_blank(F.col("data"), "core_pdf_filename")
    rows = records.select(F.nullif(name, F.lit("")).alias("f"), "task_slug")
    return rows.agg(F.count("*").alias("total"), F.count("f").alias("with_file"), F.countDistinct("f").alias("files"), F.array_sort(F.collect_set("task_slug")).alias("slugs"))


def verdicts(records: DataFrame, files: DataFrame) -> DataFrame:
    """(source_url, expected, verdict, filename_mismatch) of each record against checked files."""
    url, name = get_or_blank(F.col("data"), "core_file_url"), get_or_blank(F.col("data"), "core_pdf_filename")
    rows = records.select("source_url", url.alias("url"), name.alias("db_name")).withColumn("expected", F.when(F.col("url") != "", expected_filename(F.col("url"))))
    joined = rows.join(files.withColumnRenamed("basename", "expected"), "expected", "left")
    verdict = (
        F.when(F.col("url") == "", "empty_pdf_url")
        .when(F.col("is_valid").isNull(), "file_not_downloaded")
        .when(~F.col("is_valid"), "corrupt_file")
        .when(F.col("is_small"), "suspiciously_small")
        .otherwise("present")
    )
    mismatch = F.coalesce((F.col("db_name") != "") & (F.col("db_name") != F.col("expected")), F.lit(False))
    return joined.select("source_url", F.coalesce("expected", F.lit("")).alias("expected"), verdict.alias("verdict"), mismatch.alias("filename_mismatch"))


def verdict_counts(found: DataFrame) -> DataFrame:
    """One row of tallies; missing_count is every verdict but present."""
    return found.agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("verdict") == v).alias(v) for v in ("present", "empty_pdf_url", "file_not_downloaded", "corrupt_file", "suspiciously_small")),
        F.count_if("filename_mismatch").alias("mismatched"),
        F.count_if(F.col("verdict") != "present").alias("missing_count"),
    )


def orphans(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """PDF files (suffix in lower case only) that no record claims."""
    return files.where(F.col("basename").endswith(".pdf")).join(claimed.select("basename").distinct(), "basename", "left_anti").select("basename")


def size_clusters(files: DataFrame) -> DataFrame:
    """(length, n) for sizes above zero that two files or more share."""
    return files.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).where("n >= 2")


def duplicate_urls(records: DataFrame) -> DataFrame:
    """(url, n) for file URLs in more than one record."""
    return records.select(get_or_blank(F.col("data"), "core_file_url").alias("url")).where("url <> ''").groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


def corpus_findings(records: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """(ord, kind, n, items): one row for each kind of finding that occurs, with its first 20 items.

    The items of all kinds are worked out once. They are cut to the first 20 of a kind by name before they are gathered, so
    no group grows with the corpus.
    """
    claimed = records.select(expected_filename(get_or_blank(F.col("data"), "core_file_url")).alias("basename")).where("basename is not null")
    unhandled, stale = split_pending(checkpointed(links), records)
    kinds = [
        ("duplicate_pdf_url", duplicate_urls(records).select(F.col("url").alias("item"))),
        ("orphan_file", orphans(files, claimed).select(F.col("basename").alias("item"))),
        ("part_leftover", files.where(F.col("basename").endswith(".part")).select(F.col("basename").alias("item"))),
        ("identical_size_cluster", size_clusters(files).select(F.concat_ws(" x ", "n", "length").alias("item"))),
        ("discovered_unprocessed", unhandled.select(F.col("url").alias("item"))),
        ("stale_link_status", stale.select(F.col("url").alias("item"))),
    ]
    named = [items.select(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), "item") for i, (kind, items) in enumerate(kinds)]
    found = checkpointed(reduce(DataFrame.unionByName, named))
    nth = F.row_number().over(Window.partitionBy("ord").orderBy("item"))
    first = found.withColumn("nth", nth).where(F.col("nth") <= ITEMS).groupBy("ord").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return found.groupBy("ord", "kind").agg(F.count("*").alias("n")).join(first, "ord").select("ord", "kind", "n", "items")
