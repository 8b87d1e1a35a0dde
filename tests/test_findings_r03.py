"""What a review of round 3 found, on tables small enough to read."""

import duckdb
import pytest

from pyspark.sql import functions as F

from gleanery import session
from gleanery.operators import coverage, html, summaries
from gleanery.plans import registry

TITLES = ["plain", "a &amp; b", "token = &quot;77&quot; &lt;x&gt;", "cut &amp", "cut &am", "&&amp;amp;", "&#39;&eacute;&eacute", "&amp;quot;"]


@pytest.fixture
def pages_dir(spark, tmp_path):
    rows = [(i, f"https://h.example/{i}", f'<html><body><nav><ul><li><a href="/x{i}">x</a></li></ul></nav><article><h1>{t}</h1><p>&quot;</p></article></body></html>') for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["page_fields", "page_structure"])
def test_references_in_titles_as_in_sql(spark, pages_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{pages_dir}/pages.parquet/*.parquet')")
    cursor = con.execute(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, pages_dir).select(*(d[0] for d in cursor.description))
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


def test_operators_decode_all_references(spark, pages_dir):
    found = html.extract_fields(spark.read.parquet(f"{pages_dir}/pages.parquet"), [{"field": "t", "selector": "h1"}]).orderBy("page_id").collect()
    assert [r.fields["t"] for r in found[:4]] == ["plain", "a & b", 'token = "77" <x>', "cut &"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summaries_are_made_within_a_row(spark):
    rows = [(1, "# p\n# Page links\n  a\n\n  b\nend\n  c", "snapshot"), (1, "x\ny", "lines"), (2, None, "analysis"), (2, None, "snapshot"), (3, "  early\n# h\n" + "  i\n" * 21 + "\n", "analysis")]
    found = summaries.summaries(spark.createDataFrame(rows, "id int, content string, style string"), ["id"])
    assert "Exchange" not in plan_of(found)
    end = summaries.PLACEHOLDER
    want = [(1, f"# p\n# Page links\n  a\n  b\n{end}"), (1, f"x\ny\n{end}"), (2, ""), (2, end), (3, "  early\n# h\n" + "  i\n" * 20 + "\n[1 more trimmed]")]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_short_rows_are_dealt_over_tasks(spark, tmp_path):
    rows = session.dealt(spark.range(100).coalesce(1), 16)
    assert rows.rdd.getNumPartitions() == 7 and sorted(r.id for r in rows.collect()) == list(range(100))
    assert session.dealt(spark.range(0), 16).count() == 0
    n = session.PART_ROWS + 1
    customers = spark.range(n).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"))
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.QUERIES["nested_scalars"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 1 and found.count() == n


def test_candidates_without_a_record_do_not_meet(spark):
    candidates = spark.range(400).select(F.col("id").alias("probe_ord"), F.concat(F.lit("https://h.example/f/"), "id", F.lit(".pdf")).alias("source_url"))
    records = spark.createDataFrame(
        [("r0", 1, '{"core_file_url":"https://h.example/f/7.pdf","core_pdf_filename":"kept.pdf"}'), ("r1", 2, '{"core_file_url":"https://h.example/f/8.pdf","core_pdf_filename":""}')], "source_url string, _seq long, data string"
    )
    files = spark.createDataFrame([("kept.pdf", True, False), ("", True, False), (None, True, False)], "basename string, is_valid boolean, is_small boolean")
    with session.with_settings(spark, spark_sql_adaptive_enabled="false", spark_sql_autoBroadcastJoinThreshold="-1"):
        rows = coverage.spot_checks(candidates, records, files).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 400 and max(sum(r.task == t for r in rows) for t in {r.task for r in rows}) < 200
    got = {r.probe_ord: (r.verdict, r.db_source_url, r.filename) for r in rows if r.verdict != "missing_from_db"}
    assert got == {7: ("present", "r0", "kept.pdf"), 8: ("file_not_downloaded", "r1", "")}
