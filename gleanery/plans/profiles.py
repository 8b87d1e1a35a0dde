"""Queries that profile payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.values import coalesce_sources, coerce_date, decode_object, looks_like_date, looks_like_number, sorted_keys
from gleanery.operators import catalog, store
from gleanery.plans import bindings as B
from gleanery.plans.registry import query
from gleanery.session import table

_LATEST = f"""WITH {B.REC_SQL}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY _seq DESC) AS rn FROM rec) WHERE rn = 1)"""
_CELLS = """cells AS (
  SELECT _seq, 'event_type' AS field, event_type AS value FROM rec WHERE event_type <> ''
  UNION ALL SELECT _seq, 'value', value FROM rec WHERE value <> '' UNION ALL SELECT _seq, 'k', k FROM rec WHERE k <> '')"""


@query(
    f"""{_LATEST} SELECT field, count(*) AS n FROM (SELECT 'event_type' AS field, event_type AS v FROM latest UNION ALL SELECT 'value', value FROM latest UNION ALL SELECT 'k', k FROM latest)
WHERE v IS NOT NULL AND v <> '' GROUP BY field"""
)
def json_field_coverage(spark, sf_dir):
    return catalog.field_coverage(store.upsert_records(B.records(spark, sf_dir)))


@query(f"WITH {B.REC_SQL}, {_CELLS} SELECT field, count(DISTINCT _seq) AS n, min(_seq) AS first_seq FROM cells GROUP BY field ORDER BY n DESC, first_seq, field LIMIT 2")
def json_topk_fields(spark, sf_dir):
    return catalog.top_fields(B.records(spark, sf_dir), 2)


_SAMPLES = f"""WITH {B.REC_SQL}, {_CELLS}, firsts AS (SELECT field, value, min(_seq) AS s FROM cells GROUP BY field, value),
samples AS (SELECT * FROM (SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY s, value) AS INTEGER) AS rank, value FROM firsts) WHERE rank <= 5)"""


@query(f"{_SAMPLES} SELECT field, rank, value FROM samples")
def json_first_n_samples(spark, sf_dir):
    return catalog.first_samples(B.records(spark, sf_dir), 5)


@query(f"WITH {B.REC_SQL}, {_CELLS} SELECT field, value, count(*) AS n FROM cells GROUP BY field, value")
def json_value_histogram(spark, sf_dir):
    return catalog.value_histogram(B.records(spark, sf_dir))


@query(f"{_SAMPLES} SELECT field, CASE WHEN bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'string' END AS value_type FROM samples GROUP BY field")
def value_type_vote(spark, sf_dir):
    return catalog.value_types(catalog.first_samples(B.records(spark, sf_dir), 5))


@query(
    f"""WITH {B.REC_SQL}, {_CELLS}, h AS (SELECT field, value, count(*) AS n FROM cells GROUP BY field, value), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rn FROM h)
SELECT field, value, n FROM r WHERE rn <= 15 UNION ALL SELECT field, NULL, count(*) FROM r WHERE rn > 15 GROUP BY field"""
)
def field_distribution_top15(spark, sf_dir):
    return catalog.distribution(catalog.value_histogram(B.records(spark, sf_dir)))


@query(
    f"""WITH {B.REC_SQL}, {_CELLS}, h AS (SELECT field, value, count(*) AS n FROM cells GROUP BY field, value),
m AS (SELECT 'kind' AS property, value, n FROM h WHERE field IN ('event_type', 'k') UNION ALL SELECT 'kind', 'view', 0 UNION ALL SELECT 'kind', 'never', 0)
SELECT property, value, greatest(CAST(sum(n) AS BIGINT), CASE WHEN value IN ('view', 'never') THEN 1 ELSE 0 END) AS n FROM m GROUP BY property, value"""
)
def histogram_merge_defaults(spark, sf_dir):
    properties = spark.createDataFrame([("kind", ["event_type", "k"], ["view", "never"])], "property string, sources array<string>, defaults array<string>")
    return catalog.merged_histogram(catalog.value_histogram(B.records(spark, sf_dir)), properties)


@query(f"WITH {B.REC_SQL} SELECT _seq, coalesce(CASE WHEN _seq % 3 = 0 THEN k END, CASE WHEN _seq % 3 = 1 THEN value END, event_type) AS chosen FROM rec")
def coalesce_sources_first(spark, sf_dir):
    payload = decode_object(F.col("data"))
    part = lambda key, r: F.when(F.col("_seq") % 3 == r, payload[key]).otherwise("")
    staged = F.create_map(F.lit("a"), part("k", 0), F.lit("b"), part("value", 1), F.lit("c"), payload["event_type"])
    return B.records(spark, sf_dir).select("_seq", coalesce_sources(staged, ["a", "b", "c"]).alias("chosen"))


_DATES = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y')
  WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'on ' || strftime(o_orderdate, '%Y') END AS raw, o_orderdate, o_totalprice FROM orders"""


def _dates(spark, sf_dir):
    d, i = F.col("o_orderdate"), F.col("o_orderkey") % 5
    shape = lambda f: F.date_format(d, f)
    raw = F.when(i == 0, shape("yyyy-MM-dd")).when(i == 1, shape("yyyy/MM/dd")).when(i == 2, shape("dd-MM-yyyy")).when(i == 3, shape("dd/MM/yyyy")).otherwise(F.concat(F.lit("on "), shape("yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN raw ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM ({_DATES})")
def date_coerce(spark, sf_dir):
    return _dates(spark, sf_dir).select("o_orderkey", coerce_date(F.col("raw")).alias("iso"))


@query(
    """SELECT o_orderkey, o_orderkey % 5 = 0 OR o_orderkey % 5 = 4 AS is_date, o_orderkey % 5 IN (1, 2) AS is_number FROM orders"""
)
def value_looks_like(spark, sf_dir):
    d, i = F.col("o_orderdate"), F.col("o_orderkey") % 5
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    raw = F.when(i == 0, F.date_format(d, "yyyy-MM-dd")).when(i == 1, F.concat(F.lit("1,"), price)).when(i == 2, F.concat(F.lit("-"), price, F.lit("e3"))).when(i == 3, F.concat(price, F.lit(" each")))
    raw = raw.otherwise(F.date_format(d, "d/M/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", looks_like_date(raw).alias("is_date"), looks_like_number(raw).alias("is_number"))


@query(f"WITH {B.REC_SQL} SELECT keys, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'event_type, value' ELSE 'event_type, k, value' END AS keys FROM rec) GROUP BY keys")
def payload_key_shapes(spark, sf_dir):
    return B.records(spark, sf_dir).select(sorted_keys(decode_object(F.col("data"))).alias("keys")).groupBy("keys").agg(F.count("*").alias("n"))
