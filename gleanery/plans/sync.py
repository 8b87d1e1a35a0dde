"""Queries that project records and plan a sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.values import decode_object
from gleanery.operators import mapping as M
from gleanery.operators import plan as P
from gleanery.plans.registry import query
from gleanery.session import dealt, table

MAPPING = M.Mapping(
    properties=(
        M.Property("name", "title", source=("title",)),
        M.Property("day", "date", source=("missing", "day")),
        M.Property("status", "select", source="status"),
        M.Property("page", "link", source="page"),
        M.Property("note", "text", default_value="imported"),
        M.Property("priority", "text", source=("priority",), registry_only=True),
    ),
    shared=("status",),
)


def _orders(spark, sf_dir):
    """(source_url, language, data): orders as records."""
    o = table(spark, sf_dir, "orders")
    payload = F.struct(
        F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("Order "), "o_orderkey")).alias("title"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("https://h.example/o/"), "o_orderkey")).alias("page"),
        F.col("o_orderpriority").alias("priority"),
        F.format_string("Customer#%09d", F.col("o_custkey") * 2).alias("customer"),
        F.when(F.col("o_orderkey") % 8 == 0, "").otherwise(F.concat(F.lit("https://h.example/f/"), "o_orderkey", F.lit(".pdf"))).alias("file"),
    )
    return o.select(
        F.concat(F.lit("https://h.example/r/"), "o_orderkey").alias("source_url"),
        F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("fr").alias("language"),
        F.to_json(payload).alias("data"),
    )


def _status_lookup():
    return F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("filled"))


_ORD = """ord AS (SELECT 'https://h.example/r/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Order ' || o_orderkey END AS title, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'https://h.example/o/' || o_orderkey END AS page, o_orderpriority AS priority, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS customer,
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'https://h.example/f/' || o_orderkey || '.pdf' END AS file, o_orderkey FROM orders)"""


@query(
    f"""WITH {_ORD} SELECT source_url, CASE WHEN title = '' THEN source_url ELSE title END AS title, day,
  CASE WHEN status IS NOT NULL THEN '[{{"value":"' || status || '"}}]' END AS status, CASE WHEN page <> '' THEN '{{"label":"' || page || '","url":"' || page || '"}}' END AS page, 'imported' AS note FROM ord"""
)
def mapping_project(spark, sf_dir):
    payload = F.col("payload")
    rows = M.project(_orders(spark, sf_dir).withColumn("payload", decode_object(F.col("data"))), MAPPING, payload, {"status": _status_lookup()})
    return rows.select("source_url", M.title(MAPPING, payload, F.col("source_url")).alias("title"), *(F.col("metadata")[k].alias(k) for k in ("day", "status", "page", "note")))


@query(f"""WITH {_ORD} SELECT source_url, CASE WHEN status IS NOT NULL THEN 'priority,status' ELSE 'priority' END AS keys, priority FROM ord""")
def registry_project(spark, sf_dir):
    rows = M.project(_orders(spark, sf_dir), MAPPING, decode_object(F.col("data")), {"status": _status_lookup()}, registry=True)
    return rows.select("source_url", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"), F.col("metadata")["priority"].alias("priority"))


@query(
    """SELECT s_suppkey, '[{"value":"' || n_name || '","parent":"' || r_name || '"},{"value":"' || s_name || '"}]' AS wrapped
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def select_wrap(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select("s_suppkey", F.to_json(M.wrap_select(F.array("n_name", F.lit(""), "s_name"), F.create_map("n_name", "r_name"))).alias("wrapped"))


@query("""SELECT c_custkey, '[{"value":"' || CASE WHEN s_suppkey IS NULL THEN s.title ELSE 'id' || s_suppkey END || '"}]' AS related FROM (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS title FROM customer) s LEFT JOIN supplier ON s.title = s_name""")
def relationship_resolve(spark, sf_dir):
    titles = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("Supplier#%09d", "c_custkey").alias("title"))
    ids = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.concat(F.lit("id"), "s_suppkey").alias("id"))
    one = F.when(F.col("id").isNotNull(), F.create_map("title", "id")).otherwise(F.create_map().cast("map<string,string>"))
    return titles.join(ids, "title", "left").select("c_custkey", F.to_json(M.relationship(F.array("title"), one)).alias("related"))


def _indexes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    entity = lambda df: df.select(F.lit("t").alias("template"), F.lit("en").alias("language"), F.col("c_custkey").alias("ord"), F.concat(F.lit("p"), "c_custkey").alias("shared_id"), "c_name")
    primary = P.existing_index(entity(c.where("c_custkey % 3 <> 0")), F.col("c_name"))
    registry = P.existing_index(entity(c.where("c_custkey % 5 = 0")), F.col("c_name"))
    return primary, registry


#: A value of each customer, wrapped as often as its key says, behind list items that lead nowhere.
_NESTED = """nested AS (SELECT c_custkey AS id, repeat('[null,{"label":"x"},{"value":" "},{"value":', CAST(c_custkey % 9 AS INTEGER)) || CASE c_custkey % 6 WHEN 0 THEN '{"url":" ' || c_name || ' ","label":"l"}' WHEN 1 THEN CAST(c_custkey AS VARCHAR)
  WHEN 2 THEN 'true' WHEN 3 THEN '""' WHEN 4 THEN '{"value":null,"url":"u"}' ELSE '"' || c_name || '"' END || repeat('},"later"]', CAST(c_custkey % 9 AS INTEGER)) AS j FROM customer)"""


@query(
    f"""WITH RECURSIVE {_NESTED}, down AS (
  SELECT id, []::INTEGER[] AS path, CAST(j AS JSON) AS v FROM nested
  UNION ALL
  SELECT id, list_append(path, n), CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[' || n || ']') ELSE CASE WHEN json_exists(v, '$.value') THEN json_extract(v, '$.value') WHEN json_type(v, '$.url') = 'VARCHAR' THEN json_extract(v, '$.url') END END
  FROM (SELECT id, path, v, unnest(range(CASE json_type(v) WHEN 'ARRAY' THEN CAST(json_array_length(v) AS INTEGER) ELSE 1 END)) AS n FROM down WHERE json_type(v) IN ('ARRAY', 'OBJECT'))),
leaf AS (SELECT id, path, trim(CASE json_type(v) WHEN 'BOOLEAN' THEN CASE WHEN v = 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string(v, '$') END) AS t FROM down WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT', 'NULL'))
SELECT n.id, arg_min(t, path) AS key FROM nested n LEFT JOIN leaf l ON n.id = l.id AND t <> '' GROUP BY n.id"""
)
def nested_scalars(spark, sf_dir):
    k = F.col("c_custkey")
    name = lambda a, b: F.concat(F.lit(a), F.col("c_name"), F.lit(b))
    leaf = F.when(k % 6 == 0, name('{"url":" ', ' ","label":"l"}')).when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, "true").when(k % 6 == 3, '""').when(k % 6 == 4, '{"value":null,"url":"u"}').otherwise(name('"', '"'))
    times = (k % 9).cast("int")
    wrapped = F.concat(F.lit('{"p":'), F.repeat(F.lit('[null,{"label":"x"},{"value":" "},{"value":'), times), leaf, F.repeat(F.lit('},"later"]'), times), F.lit("}"))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(k.alias("id"), wrapped.alias("metadata"))
    return P.nested_scalar(rows, "metadata", "p").select("id", "key")


def _plan(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    keyed = rows.select("source_url", "language", F.get_json_object("data", "$.file").alias("file_url"), P.key_value(F.col("data"), "customer", F.col("source_url")).alias("key"))
    return P.plan_actions(keyed, *_indexes(spark, sf_dir))


_PLAN = f"""WITH {_ORD}, pri AS (SELECT c_name AS key, 'p' || c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), reg AS (SELECT c_name AS key FROM customer WHERE c_custkey % 5 = 0),
plan AS (
  SELECT source_url, language, file AS file_url, customer AS key,
    CASE WHEN file = '' OR r.key IS NOT NULL THEN 'SKIP' WHEN p.key IS NOT NULL THEN 'CREATE_REGISTRY_ONLY' ELSE 'CREATE' END AS action,
    CASE WHEN file = '' THEN 'no_file_url' WHEN r.key IS NOT NULL THEN 'already_on_registry' END AS skip_reason,
    CASE WHEN file <> '' AND r.key IS NULL THEN p.id END AS primary_shared_id
  FROM ord LEFT JOIN pri p ON customer = p.key LEFT JOIN reg r ON customer = r.key)"""


@query(f"{_PLAN} SELECT * FROM plan")
def plan_actions(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"{_PLAN} SELECT source_url, action, primary_shared_id, CASE WHEN action <> 'SKIP' THEN priority END AS registry_priority, 'm1' AS mapping_sha256, title FROM plan JOIN ord USING (source_url)")
def plan_whole_rows(spark, sf_dir):
    data = F.col("data")
    keyed = _orders(spark, sf_dir).select(
        "source_url", "language", F.get_json_object(data, "$.file").alias("file_url"), P.key_value(data, "customer", F.col("source_url")).alias("key"), F.get_json_object(data, "$.title").alias("title"),
        F.create_map(F.lit("day"), F.get_json_object(data, "$.day")).alias("metadata"), F.create_map(F.lit("priority"), F.get_json_object(data, "$.priority")).alias("registry_metadata"),
    )
    rows = P.plan_rows(keyed, *_indexes(spark, sf_dir), "m1")
    return rows.select("source_url", "action", "primary_shared_id", F.col("registry_metadata")["priority"].alias("registry_priority"), "mapping_sha256", "title")


@query(f"{_PLAN} SELECT language, action, count(*) AS n FROM plan GROUP BY 1, 2")
def plan_action_counts(spark, sf_dir):
    return P.action_counts(_plan(spark, sf_dir))


@query(f"{_PLAN} SELECT skip_reason, count(*) AS n FROM plan WHERE action = 'SKIP' GROUP BY 1")
def plan_skip_reasons(spark, sf_dir):
    return P.skip_reasons(_plan(spark, sf_dir))


@query(f"{_PLAN} SELECT o.source_url, CASE WHEN p.key IS NULL THEN 'create' ELSE 'update' END AS action FROM ord o LEFT JOIN pri p ON o.customer = p.key")
def classify_rows(spark, sf_dir):
    keyed = _orders(spark, sf_dir).select("source_url", P.key_value(F.col("data"), "customer", F.col("source_url")).alias("key"))
    return P.classify_rows(keyed, _indexes(spark, sf_dir)[0]).select("source_url", "action")


@query(
    f"""WITH {_ORD} SELECT source_url, concat_ws(',', CASE WHEN title = '' THEN 'empty_title' END, CASE WHEN page = '' THEN 'missing_required:page' END, CASE WHEN status IS NULL THEN 'missing_required:status' END, CASE WHEN file = '' THEN 'missing_pdf' END) AS issues FROM ord"""
)
def row_issues(spark, sf_dir):
    payload = F.col("payload")
    rows = M.project(_orders(spark, sf_dir).withColumn("payload", decode_object(F.col("data"))), MAPPING, payload, {"status": _status_lookup()})
    rows = rows.withColumns({"title": payload["title"], "key": F.col("source_url"), "file_name": payload["file"]})
    return P.row_issues(rows, ["page", "status"]).select("source_url", F.array_join("issues", ",").alias("issues"))


@query(
    """SELECT name, ord, type, CASE WHEN name = 'p3' THEN NULL ELSE 's' || m END AS source, CASE WHEN name = 'p1' THEN -1 WHEN name = 'p3' THEN 2 ELSE 0 END AS rank
FROM (SELECT 'p' || CAST(r_regionkey AS VARCHAR) AS name, CAST(r_regionkey AS INTEGER) AS ord, CASE WHEN r_regionkey = 1 THEN 'title' ELSE 'text' END AS type FROM region) t
LEFT JOIN (SELECT 'p' || n_regionkey AS target, max(n_nationkey) AS m FROM nation WHERE n_regionkey <> 3 GROUP BY 1) d ON t.name = d.target"""
)
def draft_assembly(spark, sf_dir):
    props = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("int").alias("ord"), F.concat(F.lit("p"), "r_regionkey").alias("name"), F.when(F.col("r_regionkey") == 1, "title").otherwise("text").alias("type"), F.lit(False).alias("required")
    )
    drafts = table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(
        F.concat(F.lit("p"), "n_regionkey").alias("target"), F.concat(F.lit("s"), "n_nationkey").alias("source"), F.lit(None).cast("string").alias("default_value"), F.col("n_nationkey").alias("ord")
    )
    return M.assemble_drafts(drafts, props).select("name", "ord", "type", "source", "rank")
