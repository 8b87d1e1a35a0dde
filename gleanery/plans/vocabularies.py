"""Queries on controlled vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import vocab
from gleanery.plans.registry import query
from gleanery.session import table


def _tree(spark, sf_dir):
    """region -> nation -> supplier, as a vocabulary tree."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("int").alias("ord"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("int").alias("ord"))
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("label"), F.col("s_suppkey").cast("int").alias("ord")
    )
    return r.unionByName(n).unionByName(s).withColumn("thesaurus_id", F.lit("geo"))


_TREE = """tree AS (
  SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS label, CAST(r_regionkey AS INTEGER) AS ord FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, s_suppkey FROM supplier)"""


@query(f"WITH {_TREE} SELECT 'geo' AS thesaurus_id, node_id, label FROM tree WHERE node_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)")
def thesaurus_leaves(spark, sf_dir):
    return vocab.leaves(_tree(spark, sf_dir)).select("thesaurus_id", "node_id", "label")


@query(f"WITH {_TREE} SELECT 'geo' AS thesaurus_id, c.label, p.label AS parent_label FROM tree c JOIN tree p ON c.parent_id = p.node_id")
def thesaurus_parents(spark, sf_dir):
    return vocab.parent_labels(vocab.tree_paths(_tree(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {_TREE}, walk AS (SELECT node_id, label, [ord] AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.node_id, t.label, list_append(w.path, t.ord) FROM walk w JOIN tree t ON t.parent_id = w.node_id)
SELECT node_id, label, CAST(len(path) AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS position FROM walk"""
)
def thesaurus_flatten(spark, sf_dir):
    return vocab.numbered(vocab.tree_paths(_tree(spark, sf_dir))).select("node_id", "label", "depth", "position")


def _values(spark, sf_dir):
    """Crawled values: part names in mixed case with spaces about them."""
    p = table(spark, sf_dir, "part")
    spelt = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_name"))
    return p.select(spelt.alias("crawl_value")).groupBy("crawl_value").agg(F.count("*").alias("n"))


def _vocabulary(spark, sf_dir):
    """Labels: names of parts with few enough pieces."""
    return table(spark, sf_dir, "part").where("p_size < 3").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("ord"))


_VALUES = """vals AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_name) ELSE p_name END AS crawl_value, count(*) AS n FROM part GROUP BY 1),
voc AS (SELECT p_name AS label, min(p_partkey) AS ord FROM part WHERE p_size < 3 GROUP BY 1), keys AS (SELECT lower(trim(label)) AS key, arg_min(label, ord) AS canonical FROM voc GROUP BY 1)"""


@query(f"WITH {_VALUES} SELECT crawl_value, n, canonical, canonical IS NULL AS needs_review FROM vals LEFT JOIN keys ON lower(trim(crawl_value)) = key")
def vocab_exact_match(spark, sf_dir):
    return vocab.exact_match(_values(spark, sf_dir), _vocabulary(spark, sf_dir))


@query(f"WITH {_VALUES} SELECT crawl_value, n FROM vals WHERE lower(trim(crawl_value)) NOT IN (SELECT key FROM keys)")
def vocab_missing(spark, sf_dir):
    return vocab.missing_values(_values(spark, sf_dir), _vocabulary(spark, sf_dir))


_SUGGEST = """sug AS (SELECT trim(p_name) AS crawl_value, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'no such label' ELSE NULL END AS suggested, p_partkey % 5 = 0 AS needs_review, p_partkey AS ord FROM part)"""


@query(
    f"""WITH {_VALUES}, {_SUGGEST}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_value ORDER BY ord) AS rn FROM sug) WHERE rn = 1)
SELECT v.crawl_value, CASE WHEN c.label IS NOT NULL THEN f.suggested END AS canonical_value, c.label IS NULL OR coalesce(f.needs_review, false) AS needs_review,
  CASE WHEN f.crawl_value IS NULL THEN 'no suggestion' WHEN f.suggested IS NOT NULL AND c.label IS NULL THEN 'not in vocabulary' ELSE '' END AS note
FROM vals v LEFT JOIN first f ON v.crawl_value = f.crawl_value LEFT JOIN voc c ON f.suggested = c.label"""
)
def vocab_suggestion_validate(spark, sf_dir):
    i = F.col("p_partkey")
    proposal = F.when(i % 3 == 0, F.col("p_name")).when(i % 3 == 1, "no such label")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("crawl_value"), proposal.alias("suggested"), (i % 5 == 0).alias("needs_review"), i.alias("ord"))
    return vocab.validate_suggestions(rows, _values(spark, sf_dir), _vocabulary(spark, sf_dir))


@query(
    f"""WITH {_VALUES}, t AS (SELECT p_brand AS property, trim(unnest(string_split(p_name || ', ' || upper(p_type) || ',', ','))) AS token FROM part)
SELECT property, token, CASE WHEN lower(token) IN (SELECT key FROM keys) THEN 'found' ELSE 'MISSING' END AS status FROM t WHERE token <> ''"""
)
def default_token_audit(spark, sf_dir):
    defaults = table(spark, sf_dir, "part").select(F.col("p_brand").alias("property"), F.concat("p_name", F.lit(", "), F.upper("p_type"), F.lit(",")).alias("default_value"))
    return vocab.default_audit(defaults, _vocabulary(spark, sf_dir))


@query("SELECT p_brand AS property_name, p_name AS crawl_value, arg_max(p_type, p_partkey) AS canonical_value FROM part GROUP BY 1, 2")
def vocab_last_file_wins(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("property_name"), F.col("p_name").alias("crawl_value"), F.col("p_type").alias("canonical_value"), F.col("p_partkey").alias("file_ord"))
    return vocab.last_file_wins(entries)


#: Misspelt nations: each supplier's with a character lost, doubled or exchanged somewhere, or with its first and last gone.
_MISSPELT = """wrong AS (SELECT s_suppkey AS id, n_name AS name, CAST(s_suppkey % length(n_name) AS INTEGER) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey),
spelt AS (SELECT DISTINCT CASE id % 5 WHEN 0 THEN left(name, i) || substr(name, i + 2) WHEN 1 THEN left(name, i) || substr(name, i + 1, 1) || substr(name, i + 1) WHEN 2 THEN lower(left(name, i)) || '#' || substr(name, i + 2) WHEN 3 THEN substr(name, 2, length(name) - 2) ELSE reverse(name) END AS crawl_value FROM wrong),
labels AS (SELECT n_name AS label FROM nation UNION SELECT r_name FROM region)"""


@query(
    f"""WITH {_MISSPELT}, d AS (SELECT crawl_value, label, levenshtein(lower(trim(crawl_value)), lower(label)) AS d FROM spelt, labels)
SELECT crawl_value, arg_min(label, {{'d': d, 'l': label}}) AS suggested, CAST(min(d) AS INTEGER) AS distance FROM d WHERE d <= 2 GROUP BY crawl_value"""
)
def fuzzy_labels(spark, sf_dir):
    wrong = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    i, name, k = F.col("i"), F.col("n_name"), F.col("s_suppkey") % 5
    spelt = (
        F.when(k == 0, F.concat(F.left(name, i), F.substr(name, i + 2)))
        .when(k == 1, F.concat(F.left(name, i), F.substr(name, i + 1, F.lit(1)), F.substr(name, i + 1)))
        .when(k == 2, F.concat(F.lower(F.left(name, i)), F.lit("#"), F.substr(name, i + 2)))
        .when(k == 3, F.substr(name, F.lit(2), F.length(name) - 2))
        .otherwise(F.reverse(name))
    )
    values = wrong.withColumn("i", (F.col("s_suppkey") % F.length("n_name")).cast("int")).select(spelt.alias("crawl_value")).distinct()
    labels = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label")).union(table(spark, sf_dir, "region").select("r_name")).distinct()
    return vocab.fuzzy_candidates(values, labels.withColumn("ord", F.lit(0)))


_GROUPS = """hist AS (SELECT 'f' || (o_custkey % 4) AS field, o_orderpriority || (o_orderkey % 7) AS value, count(*) AS n FROM orders GROUP BY 1, 2),
props AS (SELECT 'p' || n_nationkey AS property, CASE n_nationkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'select' WHEN 2 THEN 'multiselect' ELSE 'relationship' END AS type, CASE WHEN n_nationkey % 5 = 0 THEN ['nowhere'] ELSE ['f' || (n_nationkey % 4), 'f' || (n_nationkey % 3)] END AS sources,
  CASE WHEN n_nationkey % 7 = 1 THEN ['1-URGENT0', n_name] ELSE [] END AS defaults, 't' || (n_nationkey % 6) AS thesaurus_id FROM nation),
wanted AS (SELECT * FROM props WHERE type <> 'text'), known AS (SELECT 't' || r_regionkey AS thesaurus_id FROM region),
merged AS (SELECT property, value, n FROM (SELECT property, unnest(sources) AS field FROM wanted) JOIN hist USING (field) UNION ALL SELECT property, unnest(defaults), 0 FROM wanted),
counted AS (SELECT property, value, greatest(sum(n), 1) AS n FROM merged GROUP BY 1, 2)"""


@query(
    f"""WITH {_GROUPS} SELECT w.property, c.value, CAST(c.n AS BIGINT) AS n, CASE WHEN k.thesaurus_id IS NULL THEN 'no_thesaurus' WHEN c.value IS NULL THEN 'no_values' END AS reason
FROM wanted w LEFT JOIN known k ON w.thesaurus_id = k.thesaurus_id LEFT JOIN counted c ON w.property = c.property AND k.thesaurus_id IS NOT NULL"""
)
def vocabulary_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    histogram = o.groupBy(F.concat(F.lit("f"), F.col("o_custkey") % 4).alias("field"), F.concat("o_orderpriority", F.col("o_orderkey") % 7).alias("value")).agg(F.count("*").alias("n"))
    i = F.col("n_nationkey")
    field = lambda n: F.concat(F.lit("f"), i % n)
    props = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), i).alias("property"),
        F.when(i % 4 == 0, "text").when(i % 4 == 1, "select").when(i % 4 == 2, "multiselect").otherwise("relationship").alias("type"),
        F.when(i % 5 == 0, F.array(F.lit("nowhere"))).otherwise(F.array(field(4), field(3))).alias("sources"),
        F.when(i % 7 == 1, F.array(F.lit("1-URGENT0"), F.col("n_name"))).otherwise(F.array().cast("array<string>")).alias("defaults"),
        F.concat(F.lit("t"), i % 6).alias("thesaurus_id"),
    )
    thesauri = table(spark, sf_dir, "region").select(F.concat(F.lit("t"), "r_regionkey").alias("thesaurus_id"))
    return vocab.value_groups(histogram, props, thesauri)
