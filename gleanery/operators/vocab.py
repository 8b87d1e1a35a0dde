"""Controlled vocabularies: trees, exact matches, audits and validated suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import comma_tokens, fold
from gleanery.functions.urls import strip
from gleanery.operators.catalog import merged_histogram
from gleanery.session import checkpointed


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(thesaurus_id, node_id, parent_id, label, ord, path, parent_label); path sorts depth first.

    One join a level against the level before, which is checkpointed, until a level has no nodes; trees of any depth are
    whole. Nodes that no root leads to are left out; a node that is its own ancestor raises ValueError.
    """
    step = F.struct("ord", "node_id")
    base = nodes.select("thesaurus_id", "node_id", "parent_id", "label", "ord")
    level = base.where("parent_id is null").select("*", F.array(step).alias("path"), F.lit(None).cast("string").alias("parent_label"))
    out = level
    while True:
        up = level.select("thesaurus_id", F.col("node_id").alias("parent_id"), F.col("path").alias("above"), F.col("label").alias("parent_label"))
        below = base.join(up, ["thesaurus_id", "parent_id"])
        round_trip = F.exists("above", lambda s: s["node_id"] == F.col("node_id"))
        level = checkpointed(
            below.select("thesaurus_id", "node_id", "parent_id", "label", "ord", F.concat("above", F.array(step)).alias("path"), "parent_label", round_trip.alias("loops"))
        )
        if level.isEmpty():
            return out
        if not level.where("loops").isEmpty():
            raise ValueError("a node of the vocabulary is its own ancestor")
        level = level.drop("loops")
        out = out.unionByName(level)


def numbered(paths: DataFrame) -> DataFrame:
    """paths with depth and position, from 1 in tree order of a thesaurus.

    The nodes of each root are numbered on their own, behind those of the roots before it.
    """
    rooted = paths.withColumn("_root", F.col("path")[0])
    earlier = Window.partitionBy("thesaurus_id").orderBy("_root").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rooted.groupBy("thesaurus_id", "_root").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("thesaurus_id", "_root").orderBy("path"))
    placed = rooted.withColumn("_i", within).join(sizes, ["thesaurus_id", "_root"])
    return placed.select(*paths.columns, F.size("path").alias("depth"), (F.col("_before") + F.col("_i")).cast("int").alias("position"))


def find_label(paths: DataFrame, label: str) -> DataFrame:
    """(thesaurus_id, node_id, path) of the first node of that label in each tree."""
    return paths.where(F.col("label") == label).groupBy("thesaurus_id").agg(F.min_by(F.struct("node_id", "path"), "path").alias("f")).select("thesaurus_id", "f.node_id", "f.path")


def first_leaves(paths: DataFrame) -> DataFrame:
    """(thesaurus_id, path, leaf): for each node, itself included, the label of the first leaf at or below it."""
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    ends = leaves(paths).select("thesaurus_id", "label", F.col("path").alias("at"), F.explode(above).alias("path"))
    return ends.groupBy("thesaurus_id", "path").agg(F.min_by("label", "at").alias("leaf"))


def relationship_labels(existing: DataFrame, template: str, title: str = "title") -> DataFrame:
    """(label, ord): the titles of a template's entities, as the vocabulary of a relationship; the first of equal ones."""
    rows = existing.where((F.col("template") == template) & (F.col(title) != ""))
    return rows.groupBy(F.col(title).alias("label")).agg(F.min("ord").alias("ord"))


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_id is not null").select("thesaurus_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(parents, ["thesaurus_id", "node_id"], "left_anti")


def parent_labels(paths: DataFrame) -> DataFrame:
    """(thesaurus_id, label, parent_label); the last of equal labels in tree order wins."""
    return paths.where("parent_label is not null").groupBy("thesaurus_id", "label").agg(F.max_by("parent_label", "path").alias("parent_label"))


def first_leaf(paths: DataFrame) -> DataFrame:
    """(thesaurus_id, label): the first leaf in tree order."""
    return leaves(paths).groupBy("thesaurus_id").agg(F.min_by("label", "path").alias("label"))


def folded_labels(vocabulary: DataFrame) -> DataFrame:
    """(key, canonical) of a vocabulary (label, ord); the first of equal keys wins."""
    return vocabulary.groupBy(fold(F.col("label")).alias("key")).agg(F.min_by("label", "ord").alias("canonical"))


def exact_match(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """values (crawl_value, n) with canonical and needs_review, by folded equality."""
    joined = values.withColumn("key", fold(F.col("crawl_value"))).join(folded_labels(vocabulary), "key", "left")
    return joined.select("crawl_value", "n", "canonical", F.col("canonical").isNull().alias("needs_review"))


def missing_values(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Values without a label, by falling count."""
    return values.withColumn("key", fold(F.col("crawl_value"))).join(folded_labels(vocabulary), "key", "left_anti").select("crawl_value", "n")


def validate_suggestions(suggestions: DataFrame, values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(crawl_value, canonical_value, needs_review, note): proposals that hold, and what is left for review.

    The first proposal of a value counts. One that names no label is dropped to null and reviewed; a
    value without proposal is reviewed too.
    """
    first = suggestions.withColumn("crawl_value", strip(F.col("crawl_value"))).groupBy("crawl_value").agg(
        F.min_by(F.struct(strip(F.col("suggested")).alias("suggested"), "needs_review"), "ord").alias("s")
    )
    labels = vocabulary.select(F.col("label").alias("suggested")).distinct().withColumn("known", F.lit(True))
    joined = values.select("crawl_value").join(first, "crawl_value", "left").select("crawl_value", "s.suggested", F.col("s.needs_review").alias("asked"), F.col("s").isNotNull().alias("has"))
    joined = joined.join(labels, "suggested", "left")
    known = F.coalesce("known", F.lit(False))
    note = F.when(~F.col("has"), "no suggestion").when(F.col("suggested").isNotNull() & ~known, "not in vocabulary").otherwise("")
    return joined.select(
        "crawl_value",
        F.when(known, F.col("suggested")).alias("canonical_value"),
        (~known | F.coalesce("asked", F.lit(False))).alias("needs_review"),
        note.alias("note"),
    )


def default_audit(defaults: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(property, token, status): each comma-separated default is found or MISSING."""
    tokens = defaults.select("property", F.explode(comma_tokens(F.col("default_value"))).alias("token"))
    joined = tokens.withColumn("key", fold(F.col("token"))).join(folded_labels(vocabulary), "key", "left")
    return joined.select("property", "token", F.when(F.col("canonical").isNull(), "MISSING").otherwise("found").alias("status"))


def last_file_wins(entries: DataFrame) -> DataFrame:
    """(property_name, crawl_value, canonical_value) of mapping files (…, file_ord): a later file overrides."""
    return entries.groupBy("property_name", "crawl_value").agg(F.max_by("canonical_value", "file_ord").alias("canonical_value"))


def _shorter(text: Column) -> Column:
    """The texts that lack one character of a text."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1)))
    return F.when(F.length(text) > 0, cuts).otherwise(F.array().cast("array<string>"))


def deletion_keys(text: Column, distance: int) -> Column:
    """Hashes of a text and of all it becomes by up to ``distance`` deletions: two texts within that edit distance share one."""
    keys = F.array(text)
    for _ in range(distance):
        keys = F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, _shorter))))
    return F.transform(keys, lambda k: F.xxhash64(k))


def fuzzy_candidates(values: DataFrame, vocabulary: DataFrame, distance: int = 2) -> DataFrame:
    """(crawl_value, suggested, distance), always for review: the nearest label by edit distance, up to ``distance``; the first by name of equally near ones.

    An extension without counterpart elsewhere. Texts meet by their deletion neighbourhoods, which miss no pair within the distance and bring together
    only such as agree in all but a few characters; n characters have about n²/2 keys at distance 2. Values are compared once each, however often they occur.
    """
    v = values.select("crawl_value", fold(F.col("crawl_value")).alias("key")).distinct()
    labels = folded_labels(vocabulary).select(F.col("key").alias("label_key"), "canonical")
    met = v.select("key").distinct().withColumn("h", F.explode(deletion_keys(F.col("key"), distance))).join(labels.withColumn("h", F.explode(deletion_keys(F.col("label_key"), distance))), "h")
    near = met.select("key", "label_key", "canonical").distinct().withColumn("d", F.levenshtein("key", "label_key", distance)).where("d >= 0")
    best = near.groupBy("key").agg(F.min(F.struct("d", "canonical")).alias("b"))
    return v.join(best, "key").select("crawl_value", F.col("b.canonical").alias("suggested"), F.col("b.d").alias("distance"))


#: Types of properties whose values come from a vocabulary.
CONTROLLED = ("select", "multiselect", "relationship")


def value_groups(histogram: DataFrame, properties: DataFrame, thesauri: DataFrame) -> DataFrame:
    """(property, value, n, reason): the values to match for each property with a vocabulary, or one row that says why it is skipped.

    ``histogram``: (field, value, n). ``properties``: (property, type, sources array, defaults array, thesaurus_id). ``thesauri``: (thesaurus_id). Counts are summed over a
    property's sources, and its defaults count once at least. Reasons: no_thesaurus, no_values.
    """
    wanted = properties.where(F.col("type").isin(*CONTROLLED)).join(thesauri.select("thesaurus_id", F.lit(True).alias("_known")).distinct(), "thesaurus_id", "left")
    counted = merged_histogram(histogram, wanted.where("_known"))
    out = wanted.join(counted, "property", "left")
    reason = F.when(F.col("_known").isNull(), "no_thesaurus").when(F.col("value").isNull(), "no_values")
    return out.select("property", "value", "n", reason.alias("reason"))
