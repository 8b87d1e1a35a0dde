"""Declarative projection of payloads into typed target entities, compiled to Columns."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.urls import strip
from gleanery.functions.values import coalesce_sources, coerce_date, list_items, python_text
from gleanery.operators.vocab import first_leaves, leaves

#: What remote property types mean here; other ``multi*`` types are multiselect, the rest text.
TYPES = ("title", "date", "text", "numeric", "select", "multiselect", "markdown", "relationship", "link", "file", "skipped")
OUTSIDE_METADATA = ("title", "skipped", "file")


def field_type(name: str) -> str:
    return name if name in TYPES else "multiselect" if name.startswith("multi") else "text"


@dataclass(frozen=True)
class Property:
    """One target property: where its value comes from and what it becomes."""

    name: str
    type: str = "text"
    source: tuple[str, ...] | str | None = None
    default_value: str | None = None
    required: bool = False
    registry_only: bool = False

    def sources(self) -> list[str]:
        return [] if self.source is None else [self.source] if isinstance(self.source, str) else list(self.source)


@dataclass(frozen=True)
class Mapping:
    """A projection: properties, the key field, and what a registry shares. Unknown fields are refused by the constructor."""

    properties: tuple[Property, ...]
    key_field: str | None = None
    key_property: str | None = None
    registry_template: str | None = None
    registry_key: str | None = None
    registry_link: str | None = None
    shared: tuple[str, ...] = field(default=())
    #: Registry properties that are filled when a row is sent, not here.
    sent_later: tuple[str, ...] = field(default=())

    def __post_init__(self):
        given = [v is not None for v in (self.registry_template, self.registry_key, self.registry_link)]
        if any(given) and not all(given):
            raise ValueError("registry settings: all or none")
        names = [p.name for p in self.properties]
        if len(set(names)) < len(names):
            raise ValueError("a property is mapped twice")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def load(spark: SparkSession, path: str) -> Mapping:
    """The mapping in a JSON file of any store, as strict as :func:`from_dict`."""
    return from_dict(json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def from_dict(spec: dict) -> Mapping:
    """Strict: a key that the dataclasses do not know raises."""
    return Mapping(**{**spec, "properties": tuple(Property(**p) for p in spec.get("properties", ())), **{k: tuple(spec[k]) for k in ("shared", "sent_later") if k in spec}})


def resolved(prop: Property, payload: Column, lookup: Column | None = None) -> Column:
    """The text of one property: its default where it has no source, else the first value that is not empty.

    ``lookup``: a map from crawled to canonical values; with one, what it lacks becomes null.
    """
    if prop.source is None:
        default = F.lit(prop.default_value).cast("string")
        return coerce_date(default) if prop.type == "date" else default
    value = coalesce_sources(payload, prop.sources())
    if lookup is not None:
        value = lookup[strip(value)]
    return coerce_date(value) if prop.type == "date" else value


def wrap_select(values: Column, parents: Column | None = None) -> Column:
    """[{value, parent?}] of a list of labels; the empty list as null."""
    item = lambda v: F.struct(v.alias("value"), (parents[v] if parents is not None else F.lit(None).cast("string")).alias("parent"))
    clean = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(clean) > 0, F.transform(clean, item))


def wrap_link(value: Column) -> Column:
    return F.when(value != "", F.struct(value.alias("label"), value.alias("url")))


def relationship(values: Column, ids: Column) -> Column:
    """[{value}] with the id of each title, a title without one as it is."""
    return F.transform(values, lambda v: F.struct(F.coalesce(ids[v], v).alias("value")))


def coerced(prop: Property, payload: Column, lookups: dict[str, Column], parents: Column | None = None, ids: Column | None = None) -> Column:
    """JSON text of one property in its target shape, null where there is nothing."""
    lookup = lookups.get(prop.name)
    if prop.type in ("select", "multiselect", "relationship"):
        raw = F.lit(prop.default_value).cast("string") if prop.source is None else coalesce_sources(payload, prop.sources())
        items = F.transform(list_items(raw), strip)
        if prop.source is not None and lookup is not None:
            items = F.transform(items, lambda v: lookup[v])
        if prop.type == "relationship":
            return F.to_json(relationship(F.filter(items, lambda v: v.isNotNull() & (v != "")), ids if ids is not None else F.create_map().cast("map<string,string>")))
        return F.to_json(wrap_select(items, parents))
    value = resolved(prop, payload, lookup)
    if prop.type == "link":
        return F.to_json(wrap_link(value))
    text = python_text(value) if prop.type == "text" else value
    return F.when(text != "", text)


def project(records: DataFrame, mapping: Mapping, payload: Column, lookups: dict[str, Column] | None = None, registry: bool = False, **shapes) -> DataFrame:
    """records with ``metadata``, a map of property to JSON text without nulls.

    The primary projection leaves registry-only properties out; the registry one takes shared and registry-only ones.
    The payload is decoded in a projection of its own, so once a record however many properties there are.
    """
    decoded = "payload"
    while decoded in records.columns:
        decoded = "_" + decoded
    staged = records.select("*", payload.alias(decoded))
    wanted = [
        p
        for p in mapping.properties
        if p.type not in OUTSIDE_METADATA and ((p.registry_only or p.name in mapping.shared) and p.name not in mapping.sent_later if registry else not p.registry_only)
    ]
    cells = [F.struct(F.lit(p.name).alias("key"), coerced(p, F.col(decoded), lookups or {}, **shapes).alias("value")) for p in wanted]
    entries = F.array(*cells) if cells else F.array().cast("array<struct<key:string,value:string>>")
    filled = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return staged.withColumn("metadata", filled).drop(decoded)


def title(mapping: Mapping, payload: Column, source_url: Column) -> Column:
    """The first title source that is not empty, else the record's URL."""
    sources = [s for p in mapping.properties if p.type == "title" for s in p.sources()]
    return F.coalesce(coalesce_sources(payload, sources), source_url) if sources else source_url


def assemble_drafts(drafts: DataFrame, template_props: DataFrame) -> DataFrame:
    """(ord, name, type, source, required, rank): the last draft of each template property, in stable order.

    Titles come first, then sourced ones, defaults, and what is ignored.
    """
    last = drafts.groupBy("target").agg(F.max_by(F.struct("source", "default_value"), "ord").alias("d"))
    joined = template_props.join(last.withColumnRenamed("target", "name"), "name", "left")
    rank = F.when(F.col("type") == "title", -1).when(F.col("d.source").isNotNull(), 0).when(F.col("d.default_value").isNotNull(), 1).otherwise(2)
    return joined.select("ord", "name", "type", F.col("d.source").alias("source"), F.col("d.default_value").alias("default_value"), "required", rank.alias("rank"))


def assemble_templates(drafts: DataFrame, primary: DataFrame, primary_name: str, registry: DataFrame, registry_name: str) -> DataFrame:
    """(ord, name, type, templates, source, default_value, required, rank) of the properties of two templates (ord, name, type, required).

    A property of both, by name, is one entry that names both templates; what only the registry has is an entry of its own, for which only drafts count that are
    meant for it. The registry's title is not mapped, as its entities take over the primary's. ``drafts``: (target, template, source, default_value, ord); the last of a target counts.
    """
    extra = registry.where("type <> 'title'")
    tagged = assemble_drafts(drafts, primary).join(extra.select("name", F.lit(True).alias("_both")), "name", "left")
    names = F.when(F.col("_both"), F.array(F.lit(primary_name), F.lit(registry_name))).otherwise(F.array(F.lit(primary_name)))
    own = assemble_drafts(drafts.where(F.col("template") == registry_name), extra.join(primary.select("name"), "name", "left_anti"))
    both = tagged.withColumn("templates", names).drop("_both").unionByName(own.withColumn("templates", F.array(F.lit(registry_name))))
    return both.select("ord", "name", "type", "templates", "source", "default_value", "required", "rank")


def uncovered(template_props: DataFrame, mapped: DataFrame) -> DataFrame:
    """Template properties, titles aside, that no mapping covers."""
    return template_props.where("type <> 'title'").join(mapped.select("name"), "name", "left_anti")


def fill_defaults(mapped: DataFrame, template_props: DataFrame, paths: DataFrame) -> DataFrame:
    """mapped (name, source, default_value, notes) with what it lacks, and with group labels moved to leaves.

    ``template_props``: (name, type, required, thesaurus_id). ``paths``: trees from :func:`gleanery.operators.vocab.tree_paths`.
    Each property without a mapping, titles aside, gets one without source; required selects get their
    vocabulary's first leaf as default. A default that is no leaf but a group of its vocabulary becomes the first leaf below the
    first group of that label, and the notes say so.
    """
    leaf_of = first_leaves(paths)
    first = leaf_of.groupBy("thesaurus_id").agg(F.min_by("leaf", "path").alias("first"))
    wants = F.col("required") & F.col("type").isin("select", "multiselect")
    fresh = uncovered(template_props, mapped).join(first, "thesaurus_id", "left").select(
        "name", F.lit(None).cast("string").alias("source"), F.when(wants, F.col("first")).alias("default_value"), F.lit("no scraped field for this property").alias("notes")
    )
    every = mapped.select("name", "source", "default_value", "notes").unionByName(fresh)
    known = leaves(paths).select("thesaurus_id", F.col("label").alias("default_value")).distinct().withColumn("is_leaf", F.lit(True))
    groups = paths.groupBy("thesaurus_id", F.col("label").alias("default_value")).agg(F.min("path").alias("path")).join(leaf_of, ["thesaurus_id", "path"]).drop("path")
    keyed = every.join(template_props.select("name", "thesaurus_id"), "name", "left").join(known, ["thesaurus_id", "default_value"], "left").join(groups, ["thesaurus_id", "default_value"], "left")
    moved = F.col("is_leaf").isNull() & F.col("leaf").isNotNull() & (F.col("leaf") != F.col("default_value"))
    note = F.concat_ws("; ", F.nullif(F.col("notes"), F.lit("")), F.concat(F.lit("default moved from group "), F.col("default_value"), F.lit(" to leaf "), F.col("leaf")))
    return keyed.select("name", "source", F.when(moved, F.col("leaf")).otherwise(F.col("default_value")).alias("default_value"), F.when(moved, note).otherwise(F.col("notes")).alias("notes"))
