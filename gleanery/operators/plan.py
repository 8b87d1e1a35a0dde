"""The sync plan: what to create, what to skip and why, and what is wrong with a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import file_ext, file_filename, pdf_filename, strip
from gleanery.functions.values import get_or_blank
from gleanery.session import checkpointed


def existing_index(existing: DataFrame, key: Column) -> DataFrame:
    """(key, shared_id) over all languages; the first entity of a key wins; blank keys are left out."""
    keyed = existing.withColumn("key", F.trim(key.cast("string"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("shared_id", F.struct("language", "ord")).alias("shared_id"))


def key_value(data: Column, key_field: str | None, source_url: Column) -> Column:
    """The record's key field if it has one (an empty text counts), else its URL."""
    return F.coalesce(F.get_json_object(data, f"$.{key_field}"), source_url) if key_field else source_url


#: Levels of nesting that are gone down between two looks whether any are left.
LEVELS = 6


def _container(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return kind.startswith("ARRAY") | kind.startswith("OBJECT")


def _below(v: Column) -> Column:
    """What a nested value leads to, in order: the items of a list, an object's value or else its url, a scalar itself."""
    kind = F.schema_of_variant(v)
    value, url = F.try_variant_get(v, "$.value", "variant"), F.try_variant_get(v, "$.url", "variant")
    named = F.when(value.isNotNull(), F.array(value)).when(F.schema_of_variant(url) == "STRING", F.array(url))
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.coalesce(named, F.array().cast("array<variant>"))).otherwise(F.array(v))


def _printed(v: Column) -> Column:
    """A scalar as text, stripped; blank and null ones are null. Truth values are spelt with a capital."""
    text = F.try_variant_get(v, "$", "string")
    return F.nullif(strip(F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text)).otherwise(text)), F.lit(""))


def nested_scalar(rows: DataFrame, metadata: str, name: str, out: str = "key") -> DataFrame:
    """rows with ``out``, the first scalar in property ``name`` of a JSON column: lists and values within values are gone down to any depth.

    An object counts by its ``value``, or without one by its ``url`` if that is a text. Among the items of a list the first that leads to anything wins. A broken
    document, an absent property and blank texts give null. Every level is a step over the values left in a row, so
    rows are not shuffled. What is left is stored every ``LEVELS`` levels and then looked at, so no level is worked out twice.
    """
    left = "_left" + out
    rows = rows.withColumn(left, F.array_compact(F.array(F.try_variant_get(F.try_parse_json(metadata), f"$['{name}']", "variant"))))
    while True:
        for _ in range(LEVELS):
            rows = rows.withColumn(left, F.flatten(F.transform(left, _below)))
        rows = checkpointed(rows)
        if rows.where(F.exists(left, _container)).isEmpty():
            return rows.withColumn(out, F.get(F.filter(F.transform(left, _printed), lambda t: t.isNotNull()), F.lit(0))).drop(left)


def plan_actions(records: DataFrame, primary: DataFrame, registry: DataFrame | None = None, has_key: bool = True) -> DataFrame:
    """records (source_url, file_url, key, ...) with action, skip_reason and primary_shared_id.

    ``primary``, ``registry``: indexes from :func:`existing_index`. The planner never updates.
    """
    blank = F.trim(F.coalesce("key", F.lit(""))) == ""
    joined = records.withColumn("_k", F.trim("key")).join(primary.select(F.col("key").alias("_k"), F.col("shared_id").alias("_p")), "_k", "left")
    in_primary, in_registry = F.col("_p").isNotNull(), F.lit(False)
    if registry is not None:
        joined = joined.join(registry.select(F.col("key").alias("_k"), F.col("shared_id").alias("_r")), "_k", "left")
        in_registry = F.col("_r").isNotNull()
    no_file = F.coalesce("file_url", F.lit("")) == ""
    keyed = F.lit(has_key) & ~blank
    reason = F.when(no_file, "no_file_url").when(keyed & in_registry, "already_on_registry")
    if registry is None:
        reason = reason.when(keyed & in_primary, "already_on_primary")
    action = F.when(reason.isNotNull(), "SKIP")
    if registry is not None:
        action = action.when(keyed & in_primary, "CREATE_REGISTRY_ONLY")
    action = action.otherwise("CREATE")
    return joined.select(
        *records.columns, action.alias("action"), reason.alias("skip_reason"), F.when(action == "CREATE_REGISTRY_ONLY", F.col("_p")).alias("primary_shared_id")
    )


def classify_rows(records: DataFrame, primary: DataFrame) -> DataFrame:
    """The other reading: update where the key exists, else create."""
    known = primary.select("key", F.lit(True).alias("_known"))
    return records.join(known, "key", "left").select(*records.columns, F.when(F.col("_known"), "update").otherwise("create").alias("action"))


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("language", "action").agg(F.count("*").alias("n"))


def skip_reasons(plan: DataFrame) -> DataFrame:
    return plan.where("action = 'SKIP'").groupBy("skip_reason").agg(F.count("*").alias("n"))


def row_issues(rows: DataFrame, required: list[str], upload_pdf: bool = True) -> DataFrame:
    """rows (title, key, file_name, metadata map, ...) with issues, an array of texts."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    checks = [F.when(blank(F.col("title")), "empty_title"), F.when(blank(F.col("key")), "empty_key")]
    checks += [F.when(F.coalesce(F.col("metadata")[p], F.lit("")) == "", f"missing_required:{p}") for p in required]
    if upload_pdf:
        checks.append(F.when(blank(F.col("file_name")), "missing_pdf"))
    return rows.withColumn("issues", F.array_compact(F.array(*checks)))


def attachments(pdf: Column, html: Column, supporting: Column) -> Column:
    """[{filename, kind}] of the files a row has; names cut to 255, kind by suffix, BIN where unknown."""
    suffix = lambda c: F.upper(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    one = lambda c: F.when(c != "", F.struct(F.left(c, F.lit(255)).alias("filename"), F.when(suffix(c) == "", "BIN").otherwise(suffix(c)).alias("kind")))
    return F.array_compact(F.array(one(pdf), one(html), one(supporting)))


def with_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """records (source_url, data) with pdf_name, html_name and supporting_name, those of their files that are on disk.

    A file goes by the name the record has, else by the name derived from its URL. Office documents are
    supporting files, all others the PDF; a name that says there is none counts only through the URL.
    """
    url, name, page = (get_or_blank(F.col("data"), f"core_{k}") for k in ("file_url", "pdf_filename", "html_filename"))
    office, none = file_ext(name) != "", F.trim(name).startswith("no-pdf")
    wants = {
        "pdf_own": F.when(~office & ~none, name),
        "pdf_derived": F.when(~office & (url != ""), pdf_filename(url)),
        "html_own": page,
        "supporting_own": F.when(office & ~none, name),
        "supporting_derived": F.when(office & ~none & (url != ""), file_filename(url)),
    }
    on_disk = files.select("basename").distinct()
    named = records.withColumns({f"_{k}": F.nullif(F.trim(c), F.lit("")) for k, c in wants.items()})
    for k in wants:
        named = named.join(on_disk.select(F.col("basename").alias(f"_{k}"), F.col("basename").alias(f"_has_{k}")), f"_{k}", "left")
    return named.select(
        *records.columns,
        F.coalesce("_has_pdf_own", "_has_pdf_derived").alias("pdf_name"),
        F.col("_has_html_own").alias("html_name"),
        F.coalesce("_has_supporting_own", "_has_supporting_derived").alias("supporting_name"),
    )


def plan_rows(projected: DataFrame, primary: DataFrame, registry: DataFrame | None, mapping_sha256: str) -> DataFrame:
    """Whole plan rows out of records (source_url, language, key, file_url, title, metadata, registry_metadata, file names).

    What is skipped has no registry metadata, nor has any row without a registry.
    """
    planned = plan_actions(projected, primary, registry)
    kept = F.when(F.col("action") != "SKIP", F.col("registry_metadata")) if registry is not None else F.lit(None)
    return planned.withColumns({"registry_metadata": kept.cast(projected.schema["registry_metadata"].dataType), "mapping_sha256": F.lit(mapping_sha256)})


def issue_counts(rows: DataFrame) -> DataFrame:
    """(action, n, with_issues) of rows that carry an action and issues."""
    return rows.groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.size("issues") > 0).alias("with_issues"))


def registry_enrich(plan: DataFrame, content: str = "content", now: Column | None = None, link: str = "primary_shared_id") -> DataFrame:
    """What is filled when a row is sent: epoch seconds, the link to the primary entity, the document's SHA-256."""
    linked = F.when(F.col(link).isNotNull(), F.array(F.struct(F.col(link).alias("value"))))
    return plan.withColumns({"registry_date": F.unix_timestamp() if now is None else F.unix_timestamp(now), "registry_link": linked, "document_hash": F.sha2(F.col(content), 256)})
