"""Sources: tables that may be absent, file listings, logs, vocabulary files, paged remote entities."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gleanery.functions.text import first_sentence, truncate
from gleanery.functions.urls import strip


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table at path, or an empty one of that schema where there is none."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def records_of_run(records: DataFrame, run: str | None = None) -> DataFrame:
    """Key, time and payload; of one run where it is named (a partition filter where stored that way)."""
    rows = records if run is None else records.where(F.col("task_slug") == run)
    return rows.select("source_url", "scraped_at", "data", "_seq")


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(basename, length[, content]) of regular files in a folder, not below it; bytes are read only if asked for."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = read_or_empty(spark, path, schema, "binaryFile")
    columns = [F.substring_index("path", "/", -1).alias("basename"), "length", *(["content"] if content else [])]
    return files.select(*columns)


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are left out."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents, with their file name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.substring_index(F.input_file_name(), "/", -1))


def read_vocabulary_files(spark: SparkSession, path: str) -> DataFrame:
    """(property_name, crawl_value, canonical_value, file_ord) out of mapping files of plain ``key: value`` lines.

    The files' ``property_name:`` line names the property; indented lines below ``mapping:`` are the
    entries; empty values are null. File order is that of names, so later files can override. What is no such line is skipped.
    """
    lines = spark.read.text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.col("value"))
    quoted = r"""["']?(.*?)["']?"""
    named = lines.withColumn("property_name", F.regexp_extract("value", rf"(?m)^property_name:\s*{quoted}\s*$", 1)).where("property_name <> ''")
    after = F.split("value", r"(?m)^mapping:[^\n]*\n", 2)
    body = named.withColumn("body", F.split(F.get(after, F.lit(1)), r"(?m)^(?=\S)", 2)[0])
    entry = rf"^\s+{quoted}\s*:\s*{quoted}\s*$"
    rows = body.select("file", "property_name", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").rlike(entry))
    return rows.select(
        "property_name",
        F.regexp_extract("line", entry, 1).alias("crawl_value"),
        F.nullif(F.nullif(F.regexp_extract("line", entry, 2), F.lit("")), F.lit("null")).alias("canonical_value"),
        F.col("file").alias("file_ord"),
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(property_name, crawl_value, canonical_value, file_ord) of what ``write_vocabulary`` wrote; empty where there is none."""
    rows = read_or_empty(spark, path, "crawl_value string, canonical_value string, property_name string", "json")
    return rows.select("property_name", "crawl_value", "canonical_value", F.input_file_name().alias("file_ord"))


def read_scenarios(spark: SparkSession, path: str, schema: str, difficulty: str = "difficulty") -> DataFrame:
    """Whole-file JSON documents by rising difficulty, then file name."""
    return read_documents(spark, path, schema).orderBy(difficulty, "file")


# Names and formats of the files of a run, how many of its scripts count, how long a description may be.
TASK_SPLIT = r"^([^/]+)/task_split\.json$"
FLOW_STATE = r"^([^/]+)/flow/state\.json$"
RUN_FILE = r"^([^/]+)/[^/]+\.yaml$"
SCRIPT = r"^([^/]+)/(scripts/\d{4}_\d{2}_\d{2}[^/]*\.py)$"
RAW_SCRIPT = ".raw.py"
DISCOVERY = "__discover__"
STRATEGY = "browser_fetch"
SCRIPTS_A_RUN, LONGEST_TEXT = 6, 2000
SPLIT_SCHEMA = "processing_prompt string, discovery_prompt string, site_overview string, verified_selectors array<string>, pdf_download_strategy string"
STATE_SCHEMA = "plan struct<task_summary string, site_overview string, subtasks array<struct<subtask_id string, kind string, description string, verified_selectors array<string>, pdf_download_strategy string>>>"
RUN_SCHEMA = "task_summary string, discovery_prompt string, processing_prompt string, site_overview string, verified_selectors array<string>, strategy string"


def _run_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, value): the JSON and YAML files below root, each whole, path being relative to root."""
    files = spark.read.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,yaml}").text(root, wholetext=True)
    return files.select(_below(F.col("_metadata.file_path"), root).alias("path"), "value")


def _below(path: Column, root: str) -> Column:
    """A file's path from root on; a listing may spell the root with another scheme, and escapes."""
    bare = root.split(":", 1)[-1].strip("/")
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(plain, r"^.*?\Q/" + bare + r"/\E", "")


def _described(texts: DataFrame) -> DataFrame:
    """(run_name, about): what is known of each run, of its task split, else its flow state, else its file; broken JSON does not count."""
    text, valid = F.col("value"), F.try_parse_json("value").isNotNull()
    none = F.lit(None)
    split = F.from_json(text, SPLIT_SCHEMA)
    state = F.from_json(text, STATE_SCHEMA)["plan"]
    tasks = F.coalesce(state["subtasks"], F.array().cast("array<struct<subtask_id:string,kind:string,description:string,verified_selectors:array<string>,pdf_download_strategy:string>>"))
    last = lambda keep: F.try_element_at(F.transform(F.filter(tasks, keep), lambda t: F.coalesce(t["description"], F.lit(""))), F.lit(-1))
    discovers = lambda t: F.coalesce(t["kind"] == "discovery", F.lit(False))
    prompt = strip(F.regexp_extract(text, r"prompt:\s*\|\s*\n(?s)(.+)", 1))
    kinds = [
        (TASK_SPLIT, valid, first_sentence(F.coalesce(split["processing_prompt"], split["site_overview"], F.lit(""))), split["discovery_prompt"], split["processing_prompt"], split["site_overview"], split["verified_selectors"], split["pdf_download_strategy"]),
        (FLOW_STATE, valid, state["task_summary"], last(discovers), last(lambda t: ~discovers(t)), state["site_overview"], F.flatten(F.transform(tasks, lambda t: F.coalesce(t["verified_selectors"], F.array().cast("array<string>")))), F.get(tasks, F.lit(0))["pdf_download_strategy"]),
        (RUN_FILE, prompt != "", first_sentence(prompt), none, none, none, none, none),
    ]
    names = [f.strip().split(" ")[0] for f in RUN_SCHEMA.split(",")]
    rank = about = None
    for i, (pattern, usable, *values) in enumerate(kinds):
        fits = F.col("path").rlike(pattern) & usable
        struct = F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))).cast("struct<" + RUN_SCHEMA.replace(" string", ":string").replace(" array", ":array") + ">")
        rank, about = (F.when(fits, i), F.when(fits, struct)) if rank is None else (rank.when(fits, i), about.when(fits, struct))
    ranked = texts.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("run_name"), "path", rank.alias("rank"), about.alias("about")).where("rank is not null")
    return ranked.groupBy("run_name").agg(F.min_by("about", F.struct("rank", "path")).alias("about"))


def read_run_tree(spark: SparkSession, root: str, current: str | None = None) -> DataFrame:
    """(run_name, script_path, kind, task_summary, subtask_description, verified_selectors, pdf_download_strategy, status, site_overview) of prior runs.

    Below root each run has a folder of its own; the first few of its dated scripts count, by name. The run that is going on may be left out. A run without
    scripts gives no row, one without a description empty texts. Files are listed and read by tasks; of scripts only the names. An empty file is none.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    paths = listed.select(_below(F.col("path"), root).alias("path")).where(F.col("path").rlike(SCRIPT) & ~F.col("path").endswith(RAW_SCRIPT))
    scripts = paths.select(F.regexp_extract("path", SCRIPT, 1).alias("run_name"), F.regexp_extract("path", SCRIPT, 2).alias("script_path"))
    if current is not None:
        scripts = scripts.where(F.col("run_name") != current)
    nth = F.row_number().over(Window.partitionBy("run_name").orderBy("script_path"))
    kept = scripts.withColumn("_nth", nth).where(F.col("_nth") <= SCRIPTS_A_RUN).drop("_nth")
    kind = F.when(F.contains("script_path", F.lit(DISCOVERY)), "discovery").otherwise("processing")
    a = lambda name: F.col(f"about.{name}")
    text = lambda c: truncate(F.coalesce(c, F.lit("")), LONGEST_TEXT)
    own = F.when(F.col("kind") == "discovery", a("discovery_prompt")).otherwise(a("processing_prompt"))
    return kept.withColumn("kind", kind).join(_described(_run_texts(spark, root)), "run_name", "left").select(
        "run_name", "script_path", "kind",
        text(a("task_summary")).alias("task_summary"),
        text(first_sentence(F.coalesce(own, a("task_summary")))).alias("subtask_description"),
        F.coalesce(a("verified_selectors"), F.array().cast("array<string>")).alias("verified_selectors"),
        F.coalesce(a("strategy"), F.lit(STRATEGY)).alias("pdf_download_strategy"),
        F.lit("unknown").alias("status"),
        text(a("site_overview")).alias("site_overview"),
    )


class _Language(InputPartition):
    def __init__(self, language: str):
        super().__init__(language)


class _EntityReader(DataSourceReader):
    """One partition a language; pages until a short one.

    Equality and IN on a column go to the fetch function as lists of values, and are tested again on what it gives.
    """

    def __init__(self, fetch, languages: list[str], page_size: int):
        self.fetch, self.languages, self.page_size = fetch, languages, page_size
        self.wanted: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.wanted[f.attribute[0]] = [f.value]
            elif isinstance(f, In) and len(f.attribute) == 1:
                self.wanted[f.attribute[0]] = list(f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Language(x) for x in self.languages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start = 0
        while True:
            page = self.fetch(partition.value, start, self.page_size, self.wanted)
            for i, (template, shared_id, metadata) in enumerate(page):
                yield template, partition.value, start + i, shared_id, metadata
            if len(page) < self.page_size:
                return
            start += self.page_size


def register_entities(spark: SparkSession, name: str, fetch, languages: list[str], page_size: int = 100) -> None:
    """Makes ``spark.read.format(name)`` read remote entities page by page.

    ``fetch(language, start, size, filters)`` gives a list of (template, shared_id, metadata JSON).
    """

    class Entities(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "template string, language string, ord int, shared_id string, metadata string"

        def reader(self, schema) -> DataSourceReader:
            return _EntityReader(fetch, languages, page_size)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Entities)
