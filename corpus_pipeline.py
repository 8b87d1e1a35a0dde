"""A small training-data pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, jaccard, lang_id, line_dedup, packing
from gleanery.llm.common import small, stored
from gleanery.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``_row``, a hash of id and text: decisions go by it, so two texts of one id, or of none, are two documents."""
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("_row"))


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """keyed less the rows of a stored list; it is sent to all executors only if short."""
    return keyed.join(small(rows), "_row", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letters, or no text, or is far from every language; unlabelled documents get a language."""
    found = lang_id.predict(docs, lang_id.fit(docs), list(COLUMNS))
    return found.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site lines out of the texts; drops no document, and a null text stays null. Copies count as one site: they are left to the join."""
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS), copies_once=True)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar ones, that of the smallest id (none is the largest); of repeated rows, one.

    A null or empty text resembles nothing and stays. An empty table stays empty.
    """
    keyed = _keyed(docs)
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    found = stored(jaccard.jaccard_components(keyed.select(named.alias("named"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT, id_col="named"), "pipeline-components")
    kept = _without(keyed, stored(found.where("component_id <> named").select(F.col("named.row").alias("_row")).distinct(), "pipeline-copies"))
    again = stored(found.groupBy(F.col("named.row").alias("_row")).count().where("count > 1").select("_row"), "pipeline-repeated")
    if not again.isEmpty():
        first = F.row_number().over(Window.partitionBy("_row").orderBy("source", "lang", "n_chars"))
        repeated = kept.join(small(again), "_row", "left_semi").withColumn("_nth", first).where("_nth = 1").drop("_nth")
        kept = _without(kept, again).unionByName(repeated)
    return kept.select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; a null text holds none, and an empty benchmark drops nothing."""
    keyed = _keyed(docs)
    leaks = decontaminate.find_leaks(keyed.select("_row", "text"), table(spark, sf_dir, "benchmark"), id_col="_row")
    return _without(keyed, stored(leaks.select("_row").distinct(), "pipeline-leaks")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids; an empty text is its closing id."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("pack", pack),
]

#: SQL has no k-means, n-gram model or tokenizer; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
