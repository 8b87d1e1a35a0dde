"""Sinks: compacted tables, logs and short reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.store import last_wins, upsert_records

#: A report is for reading: no section of one is longer.
REPORT_ROWS = 200


def compact_records(spark: SparkSession, log_path: str, out_path: str, schema: str) -> None:
    """The last-wins table of an append-only log of records, written by Spark's atomic commit."""
    upsert_records(spark.read.schema(schema).parquet(log_path)).write.mode("overwrite").parquet(out_path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_vocabulary(entries: DataFrame, path: str) -> None:
    """One folder a property, entries in order of the crawled value; nulls are written out, so all columns come back."""
    rows = entries.repartitionByRange("property_name", "crawl_value").sortWithinPartitions("property_name", "crawl_value")
    rows.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("property_name").json(path)


def dry_run(plan: DataFrame) -> DataFrame:
    return plan.groupBy("language", "action").agg(F.count("*").alias("n"))


def json_report(sections: dict[str, DataFrame], path: str) -> None:
    """The same sections whole, one folder of JSON lines each, nulls included, written by tasks."""
    for name, df in sections.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def ensure_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of that schema at path, unless there is one."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    """Markdown of a few aggregates; each is cut at REPORT_ROWS, and says so."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(REPORT_ROWS + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:REPORT_ROWS]]
        if len(rows) > REPORT_ROWS:
            out.append("\n(cut)")
    return "\n".join(out) + "\n"


def merge_latest(current: DataFrame, batch: DataFrame, key: str, order: str = "_seq") -> DataFrame:
    return last_wins(current.unionByName(batch), key, order)
