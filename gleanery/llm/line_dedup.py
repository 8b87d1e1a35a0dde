"""Removal of cross-site boilerplate lines by their spread over distinct sites.

Each line is hashed; HyperLogLog sketches of the sites are built per line hash, combined on the map
side and merged by the aggregation. A line whose estimate is clearly over ``min_sites`` is
boilerplate, one clearly under it is not, and lines near the threshold get an exact count of distinct
sites. Boilerplate lines are then taken out of every document; the rest keeps its order. Both lists of
lines are stored and counted: a short one is broadcast, so that frequent lines need not meet in one task, a long
one is joined by shuffle.

Only the removed positions travel back to the documents, and the kept lines are rebuilt from slices
between them, so the work on a text is linear however many lines go.

Sites are compared as text; a null site is one more site. Lines are the pieces between ``\\n``,
compared after trimming spaces; lines without any other character are never boilerplate.

Edge cases: a null text stays null and an empty one empty, both with one line or none; a document
that is boilerplate throughout ends empty (or whole, with ``keep_above``). Repeated rows count their
site once and get the same result. Null ids are kept. An empty table gives an empty result. Input
columns other than the text are returned as they came, whatever their names; only ``n_lines`` and
``n_removed`` give way to the results of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import row_key, small, spare_names, stored
from gleanery.session import table

MIN_SITES = 8
SKETCH_BITS = 10
#: Lines whose estimate lies within this share of the threshold are counted exactly.
BAND = 0.25


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS, band: float = BAND) -> DataFrame:
    """(line) hashes with at least min_sites distinct sites, out of rows (line, site)."""
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(sketch_bits))).alias("estimate")
    spread = lines.groupBy("line").agg(estimate).where(F.col("estimate") >= min_sites * (1 - band))
    spread = stored(spread, "line-spread")
    sure = F.col("estimate") > min_sites * (1 + band)
    exact = (
        lines.join(small(spread.where(~sure).select("line")), "line", "left_semi")
        .groupBy("line")
        .agg(F.countDistinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line")
    )
    return stored(spread.where(sure).select("line").unionByName(exact), "line-boilerplate")


def _copies_as_one(texts: DataFrame) -> DataFrame:
    """(_text, site) with the least site for all texts of the same lines."""
    whole = F.array_join(F.transform(_lines("_text"), lambda l: F.trim(l)), "\n")
    keys = [F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(17), whole).alias("h2")]
    several = texts.select(*keys, "site").groupBy("h1", "h2").agg(F.min("site").alias("_first"), F.max("site").alias("last")).where("_first < last").drop("last")
    several = stored(several, "line-copies")
    return texts.select("*", *keys).join(small(several), ["h1", "h2"], "left").select("_text", F.coalesce("_first", "site").alias("site"))


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    keep_above: float | None = None,
    copies_once: bool = False,
) -> DataFrame:
    """docs with boilerplate lines gone from the text, and n_lines and n_removed beside it.

    ``keep_above``: a document that would lose more than this share of its characters is left whole,
    as it is a copy of a document rather than a page in a frame; copies are for the near-duplicate
    operators.

    ``copies_once``: documents alike in all lines count as one site, the first, so that being copied does
    not make a document's own lines boilerplate; lines of a frame are taken out of copies as of all others.
    """
    docs = docs.drop("n_lines", "n_removed")
    *key, _gone, _chars, _lines_of, _spans = spare_names([*docs.columns, "n_lines", "n_removed"], "_k1", "_k2", "_gone", "_chars", "_lines", "_spans")
    keyed = docs.withColumns(dict(zip(key, row_key(id_col, text_col), strict=True)))
    cell = lambda line: F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("-")).alias("site")
    seen = _copies_as_one(docs.select(F.col(text_col).alias("_text"), site)) if copies_once else docs.select(F.col(text_col).alias("_text"), site)
    lines = seen.select("site", F.explode(_lines("_text")).alias("l")).select(cell(F.col("l")).alias("line"), "site").where("line is not null")
    bad = boilerplate_lines(lines, min_sites)
    placed = keyed.select(*key, F.posexplode(_lines(text_col)).alias("pos", "l")).select(*key, "pos", F.length("l").alias("chars"), cell(F.col("l")).alias("line"))
    cut = placed.where("line is not null").join(small(bad), "line").groupBy(*key).agg(
        F.array_sort(F.collect_set("pos")).alias(_gone), F.sum("chars").alias(_chars)
    )
    gone = F.col(_gone)
    out = keyed.join(cut, key, "left").withColumn(_lines_of, _lines(text_col))
    if keep_above is not None:
        share = F.col(_chars) / F.greatest(F.length(text_col), F.lit(1))
        out = out.withColumn(_gone, F.when(share <= keep_above, gone))
    # The lines are used more than once below, which keeps the optimiser from splitting the text anew for each slice.
    n = F.size(_lines_of)
    opens = F.concat(F.array(F.lit(1)), F.transform(gone, lambda p: p + 2))
    closes = F.concat(gone, F.array(n))
    out = out.withColumn(_spans, F.arrays_zip(opens.alias("lo"), closes.alias("hi")))
    kept = F.flatten(F.transform(_spans, lambda s: F.slice(F.col(_lines_of), s["lo"], s["hi"] - s["lo"] + 1)))
    return out.withColumns(
        {
            text_col: F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("bigint"),
            "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
        }
    ).select(*docs.columns, "n_lines", "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


ORACLE_OP3 = f"""
WITH lines AS (
  SELECT doc_id, source, text, u.l, u.pos
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS pos) u
), bad AS (
  SELECT trim(l, ' ') AS line FROM lines WHERE trim(l, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT coalesce('=' || source, '-')) >= {MIN_SITES}
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
         string_agg(CASE WHEN b.line IS NULL THEN l END, chr(10) ORDER BY pos) AS text
  FROM lines LEFT JOIN bad b ON trim(l, ' ') = b.line GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": ORACLE_OP3}
