"""Secret scan by multipart credential linking, in DataFrame functions only.

Parts of a credential are found by kind, with code-point positions: identifiers, secrets and
endpoints, strong or weak. Strong parts (the base kinds) are always reported. A weak part counts only
where complementary parts co-occur in its scope: a weak secret needs an identifier, a weak
identifier a secret, an endpoint both, each starting within ``reach`` code points. A scope is a
run of lines between blank lines.

The linking is an interval join on (row, scope, bucket of ``reach`` code points): parts are first
folded to the smallest and largest start of each role in a bucket, and a weak part looks those up in
its own bucket and the two beside it. So it gives no pairs of parts, and the largest group is what
three buckets of one scope hold.

Positions come from splitting a text at a pattern: pieces and matches alternate, so a running sum
of their lengths gives each start.

Edge cases: a null or empty text has no spans. Repeated rows get the same spans, worked out once.
Null ids are kept. Ties at one start go by the order of ``KINDS``. An empty table gives an empty
result; further columns are not read. A weak part that overlaps a base span is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import row_key, stored, whole_text
from gleanery.session import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
WEAK_ID = r"""(?<![A-Za-z0-9])(?i:(?:access|client|account|tenant|user)[_-]?(?:key[_-]?)?(?:id|name)|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{4,}+)"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?<![A-Za-z0-9])(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|s?ftp)://([^\x20\x09-\x0D"'<>]+)"""
BREAK = r"\n\x20*\n()"

#: kind -> pattern with one group, role, base or not, least length of the group
KINDS = {
    "assign": (ASSIGN, "secret", True, 8),
    "access": (f"({ACCESS})", "id", True, 0),
    "hex": (f"({HEX})", "secret", True, 0),
    "weak_id": (WEAK_ID, "id", False, 0),
    "weak_secret": (f"({WEAK_SECRET})", "secret", False, 0),
    "endpoint": (ENDPOINT, "endpoint", False, 0),
}
BASE_KINDS = tuple(k for k, v in KINDS.items() if v[2])
RANK = {k: i for i, k in enumerate(KINDS)}
REACH = 400
#: Any text with a part holds one of these; the others are dropped after one cheap pass.
HINT = "|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT))


def _by_kind(value: int) -> Column:
    out = F.lit(None)
    for kind, spec in KINDS.items():
        out = F.when(F.col("kind") == kind, F.lit(spec[value])).otherwise(out)
    return out


def find_parts(docs: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, kind, start, end) of every part and scope break, one row each; keys are distinct rows."""
    patterns = {**{k: v[0] for k, v in KINDS.items()}, "break": BREAK}
    text = F.col(text_col)
    parts = docs.select(
        *key,
        F.array(
            *(
                F.struct(
                    F.lit(kind).alias("kind"),
                    F.arrays_zip(
                        F.split(text, p).alias("piece"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("value")
                    ).alias("cells"),
                )
                for kind, p in patterns.items()
            )
        ).alias("found"),
    )
    cells = parts.select(*key, F.explode("found").alias("f")).where(F.size("f.cells") > 1).select(*key, "f.kind", F.posexplode("f.cells").alias("i", "cell"))
    sized = cells.select(
        *key,
        "kind",
        "i",
        F.length("cell.piece").alias("gap"),
        F.length("cell.match").alias("size"),
        F.length("cell.value").alias("value_size"),
    )
    run = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(run)
    return (
        sized.withColumn("end", end.cast("bigint"))
        .where(F.col("size").isNotNull() & (F.col("value_size") >= F.coalesce(_by_kind(3), F.lit(0))))
        .select(*key, "kind", (F.col("end") - F.col("size")).cast("bigint").alias("start"), "end")
    )


def link_parts(parts: DataFrame, key: list[str], reach: int = REACH) -> DataFrame:
    """Base parts, and the weak ones whose complements start within ``reach`` in their scope."""
    along = Window.partitionBy(*key).orderBy("start", "end", "kind")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    base = F.coalesce(_by_kind(2), F.lit(False))
    placed = (
        parts.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("base", base)
        .withColumn("base_before", F.max(F.when(base, F.col("end"))).over(before))
        .withColumn("base_after", F.min(F.when(base, F.col("start"))).over(after))
        .where("kind <> 'break' and (base or (coalesce(base_before, 0) <= start and coalesce(base_after, end) >= end))")
        .select(*key, "kind", "start", "end", "base", "scope", F.floor(F.col("start") / reach).alias("bucket"), _by_kind(1).alias("role"))
    )
    roles = ("id", "secret", "endpoint")
    folded = placed.groupBy(*key, "scope", "bucket").agg(
        *(F.min(F.when(F.col("role") == r, F.col("start"))).alias(f"first_{r}") for r in roles),
        *(F.max(F.when(F.col("role") == r, F.col("start"))).alias(f"last_{r}") for r in roles),
    )
    weak = placed.where("not base").select(*key, "scope", "kind", "start", "end", "role", F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1)))).alias("bucket"))
    near = lambda r: F.max(
        F.when((F.col(f"first_{r}") <= F.col("start") + reach) & (F.col(f"last_{r}") >= F.col("start") - reach), 1).otherwise(0)
    ).alias(f"near_{r}")
    linked = (
        weak.join(folded, [*key, "scope", "bucket"])
        .groupBy(*key, "kind", "start", "end", "role")
        .agg(*(near(r) for r in roles))
        .where("(role = 'secret' and near_id = 1) or (role = 'id' and near_secret = 1) or (role = 'endpoint' and near_id = 1 and near_secret = 1)")
    )
    return placed.where("base").select(*key, "kind", "start", "end").unionByName(linked.select(*key, "kind", "start", "end"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id_col, spans) for each row; spans are sorted structs (start, rank, kind, end)."""
    keyed = docs.select(F.col(id_col), whole_text(text_col).alias("text"), *row_key(id_col, text_col))
    key = ["k1", "k2"]
    hits = keyed.where(F.col("text").rlike(HINT)).select(*key, "text")
    hits = hits.groupBy(*key).agg(F.first("text").alias("text"))
    # Stored, as linking reads the parts three times.
    spans = link_parts(stored(find_parts(hits, key), "secret-parts"), key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", _rank().alias("rank"), "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return keyed.drop("text").join(spans, key, "left").select(id_col, F.coalesce("spans", empty).alias("spans"))


def _rank() -> Column:
    out = F.lit(None)
    for kind, rank in RANK.items():
        out = F.when(F.col("kind") == kind, F.lit(rank)).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
