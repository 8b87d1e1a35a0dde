"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Text becomes a template: lower-case words without punctuation, with typed placeholders for numbers,
units after numbers, and names (capitalised words inside a sentence). A window of ``WINDOW`` tokens has up to two
keys: the hash of its template, if that holds ``LEAST_WORDS`` words or more, and the hash of its plain tokens. Two
windows match if they share a key. An item is leaked if ``containment`` of its windows match windows of a
document. An item with fewer tokens than a window is one window of its own length, and documents are read
in windows of that length too.

Slots are checked for consistency: along one alignment of an item with a document, one value of the item must
always meet the same value in the document, within the windows that match. Where it does not, windows
that match by template alone do not count; those alike in plain tokens do. So a re-parameterised question is found, a chance
mix of numbers is not, and a word put into a copy costs only the windows about it.

Both steps are hash joins over every position of every document. The first looks for a few windows of each item
only: of m windows with k asked for, any document with k of them holds one of m - k + 1, so the m - k + 1 that the
fewest other items share are enough, and phrases that many items have are left out wherever that can be. The second
step takes all windows of the pairs that were found. Slots are told apart by grouping, so no text is carried to an item. Results
grow with the pairs that match: a template that many items share gives a pair for each of them.

Edge cases: a null or empty text has no tokens and matches nothing. Repeated rows give their pair once.
Null ids are kept, of documents and items. Repeated items count once; an id with two texts is two items. An empty
table on either side gives no pairs. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import row_key, small, stored, whole_text
from gleanery.session import table

WINDOW = 5
LEAST_WORDS = 2
CONTAINMENT = 0.8

#: Windows with their tokens go to all executors up to this many.
BROADCAST_WINDOWS = 1 << 17

NUM, UNIT, NAME = "\ue001", "\ue002", "\ue003"
_NAME = r"(?<=[\p{Ll},;:\d] )\p{Lu}\p{Ll}+"
#: Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "mi", "ft", "in", "mg", "g", "kg", "lb", "lbs", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "minutes",
    "seconds", "days", "weeks", "months", "years", "meters", "metres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres",
    "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh",
)
_UNIT = rf"(?<=\d)\x20?(?i:({'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\d])"


def with_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """df with ``t`` and ``r`` for its text: template and plain tokens, alike in number; and whether they differ.

    Each step is a column of its own, so that no pattern runs twice; no pattern repeats a choice, which would recurse.
    """
    marks = f"[{UNIT}{NAME}]"
    keep = [c for c in df.columns if c != text_col]
    spaced = F.regexp_replace(text_col, rf"[\s{NUM}-{NAME}]+", " ")
    named = F.regexp_replace(spaced, _NAME, NAME + "$0").alias("_t")
    unit = F.when(F.col("_t").rlike(r"\d"), F.regexp_replace("_t", _UNIT, f" {UNIT}$1")).otherwise(F.col("_t")).alias("_t")
    other = rf"[^\p{{L}}\p{{M}}\d.,{UNIT}{NAME}]"
    gap = rf"(?:{other}|[.,](?!\d)|(?<!\d)[.,]){other}*+"
    parted = F.regexp_replace(F.lower("_t"), gap, " ").alias("_t")
    marked = F.trim(F.when(F.contains(F.col("_t"), F.lit("  ")), F.regexp_replace("_t", "\x20{2,}", " ")).otherwise(F.col("_t"))).alias("_m")
    typed = F.when(F.col("_m").rlike(marks), F.regexp_replace("_m", rf"({marks})\S+", "$1")).otherwise(F.col("_m")).alias("_t")
    number = F.when(F.col("_t").rlike(r"\d"), F.regexp_replace("_t", r"(?<!\S)\d\S*", NUM)).otherwise(F.col("_t")).alias("_t")
    plain = F.when(F.col("_m").rlike(marks), F.regexp_replace("_m", marks, "")).otherwise(F.col("_m")).alias("_r")
    cut = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    steps = df.select(*keep, named).select(*keep, unit).select(*keep, parted).select(*keep, marked).select(*keep, "_m", typed).select(*keep, plain, number)
    return steps.select(*keep, cut("_t").alias("t"), cut("_r").alias("r"), (F.col("_t") != F.col("_r")).alias("differ"))


def _window(tokens: str, at: Column, size: int) -> list[Column]:
    return [F.get(tokens, at + j) for j in range(size)]


def _words(cells: list[Column]) -> Column:
    return sum((F.when(c.isin(NUM, UNIT, NAME), 0).otherwise(1) for c in cells), F.lit(0))


def _starts(size: int) -> Column:
    last = F.size("t") - size
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def document_keys(tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """(k1, k2, key) of every window of every document."""

    def of_size(n: int) -> Column:
        plain = F.transform(_starts(n), lambda i: F.xxhash64(*_window("r", i, n)))
        typed = F.transform(_starts(n), lambda i: F.when(_words(_window("t", i, n)) >= LEAST_WORDS, F.xxhash64(*_window("t", i, n))))
        return F.when(F.col("differ"), F.concat(typed, plain)).otherwise(plain)

    return tokens.select("k1", "k2", F.explode(F.concat(*map(of_size, sizes))).alias("key")).where("key is not null")


def windows(tokens: DataFrame, columns: list[str], sizes: list[int]) -> DataFrame:
    """(columns, at, wt, wr): place, template and plain tokens of every window of the given sizes."""

    def of_size(n: int) -> Column:
        return F.transform(_starts(n), lambda i: F.struct(i.alias("at"), F.array(*_window("t", i, n)).alias("wt"), F.array(*_window("r", i, n)).alias("wr")))

    cells = map(of_size, sizes)
    return tokens.select(*columns, F.explode(F.concat(*cells)).alias("w")).select(*columns, "w.at", "w.wt", "w.wr")


def with_keys(rows: DataFrame) -> DataFrame:
    """rows once for each key of their window."""
    words = F.size(F.filter("wt", lambda c: ~c.isin(NUM, UNIT, NAME)))
    keys = F.array_distinct(F.array_compact(F.array(F.when(words >= LEAST_WORDS, F.xxhash64("wt")), F.xxhash64("wr"))))
    return rows.select("*", F.explode(keys).alias("key"))


def item_windows(items: DataFrame, window: int = WINDOW, containment: float = CONTAINMENT) -> tuple[DataFrame, list[int]]:
    """(item, item_id, m, need, at, wt, wr, key, seed) for each window and key of each item, and the sizes of windows.

    ``seed``: whether documents are searched for it.
    """
    text = whole_text("text")
    named = items.select("item_id", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("\x00null")), text).alias("item"), text.alias("_text")).distinct()
    tokens = stored(with_tokens(named, "_text").where(F.size("t") > 0), "benchmark-tokens")
    size = F.least(F.size("t"), F.lit(window)).alias("size")
    sizes = sorted(r.size for r in tokens.select(size).distinct().collect())
    cells = [windows(tokens.where(F.size("t") >= n if n == window else F.size("t") == n), ["item", "item_id", "t"], [n]) for n in sizes]
    rows = cells[0] if cells else windows(tokens, ["item", "item_id", "t"], [window])
    for more in cells[1:]:
        rows = rows.unionByName(more)
    m = F.greatest(F.size("t") - window + 1, F.lit(1))
    rows = rows.select("item", "item_id", m.alias("m"), F.ceil(m * containment - 1e-9).cast("int").alias("need"), "at", "wt", "wr")
    keyed = with_keys(rows)
    shared = keyed.groupBy("key").agg(F.countDistinct("item").alias("items"))
    common = keyed.join(shared, "key").groupBy("item", "at").agg(F.max("items").alias("items"))
    rarest = F.row_number().over(Window.partitionBy("item").orderBy("items", "at")).alias("nth")
    ranked = keyed.join(common.select("item", "at", rarest), ["item", "at"])
    return stored(ranked.withColumn("seed", F.expr("nth <= m - need + 1")).drop("nth"), "benchmark-windows"), sizes or [window]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(id_col, item_id, n_windows, n_matched, containment, n_slots, reparameterised) of each leak.

    ``n_slots``: distinct slots (value of the item, value of the document) in what counts; ``reparameterised``: too few
    windows are alike in plain tokens.
    """
    items, sizes = item_windows(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), window, containment)
    key, pair = ["k1", "k2"], ["k1", "k2", "item"]
    keyed = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"), *row_key(id_col, text_col))
    probes = items.where("seed").select("key", "item").distinct()
    hits = document_keys(with_tokens(keyed.select(*key, "_text"), "_text"), sizes).join(small(probes), "key").select(*pair).distinct()
    # Stored and counted: where hits are few they go to the documents, whose texts then stay where they are.
    hits = stored(hits, "leak-hits")
    asked = keyed.join(small(hits.select(*key).distinct()), key, "left_semi").dropDuplicates(key)
    rows = with_keys(windows(with_tokens(asked, "_text"), ["_id", *key], sizes).withColumnRenamed("at", "n"))
    mine = items.select("item", "key", "m", "need", "item_id", "at", F.col("wt").alias("it"), F.col("wr").alias("ir"))
    found = rows.join(small(hits), key).join(small(mine, most=BROADCAST_WINDOWS), ["item", "key"])
    found = found.select("_id", *pair, "item_id", "m", "need", "at", (F.col("n") - F.col("at")).alias("shift"), (F.col("wr") == F.col("ir")).alias("alike"), "wt", "wr", "it", "ir")
    found = stored(found.dropDuplicates([*pair, "at", "shift"]), "leak-windows")

    cells = found.select(*pair, "shift", F.explode(F.arrays_zip("wt", "wr", "it", "ir")).alias("c")).where(F.col("c.wt").isin(NUM, UNIT, NAME) & (F.col("c.wt") == F.col("c.it")))
    slots = cells.select(*pair, "shift", F.col("c.wt").alias("kind"), F.col("c.ir").alias("of_item"), F.col("c.wr").alias("of_doc")).distinct()
    mixed = slots.groupBy(*pair, "shift", "kind", "of_item").agg(F.count("*").alias("n")).where("n > 1").select(*pair, "shift").distinct()
    n_slots = slots.join(mixed, [*pair, "shift"], "left_anti").groupBy(*pair).agg(F.countDistinct("kind", "of_item", "of_doc").alias("n_slots"))
    counted = found.join(mixed.withColumn("mixed", F.lit(True)), [*pair, "shift"], "left").where("alike or mixed is null")
    n_windows = F.col("m").cast("bigint")
    return (
        counted.groupBy("_id", *pair, "item_id", "m", "need")
        .agg(F.countDistinct("at").alias("n_matched"), F.countDistinct(F.when(F.col("alike"), F.col("at"))).alias("n_alike"))
        .where("n_matched >= need")
        .join(n_slots, pair, "left")
        .select(
            F.col("_id").alias(id_col),
            "item_id",
            n_windows.alias("n_windows"),
            "n_matched",
            (F.col("n_matched") / n_windows).alias("containment"),
            F.coalesce("n_slots", F.lit(0).cast("bigint")).alias("n_slots"),
            (F.col("n_alike") < F.col("need")).alias("reparameterised"),
        )
        .distinct()
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
