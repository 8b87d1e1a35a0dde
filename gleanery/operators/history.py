"""Message histories: token estimates and the plan that trims one to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import estimate_tokens
from gleanery.operators.summaries import Summarisers

BUDGET = 28_000
SHORT = 1000
#: bucket -> how many of the latest stay, in order of trimming.
KEEP = {"thinking": 2, "snapshot": 2, "validation": 1, "other": 1}


def part_tokens(messages: DataFrame) -> DataFrame:
    """messages with tokens: plain response text is free, a tool call costs its name and its arguments."""
    text = estimate_tokens(F.col("content"))
    tokens = F.when(F.col("kind") == "response_text", 0).when(F.col("kind") == "tool_call", estimate_tokens(F.col("tool_name")) + text).otherwise(text)
    return messages.withColumn("tokens", tokens.cast("bigint"))


def conversation_tokens(messages: DataFrame) -> DataFrame:
    return part_tokens(messages).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))


def trim_bucket(kind: Column, tool_name: Column, content: Column, snapshot_tools: tuple[str, ...], validation_tools: tuple[str, ...]) -> Column:
    """The bucket of a part that may be trimmed: thinking, or a long tool return by its tool; null for what always stays."""
    long = (kind == "tool_return") & (F.length(content) >= SHORT)
    tool = F.when(tool_name.isin(*snapshot_tools), "snapshot").when(tool_name.isin(*validation_tools), "validation").otherwise("other")
    return F.when(kind == "thinking", "thinking").when(long, tool)


def trim_plan(parts: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """(…, priority) of the parts that may be trimmed: all but the latest few of each bucket.

    ``parts``: (conv_id, turn, part_ord, bucket, tokens); the bucket of what never goes is null.
    """
    keep = keep or KEEP
    latest = F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy(F.desc("turn"), F.desc("part_ord")))
    kept = priority = F.lit(None)
    for i, (bucket, n) in enumerate(keep.items()):
        kept = F.when(F.col("bucket") == bucket, n).otherwise(kept)
        priority = F.when(F.col("bucket") == bucket, i).otherwise(priority)
    return parts.withColumns({"nth": latest, "priority": priority}).where(F.col("nth") > kept).drop("nth")


def budget_cut(plan: DataFrame, totals: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The trims that are needed: in order of priority and turn until a conversation fits its budget.

    ``plan``: (conv_id, turn, part_ord, priority, saving). ``totals``: (conv_id, tokens).
    """
    before = Window.partitionBy("conv_id").orderBy("priority", "turn", "part_ord").rowsBetween(Window.unboundedPreceding, -1)
    saved = F.coalesce(F.sum("saving").over(before), F.lit(0))
    return plan.join(totals, "conv_id").withColumn("saved", saved).where(F.col("tokens") - F.col("saved") > budget).select(*plan.columns)


def overflow_tail(messages: DataFrame, last: int = 6) -> DataFrame:
    """The last few messages of each conversation, without tool calls left open at the end."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("part_ord")))
    recent = messages.withColumn("back", back).where(F.col("back") <= last)
    closed = F.max((F.col("kind") != "tool_call").cast("int")).over(Window.partitionBy("conv_id").orderBy("back"))
    return recent.withColumn("_closed", closed).where("_closed = 1").drop("back", "_closed")


PART = ["conv_id", "turn", "part_ord"]


def compacted(
    messages: DataFrame, snapshot_tools: tuple[str, ...] = (), validation_tools: tuple[str, ...] = (), budget: int = BUDGET, summarisers: Summarisers | None = None, keep: dict[str, int] | None = None
) -> DataFrame:
    """messages with summaries in place of what has to go until a conversation fits its budget, and ``trimmed``: soft, hard or null.

    ``messages``: (conv_id, turn, part_ord, kind, tool_name, content). In order of bucket and turn all but the latest few parts are summarised; if that
    is not enough, all snapshots but the last are summarised harder. What counts as saved is the tokens of a text less those of its summary.
    """
    summarisers, keep = summarisers or Summarisers(), keep or KEEP
    parts = messages.withColumn("bucket", trim_bucket(F.col("kind"), F.col("tool_name"), F.col("content"), snapshot_tools, validation_tools)).where("bucket is not null")
    parts = parts.select(*PART, "bucket", "tool_name", "content")
    soft, hard = trim_plan(parts, keep), trim_plan(parts.where("bucket = 'snapshot'"), {"snapshot": 1}).withColumn("priority", F.lit(len(keep)))
    saving = lambda before, after: (estimate_tokens(before) - estimate_tokens(after)).alias("saving")
    eased = soft.join(summarisers.applied(soft, PART), PART)
    current = F.coalesce(F.col("eased"), F.col("content"))
    strict = hard.join(summarisers.applied(hard, PART, hard=True), PART).join(eased.select(*PART, F.col("summary").alias("eased")), PART, "left").where(F.length(current) >= SHORT)
    plan = eased.select(*PART, "priority", "summary", saving(F.col("content"), F.col("summary"))).unionByName(strict.select(*PART, "priority", "summary", saving(current, F.col("summary"))))
    cut = budget_cut(plan, conversation_tokens(messages), budget).groupBy(*PART).agg(F.max_by("summary", "priority").alias("_summary"), F.max("priority").alias("_last"))
    trimmed = F.when(F.col("_last") == len(keep), "hard").when(F.col("_last").isNotNull(), "soft")
    return messages.join(cut, PART, "left").withColumns({"content": F.coalesce("_summary", "content"), "trimmed": trimmed}).select(*messages.columns, "trimmed")


def running_ledger(calls: DataFrame) -> DataFrame:
    """calls (conv_id, turn, tokens_in, tokens_out) with running sums."""
    along = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumns({"sum_in": F.sum("tokens_in").over(along), "sum_out": F.sum("tokens_out").over(along)})
