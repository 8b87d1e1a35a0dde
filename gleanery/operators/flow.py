"""Flow state and action logs: dependencies, streaks, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import checkpointed


def blocked(subtasks: DataFrame, done: tuple[str, ...] = ("done",)) -> DataFrame:
    """(subtask_id, waiting_for): subtasks that depend on others not done, or not there."""
    needs = subtasks.select("subtask_id", F.explode("depends_on").alias("waiting_for"))
    states = subtasks.select(F.col("subtask_id").alias("waiting_for"), F.col("status").alias("state"))
    return needs.join(states, "waiting_for", "left").where(~F.coalesce(F.col("state").isin(*done), F.lit(False))).select("subtask_id", "waiting_for")


def _peeled(edges: DataFrame) -> DataFrame:
    """The edges (subtask_id, need) on cycles, or on paths between two: those left when ends without needs, or without dependents, are taken off again and again."""
    left = checkpointed(edges)
    n = left.count()
    while n:
        needing, needed = left.select(F.col("subtask_id").alias("need")).distinct(), left.select(F.col("need").alias("subtask_id")).distinct()
        left = checkpointed(left.join(needing, "need", "left_semi").join(needed, "subtask_id", "left_semi").select("subtask_id", "need"))
        before, n = n, left.count()
        if n == before:
            break
    return left


def resolved(subtasks: DataFrame, done: tuple[str, ...] = ("done",), failed: tuple[str, ...] = ("failed",)) -> DataFrame:
    """(subtask_id, outcome, cause, steps) of subtasks (subtask_id, depends_on, status): what a flow that resumes does with each.

    ``cyclic``: it needs itself. ``aborted``: it failed, or a need is absent, failed, cyclic or aborted, however far down; cause is the nearest such id (the least
    of several) and steps how many needs away. A subtask is aborted even if it is done. Of the others ``kept`` are done, ``ready`` have all needs done, and
    ``waiting`` need one that is not. Each round is one join of the needs with those newly reached, so there are as many as the longest chain has links.
    """
    edges = checkpointed(subtasks.select("subtask_id", F.explode("depends_on").alias("need")).where("need is not null").distinct())
    states = subtasks.select("subtask_id", "status")
    absent = edges.select(F.col("need").alias("subtask_id")).join(states, "subtask_id", "left_anti").distinct()
    loops = _peeled(edges)
    cyclic = loops.select("subtask_id").union(loops.select("need")).distinct()
    broken = states.where(F.col("status").isin(*failed)).select("subtask_id").union(absent).union(cyclic).distinct()
    front = checkpointed(broken.select("subtask_id", F.col("subtask_id").alias("cause"), F.lit(0).alias("steps")))
    reached = front
    while not front.isEmpty():
        up = front.select(F.col("subtask_id").alias("need"), "cause", (F.col("steps") + 1).alias("steps"))
        fresh = edges.join(up, "need").groupBy("subtask_id").agg(F.min("cause").alias("cause"), F.min("steps").alias("steps"))
        front = checkpointed(fresh.join(reached, "subtask_id", "left_anti"))
        reached = reached.unionByName(front)
    open_needs = edges.join(states.where(F.col("status").isin(*done)).select(F.col("subtask_id").alias("need")), "need", "left_anti").select("subtask_id").distinct()
    marked = (
        states.join(reached, "subtask_id", "left")
        .join(cyclic.withColumn("_cyclic", F.lit(True)), "subtask_id", "left")
        .join(open_needs.withColumn("_open", F.lit(True)), "subtask_id", "left")
    )
    outcome = F.when(F.col("_cyclic"), "cyclic").when(F.col("cause").isNotNull(), "aborted").when(F.col("status").isin(*done), "kept").when(F.col("_open"), "waiting").otherwise("ready")
    aborted = F.col("outcome") == "aborted"
    return marked.withColumn("outcome", outcome).select("subtask_id", "outcome", F.when(aborted, F.col("cause")).alias("cause"), F.when(aborted, F.col("steps")).alias("steps"))


def with_specs(specs: DataFrame, states: DataFrame) -> DataFrame:
    """Planned subtasks with the state that is on record, pending where there is none."""
    return specs.join(states.select("subtask_id", F.col("status").alias("_s")), "subtask_id", "left").withColumn("status", F.coalesce("_s", F.lit("pending"))).drop("_s")


def eta(jobs: DataFrame) -> DataFrame:
    """(job, remaining, seconds): what is left of each job, and how long at the mean time of what is done; null before that."""
    left = F.count_if(~F.col("done")).alias("remaining")
    mean = F.avg(F.when(F.col("done"), F.col("seconds"))).alias("mean")
    return jobs.groupBy("job").agg(left, mean).select("job", "remaining", (F.col("mean") * F.col("remaining")).alias("seconds"))


def streaks(log: DataFrame, key: str, order: str, hit: str) -> DataFrame:
    """log with streak: how many rows in a row, up to this one, have ``hit`` true within a key."""
    along = Window.partitionBy(key).orderBy(order)
    island = F.sum((~F.col(hit)).cast("int")).over(along)
    return log.withColumn("_island", island).withColumn("streak", F.sum(F.col(hit).cast("int")).over(Window.partitionBy(key, "_island").orderBy(order))).drop("_island")


def longest_streak(log: DataFrame, key: str, order: str, hit: str) -> DataFrame:
    return streaks(log, key, order, hit).groupBy(key).agg(F.max("streak").alias("longest"))


def repeats(log: DataFrame, key: str, order: str, action: str, within: int = 8) -> DataFrame:
    """log with repeated: was the same action among the ``within`` before it?"""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-within, -1)
    return log.withColumn("repeated", F.array_contains(F.collect_list(action).over(before), F.col(action)))


def head_and_tail(rows: DataFrame, key: str, order: str, n: int = 25) -> DataFrame:
    """The first and last n rows of each key, all where there are no more than twice that."""
    by = Window.partitionBy(key)
    placed = rows.withColumns({"_i": F.row_number().over(by.orderBy(order)), "_n": F.count("*").over(by)})
    return placed.where((F.col("_i") <= n) | (F.col("_i") > F.col("_n") - n)).drop("_i", "_n")
