"""Queries on message histories, searches, logs and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.text import estimate_tokens
from gleanery.operators import flow, history, search, sqlgate
from gleanery.plans.registry import query
from gleanery.session import table

TASK = "Collect the documents listed under thousand reports with anonther inthere tionable"

_KIND = "CASE role WHEN 'assistant' THEN CASE WHEN turn % 2 = 1 THEN 'tool_call' ELSE 'response_text' END ELSE 'user' END"
_TOK = "CAST(CASE WHEN kind = 'response_text' THEN 0 WHEN kind = 'tool_call' THEN length('lookup_tool') // 4 + length(text) // 4 ELSE length(text) // 4 END AS BIGINT)"
_MSG = f"msg AS (SELECT conv_id, turn, text, role, {_KIND} AS kind FROM conversations), tok AS (SELECT *, {_TOK} AS tokens FROM msg)"


def _messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") != "assistant", "user").when(F.col("turn") % 2 == 1, "tool_call").otherwise("response_text")
    return c.select("conv_id", "turn", F.lit(0).alias("part_ord"), kind.alias("kind"), F.lit("lookup_tool").alias("tool_name"), F.col("text").alias("content"), "role")


@query(f"WITH {_MSG} SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM tok GROUP BY conv_id")
def history_tokens(spark, sf_dir):
    return history.conversation_tokens(_messages(spark, sf_dir))


_BUCKET = "CASE role WHEN 'assistant' THEN 'snapshot' WHEN 'user' THEN 'thinking' END"
_TRIM = f"""WITH {_MSG}, b AS (SELECT conv_id, turn, {_BUCKET} AS bucket, CAST(length(text) // 4 AS BIGINT) AS saving FROM msg),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bucket ORDER BY turn DESC) AS nth, CASE bucket WHEN 'thinking' THEN 0 WHEN 'snapshot' THEN 1 END AS priority FROM b WHERE bucket IS NOT NULL),
plan AS (SELECT conv_id, turn, bucket, saving, priority FROM r WHERE nth > 2)"""


def _trims(spark, sf_dir):
    bucket = F.when(F.col("role") == "assistant", "snapshot").when(F.col("role") == "user", "thinking")
    parts = _messages(spark, sf_dir).select("conv_id", "turn", "part_ord", bucket.alias("bucket"), estimate_tokens(F.col("content")).alias("saving"))
    return history.trim_plan(parts)


@query(f"{_TRIM} SELECT * FROM plan")
def history_trim_plan(spark, sf_dir):
    return _trims(spark, sf_dir).select("conv_id", "turn", "bucket", "saving", "priority")


@query(
    f"""{_TRIM}, totals AS (SELECT conv_id, sum(length(text) // 4) AS tokens FROM msg GROUP BY conv_id),
c AS (SELECT p.*, coalesce(sum(saving) OVER (PARTITION BY conv_id ORDER BY priority, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM plan p)
SELECT c.conv_id, c.turn, c.priority, c.saving FROM c JOIN totals t ON c.conv_id = t.conv_id WHERE t.tokens - c.saved > 600"""
)
def history_budget_cut(spark, sf_dir):
    totals = _messages(spark, sf_dir).groupBy("conv_id").agg(F.sum(estimate_tokens(F.col("content"))).alias("tokens"))
    return history.budget_cut(_trims(spark, sf_dir), totals, 600).select("conv_id", "turn", "priority", "saving")


_TERMS = [w for w in ("collect", "documents", "listed", "under", "thousand", "reports", "anonther", "inthere", "tionable")]
_COUNT = " + ".join(f"3 * ((length(t) - length(replace(t, '{w}', ''))) // {len(w)})" for w in _TERMS)


@query(f"SELECT * FROM (SELECT doc_id, CAST({_COUNT} AS BIGINT) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents) ORDER BY score DESC, doc_id LIMIT 8) WHERE score > 0")
def relevance_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("task_summary"))
    return search.top_relevant(rows, TASK, 8, ties="doc_id", weights={"task_summary": 3}).select("doc_id", "score")


@query(
    """WITH s AS (SELECT 's' || n_nationkey AS subtask_id, CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'done' END AS status, 's' || (n_nationkey + 1) AS a, 's' || (n_nationkey * 2) AS b FROM nation),
d AS (SELECT subtask_id, a AS waiting_for FROM s UNION ALL SELECT subtask_id, b FROM s)
SELECT d.subtask_id, d.waiting_for FROM d LEFT JOIN s ON d.waiting_for = s.subtask_id WHERE s.status IS NULL OR s.status <> 'done'"""
)
def dependency_abort(spark, sf_dir):
    i = F.col("n_nationkey")
    depends = F.array(F.concat(F.lit("s"), i + 1), F.concat(F.lit("s"), i * 2))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), i).alias("subtask_id"), depends.alias("depends_on"), F.when(i % 4 == 0, "failed").otherwise("done").alias("status"))
    return flow.blocked(rows)


#: Subtasks out of suppliers: chains of eight, a diamond in each, loops in some, and needs that are not there.
_TASKS = """tasks AS (SELECT s_suppkey AS k, 't' || s_suppkey AS subtask_id, list_filter([CASE WHEN s_suppkey % 8 <> 0 THEN 't' || (s_suppkey - 1) END, CASE WHEN s_suppkey % 8 >= 4 THEN 't' || (s_suppkey - 3) END,
    CASE WHEN s_suppkey % 32 = 21 THEN 't' || (s_suppkey + 2) END, CASE WHEN s_suppkey % 40 = 12 THEN 'none' END], lambda x: x IS NOT NULL) AS needs,
  CASE WHEN s_suppkey % 11 = 3 THEN 'failed' WHEN s_suppkey % 8 < 3 OR s_suppkey % 5 = 0 THEN 'done' ELSE 'pending' END AS status FROM supplier),
edges AS (SELECT DISTINCT subtask_id, unnest(needs) AS need FROM tasks),
reach AS (SELECT subtask_id, need, 1 AS steps FROM edges UNION SELECT r.subtask_id, e.need, r.steps + 1 FROM reach r JOIN edges e ON r.need = e.subtask_id WHERE r.steps < 12),
loops AS (SELECT DISTINCT subtask_id FROM reach WHERE subtask_id = need),
bad AS (SELECT subtask_id AS id FROM tasks WHERE status = 'failed' UNION SELECT subtask_id FROM loops UNION SELECT need FROM edges WHERE need NOT IN (SELECT subtask_id FROM tasks)),
hits AS (SELECT subtask_id, need AS cause, min(steps) AS steps FROM reach WHERE need IN (SELECT id FROM bad) GROUP BY 1, 2 UNION ALL SELECT id, id, 0 FROM bad),
near AS (SELECT subtask_id, min(steps) AS steps FROM hits GROUP BY 1), causes AS (SELECT h.subtask_id, n.steps, min(h.cause) AS cause FROM hits h JOIN near n ON h.subtask_id = n.subtask_id AND h.steps = n.steps GROUP BY 1, 2),
waits AS (SELECT DISTINCT subtask_id FROM edges WHERE need NOT IN (SELECT subtask_id FROM tasks WHERE status = 'done')),
told AS (SELECT t.subtask_id, CASE WHEN t.subtask_id IN (SELECT subtask_id FROM loops) THEN 'cyclic' WHEN c.cause IS NOT NULL THEN 'aborted' WHEN t.status = 'done' THEN 'kept' WHEN t.subtask_id IN (SELECT subtask_id FROM waits) THEN 'waiting' ELSE 'ready' END AS outcome,
  c.cause, c.steps FROM tasks t LEFT JOIN causes c ON t.subtask_id = c.subtask_id)"""


@query(f"WITH RECURSIVE {_TASKS} SELECT subtask_id, outcome, CASE WHEN outcome = 'aborted' THEN cause END AS cause, CASE WHEN outcome = 'aborted' THEN CAST(steps AS INTEGER) END AS steps FROM told")
def flow_resolution(spark, sf_dir):
    k = F.col("s_suppkey")
    t = lambda c: F.concat(F.lit("t"), c)
    needs = F.array(F.when(k % 8 != 0, t(k - 1)), F.when(k % 8 >= 4, t(k - 3)), F.when(k % 32 == 21, t(k + 2)), F.when(k % 40 == 12, "none"))
    status = F.when(k % 11 == 3, "failed").when((k % 8 < 3) | (k % 5 == 0), "done").otherwise("pending")
    return flow.resolved(table(spark, sf_dir, "supplier").select(t(k).alias("subtask_id"), needs.alias("depends_on"), status.alias("status")))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n FROM e GROUP BY 1, 2) GROUP BY user_id"""
)
def error_streaks(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return flow.longest_streak(log, "user_id", "event_id", "bad")


@query(
    """SELECT user_id, count(*) FILTER (WHERE rep) AS repeats FROM (SELECT user_id, coalesce(list_contains(list(a) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), a), false) AS rep
FROM (SELECT user_id, event_id, event_type || (event_id % 3) AS a FROM events)) GROUP BY user_id"""
)
def action_repeats(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.col("event_id") % 3).alias("a"))
    return flow.repeats(log, "user_id", "event_id", "a").groupBy("user_id").agg(F.count_if("repeated").alias("repeats"))


@query(f"WITH {_MSG} SELECT conv_id, turn, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sum_in, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sum_out FROM tok")
def token_ledger(spark, sf_dir):
    calls = history.part_tokens(_messages(spark, sf_dir)).select("conv_id", "turn", F.col("tokens").alias("tokens_in"), F.length("content").cast("bigint").alias("tokens_out"))
    return history.running_ledger(calls).select("conv_id", "turn", "sum_in", "sum_out")


@query(f"""WITH {_MSG}, r AS (SELECT conv_id, turn, kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM msg),
k AS (SELECT *, max(CASE WHEN kind <> 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY back) AS ok FROM r WHERE back <= 6) SELECT conv_id, turn FROM k WHERE ok = 1""")
def history_overflow_tail(spark, sf_dir):
    return history.overflow_tail(_messages(spark, sf_dir)).select("conv_id", "turn")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def sql_gate_count(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("gleanery_events")
    return sqlgate.run_select(spark, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM gleanery_events GROUP BY event_type;")
