"""Queries that summarise tool returns and trim histories to a budget; returns are spelt out of the words of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import history, summaries
from gleanery.plans.registry import query
from gleanery.session import table

SNAPSHOTS = ("open_page",)
KEPT = {"thinking": 1, "snapshot": 1, "validation": 1, "other": 0}
BUDGET = 500

#: An analysis, a page or plain lines, by conversation: words as entries, with headers, blank and plain lines among them.
_LINES = """base AS (SELECT conv_id, turn, role, string_split(text, ' ') AS words FROM conversations),
msg AS (SELECT conv_id, turn, role, conv_id % 3 AS k, CASE WHEN role <> 'assistant' THEN array_to_string(words, ' ') ELSE array_to_string(list_concat(
    CASE conv_id % 3 WHEN 0 THEN ['# analyzed page structure'] WHEN 1 THEN ['# page', '', '# url', CASE WHEN conv_id % 2 = 0 THEN '# Extracted elements' ELSE '# Page links' END] ELSE [] END,
    list_transform(words, lambda w, j: CASE conv_id % 3
      WHEN 0 THEN CASE WHEN j % 58 = 1 THEN '# Link URL patterns' WHEN j % 29 = 1 THEN '# Buttons' WHEN j % 31 = 8 THEN w ELSE '  <' || w END
      WHEN 1 THEN CASE WHEN j % 45 = CASE WHEN conv_id % 4 = 1 THEN 21 ELSE 0 END THEN w WHEN j % 10 = 4 THEN '' ELSE '  <' || w END
      ELSE CASE WHEN j % 4 = 1 THEN '' ELSE w END END)), chr(10)) END AS content FROM base)"""
#: The automaton that reads a return line by line; hard is 0 or 1.
_AUTOMATON = r"""lined AS (SELECT conv_id, turn, hard, k, string_split(content, chr(10)) AS all_lines FROM msg, (SELECT unnest([0, 1]) AS hard) WHERE role = 'assistant'),
lines AS (SELECT conv_id, turn, hard, k, CASE WHEN all_lines[-1] = '' THEN all_lines[:-2] ELSE all_lines END AS ls FROM lined),
steps AS (
  SELECT conv_id, turn, hard, k, ls, 0 AS pos, 'head' AS phase, 0 AS seen, 0 AS cut, false AS whole, []::VARCHAR[] AS kept FROM lines
  UNION ALL
  SELECT conv_id, turn, hard, k, ls, pos + 1,
    CASE WHEN k <> 1 OR phase = 'stop' OR blank THEN phase
      WHEN phase = 'head' THEN CASE WHEN starts_with(line, '# Extracted elements') THEN 'elements' WHEN starts_with(line, '# Page links') THEN 'links' WHEN starts_with(line, '#') THEN 'head' ELSE 'stop' END
      WHEN NOT starts_with(line, CASE phase WHEN 'elements' THEN '  <' ELSE '  ' END) OR seen >= cap THEN 'stop' ELSE phase END,
    CASE WHEN k = 0 THEN CASE WHEN starts_with(line, '#') OR (NOT starts_with(line, '  ') AND NOT blank) THEN 0 WHEN starts_with(line, '  ') AND NOT whole AND seen < 20 THEN seen + 1 ELSE seen END
      WHEN k = 1 THEN CASE WHEN phase IN ('elements', 'links') AND NOT blank AND starts_with(line, CASE phase WHEN 'elements' THEN '  <' ELSE '  ' END) AND seen < cap THEN seen + 1 ELSE seen END
      ELSE CASE WHEN blank THEN seen ELSE seen + 1 END END,
    CASE WHEN k <> 0 THEN 0 WHEN starts_with(line, '#') OR (NOT starts_with(line, '  ') AND NOT blank) THEN 0 WHEN starts_with(line, '  ') AND NOT whole AND seen >= 20 THEN cut + 1 ELSE cut END,
    CASE WHEN k <> 0 THEN false WHEN starts_with(line, '#') THEN starts_with(line, '# Link URL patterns') WHEN NOT starts_with(line, '  ') AND NOT blank THEN false ELSE whole END,
    CASE WHEN k = 0 AND hard = 1 THEN CASE WHEN starts_with(line, '#') THEN list_append(kept, line) ELSE kept END
      WHEN k = 0 THEN CASE WHEN starts_with(line, '#') OR (NOT starts_with(line, '  ') AND NOT blank) THEN list_append(CASE WHEN cut > 0 THEN list_append(kept, '[' || cut || ' more trimmed]') ELSE kept END, line)
        WHEN starts_with(line, '  ') AND NOT whole AND seen >= 20 THEN kept ELSE list_append(kept, line) END
      WHEN k = 1 THEN CASE WHEN phase = 'stop' OR blank THEN kept WHEN phase = 'head' THEN CASE WHEN starts_with(line, '#') THEN list_append(kept, line) ELSE kept END
        WHEN starts_with(line, CASE phase WHEN 'elements' THEN '  <' ELSE '  ' END) AND seen < cap THEN list_append(kept, line) ELSE kept END
      ELSE CASE WHEN blank OR seen >= 6 THEN kept ELSE list_append(kept, line) END END
  FROM (SELECT *, ls[pos + 1] AS line, trim(ls[pos + 1]) = '' AS blank, CASE WHEN hard = 1 THEN 6 ELSE 30 END AS cap FROM steps WHERE pos < len(ls))),
summed AS (SELECT conv_id, turn, hard, array_to_string(CASE WHEN k = 0 AND hard = 0 THEN CASE WHEN cut > 0 THEN list_append(kept, '[' || cut || ' more trimmed]') ELSE kept END ELSE list_append(kept, '[trimmed — see latest snapshot]') END, chr(10)) AS summary
  FROM steps WHERE pos = len(ls))"""


def _messages(spark, sf_dir):
    """conversations as messages: users' texts as thinking, assistants' as returns of tools."""
    c = table(spark, sf_dir, "conversations")
    k, i = F.col("conv_id") % 3, F.col("conv_id")

    def entry(w, n):
        j = n + 1
        analysis = F.when(j % 58 == 1, "# Link URL patterns").when(j % 29 == 1, "# Buttons").when(j % 31 == 8, w).otherwise(F.concat(F.lit("  <"), w))
        page = F.when(j % 45 == F.when(i % 4 == 1, 21).otherwise(0), w).when(j % 10 == 4, "").otherwise(F.concat(F.lit("  <"), w))
        return F.when(k == 0, analysis).when(k == 1, page).otherwise(F.when(j % 4 == 1, "").otherwise(w))

    texts = lambda *t: F.array(*(x if not isinstance(x, str) else F.lit(x) for x in t))
    opened = texts("# page", "", "# url", F.when(i % 2 == 0, "# Extracted elements").otherwise("# Page links"))
    head = F.when(k == 0, texts("# analyzed page structure")).when(k == 1, opened).otherwise(F.array().cast("array<string>"))
    built = F.array_join(F.concat(head, F.transform(F.split("text", " "), entry)), "\n")
    kind = F.when(F.col("role") == "assistant", "tool_return").when(F.col("role") == "user", "thinking").otherwise("system")
    tool = F.when(k < 2, SNAPSHOTS[0]).when(i % 2 == 0, "lookup").otherwise("list_files")
    return c.select("conv_id", "turn", F.lit(0).alias("part_ord"), kind.alias("kind"), tool.alias("tool_name"), F.when(kind == "tool_return", built).otherwise(F.col("text")).alias("content"))


@query(f"WITH RECURSIVE {_LINES}, {_AUTOMATON} SELECT conv_id, turn, hard, summary FROM summed")
def return_summaries(spark, sf_dir):
    returns = _messages(spark, sf_dir).where("kind = 'tool_return'")
    bucket = F.when(F.col("tool_name").isin(*SNAPSHOTS), "snapshot").otherwise("other")
    styled = [returns.select("conv_id", "turn", F.lit(h).alias("hard"), "content", summaries.style_of(bucket, F.col("content"), bool(h)).alias("style")) for h in (0, 1)]
    return summaries.summaries(styled[0].unionByName(styled[1]), ["conv_id", "turn", "hard"])


@query(
    f"""WITH RECURSIVE {_LINES}, {_AUTOMATON},
parts AS (SELECT conv_id, turn, content, CASE WHEN role = 'user' THEN 'thinking' WHEN role = 'assistant' AND length(content) >= 1000 THEN CASE WHEN k < 2 THEN 'snapshot' ELSE 'other' END END AS bucket, k FROM msg),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bucket ORDER BY turn DESC) AS nth FROM parts WHERE bucket IS NOT NULL),
own AS (SELECT n.*, CASE WHEN bucket = 'thinking' THEN '[trimmed thinking]' WHEN bucket = 'other' AND n.conv_id % 2 = 0 THEN left(content, 20) || '…' ELSE s.summary END AS soft, h.summary AS hard
  FROM nth n LEFT JOIN summed s ON n.conv_id = s.conv_id AND n.turn = s.turn AND s.hard = 0 LEFT JOIN summed h ON n.conv_id = h.conv_id AND n.turn = h.turn AND h.hard = 1),
trims AS (
  SELECT conv_id, turn, CASE bucket WHEN 'thinking' THEN 0 WHEN 'snapshot' THEN 1 ELSE 3 END AS priority, soft AS summary, length(content) // 4 - length(soft) // 4 AS saving FROM own WHERE nth > CASE bucket WHEN 'other' THEN 0 ELSE 1 END
  UNION ALL SELECT conv_id, turn, 4, hard, length(soft) // 4 - length(hard) // 4 FROM own WHERE bucket = 'snapshot' AND nth > 1 AND length(soft) >= 1000),
totals AS (SELECT conv_id, sum(length(content) // 4) AS tokens FROM msg GROUP BY conv_id),
needed AS (SELECT *, tokens - coalesce(sum(saving) OVER (PARTITION BY conv_id ORDER BY priority, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM trims JOIN totals USING (conv_id)),
last AS (SELECT conv_id, turn, max(priority) AS priority, arg_max(summary, priority) AS summary FROM needed WHERE before > {BUDGET} GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, CASE WHEN l.priority = 4 THEN 'hard' WHEN l.priority IS NOT NULL THEN 'soft' END AS trimmed, coalesce(l.summary, m.content) AS content FROM msg m LEFT JOIN last l ON m.conv_id = l.conv_id AND m.turn = l.turn"""
)
def history_compact(spark, sf_dir):
    own = summaries.Summarisers(lookup=lambda text: F.concat(F.left(text, F.lit(20)), F.lit("…")))
    return history.compacted(_messages(spark, sf_dir), SNAPSHOTS, budget=BUDGET, summarisers=own, keep=KEPT).select("conv_id", "turn", "trimmed", "content")
