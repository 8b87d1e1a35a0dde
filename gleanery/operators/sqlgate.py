"""Guarded ad-hoc SQL: one SELECT over registered views, a capped answer, errors as text.

What a statement is, Spark's own parser says: the plan must hold no command, and only one statement parses.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from gleanery.functions.text import table_cell

SHOWN = 200
QUERIES_A_TURN = 10
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: What plans of statements other than queries are made of.
ACTS = (_LOGICAL + "Command", _LOGICAL + "ParsedStatement")


class Refused(ValueError):
    """The statement is not one SELECT."""


def acts(spark: SparkSession, sql: str) -> bool:
    """Whether any node of the parsed statement does something other than read."""
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    kinds = [spark._jvm.java.lang.Class.forName(k, False, todo[0].getClass().getClassLoader()) for k in ACTS]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            return True
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return False


def run_select(spark: SparkSession, sql: str, limit: int = SHOWN) -> DataFrame:
    """Rows of one SELECT, one more than ``limit`` so that a cut shows; raises :class:`Refused` for anything else."""
    opening = sql.split(None, 1)[:1]
    if not opening or opening[0].upper() != "SELECT":
        raise Refused("a query has to begin with SELECT")
    if acts(spark, sql):
        raise Refused("a query may only read")
    return spark.sql(sql).limit(limit + 1)


def render(answer: DataFrame, limit: int = SHOWN) -> str:
    """A pipe table of the first ``limit`` rows, and how many there are, or that there are more."""
    names = [f"c{i}" for i in range(len(answer.columns))]
    cells = answer.toDF(*names)
    rows = cells.select(*(table_cell(cells[n]).alias(n) for n in names)).collect()
    ends = "" if len(rows) <= limit else " (more rows were cut)"
    table = [answer.columns, ["---"] * len(names), *rows[:limit]]
    return "\n".join([*(" | ".join(r) for r in table), f"{len(rows)} rows{ends}"])


class Gate:
    """A session's budget of queries; only answered ones count."""

    def __init__(self, spark: SparkSession, budget: int = QUERIES_A_TURN):
        self.spark, self.left = spark, budget
        # A name that other dialects have for a built-in function.
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION json_extract(doc STRING, path STRING) RETURNS STRING RETURN get_json_object(doc, path)")

    def ask(self, sql: str) -> str:
        if self.left <= 0:
            return "error: the query budget is used up"
        try:
            said = render(run_select(self.spark, sql))
        except (Refused, PySparkException, Py4JJavaError) as e:
            return f"error: {e}"
        self.left -= 1
        return said
