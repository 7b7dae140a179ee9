"""Read-only SQL over one dataset (Q1-Q4)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from prismtally.operators.filters import RowPolicy, apply_row_policies
from prismtally.sources.writers import write_csv

# Words that are refused anywhere in a statement, and the row limits of a preview.
REFUSED = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH", "COPY", "PRAGMA", "CALL")
DEFAULT_ROWS, MOST_ROWS = 200, 2000

RELATION = "dataset"
# Plan leaves that hold no stored rows, and expressions that call into the machine.
ROWLESS = frozenset(("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"))
REFLECTIVE = frozenset(("CallMethodViaReflection", "TryReflect"))


class RefusedStatement(ValueError):
    """A statement that the workbench does not run; ``reason`` names the rule it breaks."""

    def __init__(self, reason: str, message: str) -> None:
        super().__init__(message)
        self.reason = reason


def _bare(statement: str) -> str:
    """The statement without what stands in quotes."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "", statement)


# Rule name, what breaks it, and what the user is told; checked in this order.
RULES = (
    ("empty", lambda s: not s, "There is no statement to run."),
    ("not_a_query", lambda s: not re.match(r"(select|with)\b", s, re.IGNORECASE), "A statement has to begin with SELECT or WITH."),
    ("refused_word", lambda s: re.search(rf"\b({'|'.join(REFUSED)})\b", s, re.IGNORECASE), "The statement has a word that read-only work does not need."),
    ("second_statement", lambda s: ";" in _bare(s), "One statement at a time, please."),
)


def guard(sql: str | None) -> str:
    """Q3: the statement without trailing semicolons, or the first rule it breaks. Words in text literals count too."""
    statement = re.sub(r"[;\s]+\Z", "", sql or "").strip()
    for reason, broken, message in RULES:
        if broken(statement):
            raise RefusedStatement(reason, message)
    return statement


def _plans(plan, skip: str) -> Iterator:
    """Nodes of an analysed plan and of its subqueries, without what lies under the view ``skip``."""
    if plan.nodeName() == "View" and skip in plan.desc().identifier().table():
        return
    yield plan
    for group in (plan.children(), plan.subqueries()):
        for k in range(group.size()):
            yield from _plans(group.apply(k), skip)


def _expressions(found) -> Iterator:
    for k in range(found.size()):
        yield found.apply(k)
        yield from _expressions(found.apply(k).children())


def check_plan(rows: DataFrame, view: str) -> None:
    """Q4: the analysed plan may read the one view and nothing else, and may not call Java methods."""
    for node in _plans(rows._jdf.queryExecution().analyzed(), view):
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind == "View" or node.children().isEmpty() and kind not in ROWLESS:
            raise RefusedStatement("other_relation", f"Only the relation '{RELATION}' can be read.")
        for expression in _expressions(node.expressions()):
            if expression.getClass().getSimpleName() in REFLECTIVE:
                raise RefusedStatement("reflection", "Functions that call Java methods are not available.")


def clamp(limit: int | None, default: int = DEFAULT_ROWS) -> int:
    """Q2: 1 to 2000 rows."""
    return max(1, min(int(limit or default), MOST_ROWS))


@dataclass(frozen=True)
class QueryResult:
    """``rows`` is the lazy full result; ``preview`` its limited form; ``count()`` runs the count."""

    rows: DataFrame
    preview: DataFrame
    sql: str

    def count(self) -> int:
        return self.rows.count()


def run_query(
    df: DataFrame,
    sql: str,
    limit: int | None = None,
    policies: list[RowPolicy] | None = None,
    user: str | None = None,
    owner: str | None = None,
) -> QueryResult:
    """Q1 / Q4: the statement over the relation ``dataset``, policy-filtered for everyone but the owner.

    The frame is bound under a name of this call alone, which ``dataset`` stands for as a common table expression. So calls do
    not see each other, a view of the caller's stays what it is, and no setting of the session changes.
    """
    statement = guard(sql)
    visible = apply_row_policies(df, policies or [], user or "", owner) if user else df
    view = f"{RELATION}_{uuid.uuid4().hex}"
    recursive, rest = re.match(r"(?is)(?:with\s+(recursive\s+)?)?(.*)", statement).groups()
    more = ", " if statement[:4].lower() == "with" else " "
    visible.createTempView(view)
    try:
        rows = df.sparkSession.sql(f"WITH {recursive or ''}{RELATION} AS (SELECT * FROM {view}){more}{rest}")
        check_plan(rows, view)
    finally:
        df.sparkSession.catalog.dropTempView(view)
    return QueryResult(rows, rows.limit(clamp(limit)), statement)


def export_query(df: DataFrame, sql: str, path: str, **access) -> str:
    """The whole result as CSV with a header, written by the executors."""
    return write_csv(run_query(df, sql, **access).rows, path, quote_all=False)
