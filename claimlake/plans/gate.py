"""The read-only gate: decided on Spark's parsed plan, not on the text alone."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_QUERY = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)
#: Parts of class names of plans that change something or run a command.
_WRITES = ("Insert", "Command", "Create", "Drop", "Alter", "Truncate", "Delete", "Update", "Merge", "Cache", "Refresh", "Load", "Set", "Analyze", "Repair", "Replace", "Write", "Append", "Overwrite")
_READS = ("SetOperation", "UnresolvedSubqueryColumnAliases", "GroupingSets", "Dataset", "Offset")


class NotReadOnly(ValueError):
    pass


def _names(plan) -> list[str]:
    out = [plan.getClass().getSimpleName()]
    children = plan.children()
    inner = [plan.child()] if out[0] == "UnresolvedWith" else []
    for i in range(children.size()):
        out += _names(children.apply(i))
    for child in inner:
        out += _names(child)
    return out


def check(spark: SparkSession, sql: str) -> None:
    """Raises unless ``sql`` is one SELECT or WITH query. Several statements, and a WITH that ends in an INSERT, do not
    pass."""
    if not isinstance(sql, str) or not _QUERY.match(sql):
        raise NotReadOnly("only SELECT and WITH are allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise NotReadOnly(f"not one readable statement: {str(error).splitlines()[0][:200]}") from error
    for name in _names(plan):
        if any(w in name for w in _WRITES) and not any(r in name for r in _READS):
            raise NotReadOnly(f"{name} is not read-only")


def is_read_only(spark: SparkSession, sql: str) -> bool:
    try:
        check(spark, sql)
    except NotReadOnly:
        return False
    return True
