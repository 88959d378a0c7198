"""Single-table filters; they reach the scan as plain predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.plans.spec import Filter, QueryError


def predicate(f: Filter) -> Column:
    c = F.col(f.column)
    if f.kind == "equi":
        return c == F.lit(f.value)
    if f.kind == "neq":
        return c != F.lit(f.value)
    if f.kind == "band":
        return c.between(F.lit(f.operand - f.value), F.lit(f.operand + f.value))
    raise QueryError(f"no such filter: {f.kind}")


def filtered(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Rows that all filters let pass."""
    return df.filter(reduce(Column.__and__, map(predicate, filters))) if filters else df
