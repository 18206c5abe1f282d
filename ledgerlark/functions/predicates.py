"""Filters as data: conjunctions of typed criteria, joined by or, with optional parts, soft delete and case folding."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "like": lambda c, v: c.like(v), "not like": lambda c, v: ~c.like(v), "between": lambda c, v: c.between(*v), "not between": lambda c, v: ~c.between(*v),
}


def criterion(column: str, op: str, value: Any = None, *, fold: bool = False) -> Column:
    """One test. A null never passes, whatever the operator; a list for in must not be empty; a value given as a Column
    compares two columns; fold ignores case. User wildcards in like are kept as they are."""
    c = F.lower(column) if fold else F.col(column)
    if fold and isinstance(value, str):
        value = value.lower()
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    if op in ("in", "not in"):
        if not value:
            raise ValueError(f"{op} needs at least one value for {column}")
        found = c.isin([v.lower() if fold and isinstance(v, str) else v for v in value])
        return found if op == "in" else ~found
    return _COMPARE[op](c, value)


def criteria(groups: Sequence[Sequence[tuple]], *, fold: bool = False) -> Column:
    """(column, operator, value) triples: those of a group all hold, of the groups one. Empty groups are left out; with
    none left everything passes."""
    ands = [functools.reduce(operator.and_, (criterion(*t, fold=fold) for t in g)) for g in groups if g]
    return functools.reduce(operator.or_, ands) if ands else F.lit(True)


def given(*tests: tuple[str, str, Any]) -> list[tuple[str, str, Any]]:
    """Only those tests whose value was given: not None, and not blank."""
    return [t for t in tests if t[2] is not None and not (isinstance(t[2], str) and not t[2].strip())]


def active(df: DataFrame, column: str = "deleted") -> DataFrame:
    """Rows that aren't soft-deleted; a null flag counts as not deleted."""
    return df.where(~F.coalesce(F.col(column), F.lit(False)))


def mark_deleted(df: DataFrame, match: Column) -> DataFrame:
    """Soft-deletes the matching rows."""
    return df.withColumn("deleted", F.when(match, True).otherwise(F.col("deleted")))


def any_contains(columns: Sequence[str], word: str) -> Column:
    """Whether one of the columns contains a word."""
    return functools.reduce(operator.or_, (F.col(c).contains(word) for c in columns))


def visible(tenant: str) -> Column:
    """Rows a tenant may see: active, not deleted, and its own or public."""
    own = F.lower(F.trim("tenant_id")) == tenant.strip().lower()
    return F.col("active") & ~F.col("deleted") & ((F.col("access_scope") == "public") | own)


def status_tab(tab: int) -> Column:
    """The order statuses of a tab; an unknown tab shows all."""
    codes = {1: [101], 2: [201], 3: [301], 4: [401, 402]}.get(tab)
    return F.col("status").isin(codes) if codes else F.lit(True)
