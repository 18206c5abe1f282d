"""Filtered, sorted and paged listings: one operator for every entity's list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.predicates import active


def ordered(df: DataFrame, sort: str, order: str = "asc", key: str = "id") -> list[Column]:
    """Sort columns with the key as tie-break. Unknown columns or directions are refused."""
    if sort not in df.columns or order not in ("asc", "desc"):
        raise ValueError(f"can't sort by {sort} {order}")
    first = F.col(sort).desc_nulls_last() if order == "desc" else F.col(sort).asc_nulls_first()
    return [first, F.col(key).asc()]


def reasonable_page(total: int, page: int, limit: int) -> int:
    """A page under 1 is the first, one past the end the last."""
    return max(1, min(page, max(1, -(-total // limit))))


def page_of(df: DataFrame, sort: str, order: str = "asc", page: int = 1, limit: int = 10, *, reasonable: bool = True, key: str = "id") -> DataFrame:
    """Rows of a page. With reasonable, a page out of range is moved into it (one count); else only upwards from 1."""
    page = reasonable_page(df.count(), page, limit) if reasonable else max(1, page)
    return df.orderBy(*ordered(df, sort, order, key)).offset((page - 1) * limit).limit(limit)


def list_entity(df: DataFrame, where: Column | None = None, columns: Sequence[str] | None = None, sort: str = "id", order: str = "asc", page: int = 1, limit: int = 10, *, soft_delete: bool = True, reasonable: bool = True) -> DataFrame:
    """A page of an entity: soft-deleted rows out, optional filter and projection."""
    df = active(df) if soft_delete else df
    df = df.where(where) if where is not None else df
    out = page_of(df, sort, order, page, limit, reasonable=reasonable)
    return out.select(*columns) if columns else out


def first_k(df: DataFrame, k: int, *sort: Column, most: int = 500) -> DataFrame:
    """The first k rows, k being kept between 1 and most."""
    return df.orderBy(*sort).limit(max(1, min(k, most)))


def union_first_k(a: DataFrame, b: DataFrame, k: int, *sort: Column) -> DataFrame:
    """The first k rows of two sources together."""
    return a.unionByName(b).orderBy(*sort).limit(k)
