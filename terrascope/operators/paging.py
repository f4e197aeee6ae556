"""Offset paging with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 20


def page(df: DataFrame, order: Sequence[str | Column], number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of one page. `order` must end in a unique column, or pages may overlap."""
    if number < 0 or size < 1:
        raise ValueError("page number starts at 0 and size at 1")
    return df.orderBy(*order).offset(number * size).limit(size)


def after_row(df: DataFrame, columns: Sequence[str], after: Sequence) -> Column:
    """Rows behind the one with the values `after`, in ascending order of `columns`, NULL first.

    Written as a chain of plain comparisons with a bound on the first column in front, which Parquet row groups can be
    skipped by; a comparison of structs is not pushed down.
    """
    behind = F.lit(False)
    for c, v in reversed(list(zip(columns, after, strict=True))):
        value = F.lit(v).cast(df.schema[c].dataType)
        behind = F.col(c).isNotNull() | (F.col(c).isNull() & behind) if v is None else (
            (F.col(c) > value) | ((F.col(c) == value) & behind))
    first = after[0]
    return behind if first is None else (F.col(columns[0]) >= F.lit(first).cast(df.schema[columns[0]].dataType)) & behind


def page_after(
    df: DataFrame, columns: Sequence[str], after: Sequence | None = None, size: int = PAGE_SIZE
) -> DataFrame:
    """The next page in ascending order of `columns` after the row with the values `after`; None starts at the front.

    `columns` must end in a unique one. Every task keeps `size` rows however far the page is from the front.
    """
    if after is not None:
        df = df.filter(after_row(df, columns, after))
    return df.orderBy(*columns).limit(size)


def page_info(df: DataFrame, number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One row: size, total elements, total pages, page number."""
    total = F.count(F.lit(1))
    return df.agg(
        F.lit(size).cast("bigint").alias("size"),
        total.alias("total_elements"),
        F.ceil(total / F.lit(size)).cast("bigint").alias("total_pages"),
        F.lit(number).cast("bigint").alias("number"),
    )
