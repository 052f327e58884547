"""Dynamic filters, whitelisted sorting and paging over a DataFrame.

Optional predicates fold into one ``where``; the count and the page come off
the same filtered DataFrame. Offset paging (``page``) is a per-partition
top-(offset+size) followed by a merge — cheap for the first pages. For deep
pages use :func:`keyset_page`, which filters on the last (sort value, id)
seen and never re-sorts the skipped rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    conds = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def ilike_any(cols: list[str], text: str | None) -> Column | None:
    """Case-insensitive substring match on any of ``cols`` (user ``%``/``_`` act as wildcards)."""
    if not text:
        return None
    pattern = f"%{text.strip()}%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in cols])


def eq(col: str, value) -> Column | None:
    return None if value is None or value == "" else (F.col(col) == F.lit(value))


def sort_spec(sort_col: str, ascending: bool, tie_col: str) -> list[Column]:
    c = F.col(sort_col)
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col(tie_col).asc()]


def page(df: DataFrame, sort_col: str, ascending: bool, tie_col: str, page_no: int = 1,
         page_size: int = 20) -> DataFrame:
    page_no = max(1, int(page_no))
    page_size = max(1, int(page_size))
    ordered = df.orderBy(*sort_spec(sort_col, ascending, tie_col))
    if page_no > 1:
        ordered = ordered.offset((page_no - 1) * page_size)
    return ordered.limit(page_size)


def keyset_page(df: DataFrame, sort_col: str, ascending: bool, tie_col: str,
                after: tuple | None = None, page_size: int = 20) -> DataFrame:
    """Next page after the row with (sort value, id) = ``after``; NULL sort values come last."""
    if after is not None:
        v, k = after
        c, t = F.col(sort_col), F.col(tie_col)
        if v is None:
            cond = c.isNull() & (t > F.lit(k))
        else:
            beyond = (c > F.lit(v)) if ascending else (c < F.lit(v))
            cond = beyond | ((c == F.lit(v)) & (t > F.lit(k))) | c.isNull()
        df = df.where(cond)
    return df.orderBy(*sort_spec(sort_col, ascending, tie_col)).limit(page_size)


def page_meta(filtered: DataFrame, page_no: int, page_size: int) -> DataFrame:
    """total_items, total_pages = ceil(total/size), has_next, has_prev."""
    total = F.col("total_items")
    return (filtered.agg(F.count(F.lit(1)).alias("total_items"))
            .select(F.lit(int(page_no)).alias("page"), F.lit(int(page_size)).alias("page_size"), total,
                    F.ceil(total / F.lit(float(page_size))).cast("long").alias("total_pages"),
                    (F.lit(int(page_no)) < F.ceil(total / F.lit(float(page_size)))).alias("has_next"),
                    F.lit(int(page_no) > 1).alias("has_prev")))
