"""Column expressions (scalar functions).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
R-style semantics that differ from SQL are spelled out by name:
``not_in_keep_null`` keeps rows whose value is null (R's ``!(x %in% v)``),
``not_in_drop_null`` drops them (R's ``%in%`` with ``NA`` in the list, and
SQL's ``NOT IN``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- nulls -------------------------------------------------------------------

def null_if_token(c: str | Column, tokens: Iterable[str]) -> Column:
    """Value, or null when it equals one of the missing-value tokens."""
    c = col(c)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)



def presence_flag(*cols: str | Column) -> Column:
    """1 when any of the columns is present, else 0 (``is.na(a) & is.na(b)``)."""
    return F.coalesce(*[col(c) for c in cols]).isNotNull().cast("int")


# --- membership and text tests ---------------------------------------------


def not_in_keep_null(c: str | Column, values: Iterable) -> Column:
    """True unless the value is in the list; a null value is kept (True)."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def not_in_drop_null(c: str | Column, values: Iterable) -> Column:
    """True when the value is present and not in the list."""
    c = col(c)
    return c.isNotNull() & ~c.isin(list(values))


def contains_or_false(c: str | Column, needle: str) -> Column:
    """Case-sensitive substring test; null gives False (``grepl``)."""
    return F.coalesce(col(c).contains(needle), F.lit(False))



# --- dates -------------------------------------------------------------------

def parse_date(c: str | Column, fmt: str = "yyyyMMdd") -> Column:
    """Text to date; text that does not parse becomes null (ANSI-safe)."""
    return F.try_to_date(col(c).cast("string"), fmt)


def year_floor(c: str | Column) -> Column:
    """First day of the calendar year, as a date (``floor_date(d, "year")``)."""
    return F.trunc(col(c).cast("date"), "year")


def years_between(later: str | Column, earlier: str | Column) -> Column:
    """Difference of calendar years; the birthday is ignored."""
    return (F.year(col(later)) - F.year(col(earlier))).cast("long")


def month_abbr(c: str | Column) -> Column:
    return F.date_format(col(c), "MMM")


def date_lit(value: str | _dt.date) -> Column:
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)


# --- arithmetic and labels -------------------------------------------------

def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that gives null for a zero divisor instead of raising."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def code_to_label(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Map codes to labels with a ``CASE`` chain (R ``factor(labels=)``)."""
    c = col(c)
    out = None
    for k, v in mapping.items():
        cond = c.isNull() if k is None else (c == F.lit(k))
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def first_match(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """Multi-branch conditional: first true condition wins (``case_when``)."""
    out = None
    for cond, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(d)


def prefixed(c: str | Column, prefix: str) -> Column:
    """``paste0(prefix, x)``."""
    return F.concat(F.lit(prefix), col(c).cast("string"))
