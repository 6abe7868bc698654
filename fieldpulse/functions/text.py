"""Scalar text and number helpers with the dashboard's NULL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def full_name(first, last) -> Column:
    """``CONCAT(COALESCE(f,''),' ',COALESCE(l,''))``: ``' '`` when both are NULL."""
    return F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))


def joined_name(first, last) -> Column:
    """``f || ' ' || l``: NULL when either part is NULL."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def digits_only(col) -> Column:
    """``regexp_replace(v, '\\D', '', 'g')`` with ASCII digits."""
    return F.regexp_replace(_c(col), "[^0-9]", "")


def is_digits(col) -> Column:
    """``v ~ '^[0-9]+$'`` (``\\z`` so a trailing newline does not match)."""
    return _c(col).rlike(r"^[0-9]+\z")


def to_int(col, on_bad: str = "fail") -> Column:
    """``::int``: a bad or overflowing text fails the query, or is NULL with on_bad='null'."""
    return _c(col).cast("int") if on_bad == "fail" else _c(col).try_cast("int")


def to_decimal(col, on_bad: str = "fail") -> Column:
    """``::numeric`` as decimal(38,18)."""
    return _c(col).cast("decimal(38,18)") if on_bad == "fail" else _c(col).try_cast("decimal(38,18)")


def python_timestamp_text(col) -> Column:
    """Text of a timestamp as Python's ``str(datetime)`` writes it (fraction only if non-zero)."""
    c = _c(col)
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
