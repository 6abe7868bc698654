"""Row filters: day, date range, scope, id sets, non-zero coordinates.

Day and range filters are written as half-open ranges on the timestamp
column itself, so the scan receives them as pushed filters (and a table
partitioned by day prunes files)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ZONE


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d))


def _ntz(d: dt.date) -> Column:
    return F.lit(dt.datetime(d.year, d.month, d.day)).cast("timestamp_ntz")


def local_date(instant: Column, zone: str) -> Column:
    """Date of an instant on the wall clock of ``zone``, whatever the session's zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz")))


def today(zone: str) -> Column:
    """The project's current date; constant within a query, so day filters on it are pushed."""
    return local_date(F.current_timestamp(), zone)


def on_day(col: str | Column, as_of=None, zone: str = ZONE) -> Column:
    """``created_at::date = as_of`` (today in ``zone`` when ``as_of`` is None)."""
    c = F.col(col) if isinstance(col, str) else col
    if as_of is None:
        d = today(zone)
        return (c >= d.cast("timestamp_ntz")) & (c < F.date_add(d, 1).cast("timestamp_ntz"))
    d = _as_date(as_of)
    return (c >= _ntz(d)) & (c < _ntz(d + dt.timedelta(days=1)))


def require_range(start, end) -> tuple[dt.date, dt.date]:
    """Both bounds are required (the report answers 400 without them)."""
    if start is None or end is None or start == "" or end == "":
        raise ValueError("both start and end dates are required")
    return _as_date(start), _as_date(end)


def in_range(col: str | Column, start, end) -> Column:
    """``created_at::date BETWEEN start AND end``, inclusive on dates; start > end selects nothing."""
    s, e = require_range(start, end)
    c = F.col(col) if isinstance(col, str) else col
    return (c >= _ntz(s)) & (c < _ntz(e + dt.timedelta(days=1)))


def where_day(df: DataFrame, as_of=None, col: str = "created_at", zone: str = ZONE) -> DataFrame:
    """Rows of the day.  On a table partitioned by ``created_date`` the same day is
    also asked of the partition column, so only that folder is listed and read."""
    cond = on_day(col, as_of, zone)
    if "created_date" in df.columns:
        day = today(zone) if as_of is None else F.lit(_as_date(as_of))
        cond = cond & (F.col("created_date") == day)
    return df.where(cond)


def where_range(df: DataFrame, start, end, col: str = "created_at") -> DataFrame:
    """Rows with date in [start, end]; prunes ``created_date`` partitions when present."""
    cond = in_range(col, start, end)
    if "created_date" in df.columns:
        s, e = require_range(start, end)
        cond = cond & F.col("created_date").between(F.lit(s), F.lit(e))
    return df.where(cond)


def scope_filter(df: DataFrame, scope: str, as_of=None, col: str = "created_at", zone: str = ZONE) -> DataFrame:
    """``scope='today'`` keeps the day, ``scope='all'`` keeps everything."""
    if scope == "today":
        return where_day(df, as_of, col, zone)
    if scope == "all":
        return df
    raise ValueError(f"scope must be 'today' or 'all', got {scope!r}")


def in_ids(col: str | Column, ids) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(*list(ids))


def nonzero_point(lat: str = "latitud", lon: str = "longitud") -> Column:
    """Python/JS truthiness of both coordinates: drops NULL and 0."""
    return (F.col(lat) != 0) & (F.col(lon) != 0)
