"""Payloads of the pages as JSON text: the dashboards' KPIs with their lists, and
the single-list answers (``to_json`` keeping NULL fields).

A payload is one text, so a list inside it holds at most ``size`` entries, the first
in the list's order, taken by a top-k per task.  A longer list is said to be so:
the text then names it under ``incompletas``, and ``list_pages`` gives every page
with the number of entries and pages.  The list frames themselves (``sectors_*``,
``enumerators_*``) hold every entry and stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered


def _json(*cols) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def bounded_list(df: DataFrame, columns: list[str], order: list[Column], size: int) -> Column:
    """The first ``size`` rows in ``order``, and one more if there is one, as one array
    of structs in that order: the one more shows that the list is longer."""
    top = df.orderBy(*order).limit(size + 1)
    rows = top.select(F.struct(*columns).alias("r"), F.row_number().over(Window.orderBy(*order)).alias("i"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("i", "r"))), lambda x: x["r"])
    return F.coalesce(rows.select(packed).scalar(), F.array())


def _text(size: int, lists: dict[str, list[str]], *cols: str) -> Column:
    """The payload's text: ``lists`` are columns made by ``bounded_list`` with the
    names they have in it, cut to ``size``; those that are longer are named."""
    parts = {name: F.slice(c, 1, size).alias(name) for c, names in lists.items() for name in names}
    body = [parts.get(c, F.col(c)) for c in cols]
    longer = [F.when(F.size(c) > size, F.lit(name)) for c, names in lists.items() for name in names]
    named = F.array_compact(F.array(*longer))
    return F.when(F.size(named) > 0, _json(*body, named.alias("incompletas"))).otherwise(_json(*body))


def dashboard_payload(kpis: DataFrame, sectors: DataFrame, enumerators: DataFrame, id_name: str, size: int,
                      total: DataFrame | None = None) -> DataFrame:
    """One row: the KPIs and the JSON payload.  ``kpis`` is the one-pass KPI row;
    ``total`` replaces its submissions count where the page counts them
    elsewhere.  Enumerators by total DESC then id, sectors by name, NULL first.
    A list that is longer than ``size`` is named under ``incompletas``."""
    k = kpis.select(F.struct("total_encuestas", "total_viviendas", "total_sectores")).scalar()
    n = k.getField("total_encuestas") if total is None else total.select("total_encuestas").scalar()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    sect = bounded_list(sectors, ["sector", "total"], [F.col("sector").asc_nulls_first(), F.col("total")], size)
    cens = bounded_list(enumerators, [id_name, "nombre_completo", "total_encuestas"],
                        [F.desc("total_encuestas"), F.col(id_name)], size)
    row = kpis.sparkSession.range(1).select(
        F.struct(zero(n).alias("total_encuestas"), zero(k.getField("total_viviendas")).alias("total_viviendas"),
                 zero(k.getField("total_sectores")).alias("total_sectores")).alias("kpis"), sect.alias("_s"), cens.alias("_e"))
    text = _text(size, {"_e": ["censistas", "convenciones"], "_s": ["sectores"]}, "kpis", "censistas", "sectores", "convenciones")
    return row.select("kpis.total_encuestas", "kpis.total_viviendas", "kpis.total_sectores", text.alias("payload"))


def value_payload(df: DataFrame, **constants) -> DataFrame:
    """A one-row KPI frame as ``{constants..., kpi: value}``."""
    return df.select(_json(*[F.lit(v).alias(k) for k, v in constants.items()], *df.columns).alias("payload"))


def list_payload(df: DataFrame, name: str, columns: list[str], order: list[Column], size: int, **constants) -> DataFrame:
    """One row with ``{constants..., name: [rows]}`` (a report, the users of the
    day, the sectors of the day); a list longer than ``size`` is named under ``incompletas``."""
    fixed = [F.lit(v).alias(k) for k, v in constants.items()]
    row = df.sparkSession.range(1).select(*fixed, bounded_list(df, columns, order, size).alias("_list"))
    return row.select(_text(size, {"_list": [name]}, *constants, name).alias("payload"))


def list_pages(df: DataFrame, name: str, columns: list[str], order: list[Column], size: int, **constants) -> DataFrame:
    """Every page of a list: (pagina, paginas, entradas, payload), ``size`` entries a
    page and the rest in the last one.  Entries are numbered over ranges of the
    order and a page is gathered by its number, so no task holds more than its
    pages.  An empty list has one empty page."""
    placed = numbered(df.select(*columns), *order, name="_rank")
    page = F.floor((F.col("_rank") - 1) / size).cast("bigint") + 1
    packed = F.transform(F.sort_array(F.collect_list(F.struct("_rank", F.struct(*columns).alias("r")))), lambda x: x["r"])
    pages = placed.groupBy(page.alias("pagina")).agg(packed.alias(name))
    pages = df.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("pagina")).join(pages, "pagina", "full")
    entries = F.coalesce(placed.agg(F.max("_rank")).scalar(), F.lit(0)).cast("bigint")
    rows = F.coalesce(name, F.array().cast(pages.schema[name].dataType))
    fixed = [F.lit(v).alias(k) for k, v in constants.items()]
    return pages.select("pagina", F.greatest(F.lit(1), F.ceil(entries / size)).cast("bigint").alias("paginas"),
                        entries.alias("entradas"), _json(*fixed, rows.alias(name)).alias("payload"))
