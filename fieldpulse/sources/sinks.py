"""Sinks: the flattened export and the dashboard payloads, written in parallel
by the executors (the dashboard built one spreadsheet in memory instead)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: worked out
    once, and lost executors cost nothing.  The folder is cleared with the
    cluster's checkpoint folder."""
    path = f"{checkpoint_root(df.sparkSession)}/fieldpulse-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_export(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None,
                 mode: str = "overwrite") -> None:
    """Write an export (e.g. ``export_all``) as CSV with a header, or parquet.
    One file per task; ``partition_by=["created_date"]`` gives one folder per day."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")


def with_created_date(df: DataFrame) -> DataFrame:
    return df.withColumn("created_date", F.to_date("created_at"))


def write_payload(payload: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the JSON text of a dashboard payload (one line per payload row)."""
    payload.select("payload").write.mode(mode).text(path)


def geojson_feature(properties: list[str], lat: str = "latitud", lon: str = "longitud") -> Column:
    """A row's point as a GeoJSON feature (``[lon, lat]`` order)."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(c) for c in properties]).alias("properties"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates")).alias("geometry"))


def geojson_text(properties: list[str], lat: str = "latitud", lon: str = "longitud") -> Column:
    """A row's point as GeoJSON text."""
    return F.to_json(geojson_feature(properties, lat, lon), {"ignoreNullFields": "false"})


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write each ``text`` as a file of its own (``operators.geo.feature_documents``)."""
    documents.select("text").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_geojson_points(points: DataFrame, path: str, properties: list[str],
                         lat: str = "latitud", lon: str = "longitud", mode: str = "overwrite") -> None:
    """Write points as a GeoJSON text sequence (one Point feature per line,
    ``[lon, lat]`` order), one file per task; readable back with
    ``read_geojson(..., sequence=True)`` or by any GeoJSON-sequence tool."""
    points.select(geojson_text(properties, lat, lon)).write.mode(mode).text(path)
