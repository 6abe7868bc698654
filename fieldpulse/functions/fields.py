"""The answer fields the dashboards read out of the JSON ``data``.

Every query reads the same few values: the text of ``value``, whether
``value`` is an object, whether the key is present, and four keys under it.
On raw answers each field is extracted from the JSON text in the query.  On a
parsed answers table (``sources.tables.write_answer_table(..., parsed=True)``)
the fields are plain columns computed once at ingest, so a dashboard refresh
reads narrow columns (pruned in the scan, ``data`` not read at all) instead of
parsing every JSON text again.  Both give the same values: the parsed columns
are the same expressions, stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json import json_has_key, json_is_object, json_text

FIELDS = {
    "value_text": lambda: json_text("data", "value"),
    "value_is_object": lambda: json_is_object("data", "value"),
    "value_has_key": lambda: json_has_key("data", "value"),
    "value_latitude": lambda: json_text("data", "value", "latitude"),
    "value_longitude": lambda: json_text("data", "value", "longitude"),
    "value_label": lambda: json_text("data", "value", "label"),
    "value_cantidad": lambda: json_text("data", "value", "cantidad"),
}

FIELD_NAMES = list(FIELDS)


def field(df: DataFrame, name: str) -> Column:
    """The field as a column of ``df`` when stored, else extracted from ``data``."""
    return F.col(name) if name in df.columns else FIELDS[name]()


def parse_fields(df: DataFrame) -> DataFrame:
    """Answers with every field added as a column (one parse per row)."""
    return df.select("*", *[make().alias(name) for name, make in FIELDS.items() if name not in df.columns])
