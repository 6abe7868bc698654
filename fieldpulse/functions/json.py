"""JSON helpers over a raw JSON text column (built-in expressions only).

Text extraction uses ``get_json_object`` (numbers as a parser prints them, 1.50 as
1.5; NULL for JSON null and for missing keys).  Kind tests go through
VARIANT (``try_parse_json``), which knows a JSON object from a string that
merely looks like one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(keys) -> str:
    # bracket notation so keys with dots or spaces are safe
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys)


def json_text(col, *keys: str) -> Column:
    """``data->>'k'`` / ``data->'a'->>'b'``: the text at a path, NULL if absent or JSON null."""
    return F.get_json_object(F.col(col) if isinstance(col, str) else col, _path(keys))


def json_kind(col, *keys: str) -> Column:
    """Kind of the value at a path: OBJECT, ARRAY, STRING, NULL (JSON null), numbers...;
    SQL NULL when the path is absent or the text is not JSON."""
    c = F.col(col) if isinstance(col, str) else col
    v = F.try_parse_json(c)
    if keys:
        v = F.try_variant_get(v, _path(keys), "variant")
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z_]+)", 1)


def json_is_object(col, *keys: str) -> Column:
    """``jsonb_typeof(x) = 'object'``; false (not NULL) when absent."""
    return F.coalesce(json_kind(col, *keys) == F.lit("OBJECT"), F.lit(False))


def json_has_key(col, key: str) -> Column:
    """``data ? 'key'``: top-level key present (value may be JSON null), or, for a
    top-level array, the string is an element."""
    c = F.col(col) if isinstance(col, str) else col
    keys = F.json_object_keys(c)
    as_array = F.from_json(c, "array<string>")
    return F.coalesce(F.array_contains(keys, key), F.array_contains(as_array, key), F.lit(False))
