"""Flatten the JSON ``data`` of answers into one column per leaf path, the way
``json_normalize`` names them (``value``, ``value.latitude``, ...).

1. ``leaf_paths``: the distinct leaf paths.  Each row's object is walked with
   nested ``transform``/``flatten``, LEVELS levels at a time; paths are
   deduplicated map-side.  What lies deeper goes on as (path, object text) rows
   of its own, so one deep row costs another walk of that row, not of the table.
2. ``flatten_json``: each object is parsed once into ``map<string,string>`` and
   values are taken by key, so any key works (quotes, dots, ``*``, empty).  A
   path that leads to an object gives NULL (its leaves have their own columns);
   values keep their text, arrays stay JSON text.  Pass ``paths=`` to skip step 1
   (required on streams and when a stable export layout is wanted): then no job
   runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ANSWER_COLUMNS

LEVELS = 8
#: Paths that are looked for at plan time; more (ids or dates as keys) are an error, and
#: ``profile`` keeps and exports layouts of any width.
MAX_PATHS = 10_000


def _as_map(v: Column) -> Column:
    # an object variant as map<string, variant>; NULL for anything else
    return F.try_variant_get(v, "$", "map<string,variant>")


def row_paths(v: Column, prefix: Column, levels: int, kinds: bool = True) -> Column:
    """array<struct<path, rest[, kind]>>: leaf paths under ``v``; ``rest`` is the
    text of an object below the last level, ``kind`` the name of a leaf's type."""
    none = F.lit(None).cast("string")

    def leaf(path, value, rest=none):
        kind = [F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).alias("kind")] if kinds else []
        return F.array(F.struct(path.alias("path"), rest.alias("rest"), *kind))

    def entry(e):
        path = F.concat(prefix, F.array(e["key"]))
        deeper = (leaf(path, e["value"], F.to_json(e["value"])) if levels <= 1
                  else row_paths(e["value"], path, levels - 1, kinds))
        return F.when(_as_map(e["value"]).isNotNull(), deeper).otherwise(leaf(path, e["value"]))
    return F.flatten(F.transform(F.map_entries(_as_map(v)), entry))


def leaf_paths(df: DataFrame, col: str = "data", levels: int = LEVELS, max_paths: int = MAX_PATHS) -> list[tuple[str, ...]]:
    """Sorted list of leaf paths (tuples of keys) present in ``col``."""
    rows = df.select(F.array().cast("array<string>").alias("prefix"), F.col(col).alias("text"))
    found: set[tuple[str, ...]] = set()
    while True:
        paths = row_paths(F.try_parse_json("text"), F.col("prefix"), levels, kinds=False)
        rows = rows.select(F.explode(F.array_distinct(paths)).alias("p")).select("p.*")
        more = (rows.select("path", F.col("rest").isNotNull().alias("deeper")).distinct()
                .limit(2 * max_paths + 1).collect())
        found.update(tuple(r.path) for r in more if not r.deeper)
        if len(found) > max_paths or len(more) > 2 * max_paths:
            raise ValueError(f"more than {max_paths} leaf paths: give the export its paths")
        if not any(r.deeper for r in more):
            return sorted(found)
        rows = rows.where("rest is not null").distinct().select(F.col("path").alias("prefix"), F.col("rest").alias("text"))


def column_names(paths, prefix: str = "data.") -> list[str]:
    """Column name of each path: its keys joined by dots.  A name that an earlier
    path (in sorted order) has already, also in another case, gets ``__2``,
    ``__3``, ... so that every file format can hold the export."""
    names: dict[tuple[str, ...], str] = {}
    taken: set[str] = set()
    for path in sorted(set(map(tuple, paths))):
        base = name = prefix + ".".join(path)
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{base}__{n}"
        taken.add(name.lower())
        names[path] = name
    return [names[tuple(p)] for p in paths]


def flatten_json(df: DataFrame, paths, col: str = "data", prefix: str = "data.",
                 keep: list[str] | None = None, layout=None) -> DataFrame:
    """Answers with ``col`` replaced by one text column per leaf path; the prefix
    keeps a JSON key such as ``id`` from clashing with a table column.  ``layout``
    has all paths where ``paths`` are a part of them."""
    keep = [c for c in (keep or ANSWER_COLUMNS) if c != col]
    paths = [tuple(p) for p in paths]
    layout = paths if layout is None else [tuple(p) for p in layout]
    objects = {p[:i] for p in layout for i in range(1, len(p))}
    inner = sorted({p[:i] for p in paths for i in range(1, len(p))} | objects.intersection(paths), key=len)  # on the way to a leaf
    names = dict(zip(layout, column_names(layout, prefix), strict=True))
    out = df.select(*keep, F.col(col).alias("_j"))
    out = out.select(*keep, _text_map(F.col("_j")).alias("_m"),
                     *([_variant_map(F.col("_j")).alias("_v")] if inner else []))
    maps, kinds = {(): "_m"}, {(): "_v"}
    for n, p in enumerate(inner):
        maps[p], kinds[p] = f"_m{n}", f"_v{n}"
        value = F.try_element_at(F.col(kinds[p[:-1]]), F.lit(p[-1]))
        out = out.withColumn(kinds[p], _as_map(value))
        out = out.withColumn(maps[p], F.when(F.col(kinds[p]).isNotNull(),
                                             _text_map(F.try_element_at(F.col(maps[p[:-1]]), F.lit(p[-1])))))
    cols = [F.col(c) for c in keep]
    for path in paths:
        text = F.try_element_at(F.col(maps[path[:-1]]), F.lit(path[-1]))
        if path in kinds:  # an object in some rows
            text = F.when(F.col(kinds[path]).isNull(), text)
        cols.append(text.alias(names[path]))
    return out.select(*cols)


def _text_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def _variant_map(text: Column) -> Column:
    return _as_map(F.try_parse_json(text))


def export_flat(df: DataFrame, paths=None, col: str = "data", prefix: str = "data.") -> DataFrame:
    """``flatten_json`` with paths discovered from the data when not given."""
    if paths is None:
        paths = leaf_paths(df, col)
    return flatten_json(df, paths, col, prefix)
