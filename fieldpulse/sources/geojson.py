"""GeoJSON features as a DataFrame: (feature_id, properties, geometry, vertices).

Two layouts:

* ``FeatureCollection`` documents: one JSON document per file, of any size, read in
  byte ranges by many tasks (or, with ``split=False``, each file by one task);
* GeoJSON text sequences (one feature per line).

``properties`` is ``map<string,string>`` (numbers keep their text, nested
values their JSON text).  ``vertices`` lists every coordinate pair of the
geometry as ``struct<lat,lon>`` (GeoJSON order is lon, lat), at any depth of
nested collections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sinks import scratch_table

FEATURE_DDL = ("type STRING, properties MAP<STRING, STRING>, "
               "geometry STRUCT<type: STRING, coordinates: STRING, geometries: STRING>")
COLLECTION_DDL = ("type STRING, features ARRAY<STRUCT<type: STRING, properties: MAP<STRING, STRING>, "
                  "geometry: STRUCT<type: STRING, coordinates: STRING, geometries: STRING>>>")

#: A pair: what follows a bracket that is followed by a number.
PAIR = r"\[\s*(-?\d[-+.\deE]*\s*,\s*-?\d[-+.\deE]*)"
#: The coordinates of a collection's members, at any depth.  Quotes inside texts are escaped, so a text can't hold the key.
MEMBERS = r'(?<!\\)"coordinates"\s*:\s*(\[[-+.\deE\s,\[\]]*\])'
#: The key of the features, up to the first of them.
FEATURES_KEY = r'"features"\s*:\s*\[(?=\s*\{)'


def _vertices(geometry: Column) -> Column:
    """All pairs of a geometry.  A coordinates text has only brackets and numbers, so a
    pair is two numbers after a bracket whatever the geometry's type is."""
    coordinates = F.when(geometry["type"] == "GeometryCollection",
                         F.array_join(F.regexp_extract_all(geometry["geometries"], F.lit(MEMBERS), 1), ",")
                         ).otherwise(geometry["coordinates"])
    pairs = F.regexp_extract_all(coordinates, F.lit(PAIR), 1)
    number = lambda p, i: F.trim(F.split_part(p, F.lit(","), F.lit(i))).cast("double")
    return F.transform(pairs, lambda p: F.struct(number(p, 2).alias("lat"), number(p, 1).alias("lon")))


def _shape(features: DataFrame) -> DataFrame:
    return features.select("feature_id", "properties", "geometry", _vertices(F.col("geometry")).alias("vertices"))


def features_from_text(df: DataFrame, text: str, feature_id: str) -> DataFrame:
    """Features from a column of GeoJSON text, one feature per row (no file needed)."""
    parsed = df.select(F.col(feature_id).cast("string").alias("feature_id"), F.from_json(text, FEATURE_DDL).alias("f"))
    return _shape(parsed.select("feature_id", "f.properties", "f.geometry"))


def read_geojson(spark: SparkSession, path: str, sequence: bool = False, split: bool = True) -> DataFrame:
    """Features of the files under ``path``; ``feature_id`` is the file and the
    feature's place in it (in a sequence: a number that is unique in the read)."""
    if sequence:
        raw = spark.read.schema(FEATURE_DDL).json(path)
        feats = raw.select(F.concat(F.input_file_name(), F.lit("#"),
                                    F.monotonically_increasing_id().cast("string")).alias("feature_id"),
                           "properties", "geometry")
    elif split:
        texts = feature_texts(spark, path).select("file", "i", F.from_json("text", FEATURE_DDL).alias("f"))
        feats = texts.where("f.type = 'Feature'").select(
            F.concat("file", F.lit("#"), F.col("i").cast("string")).alias("feature_id"), "f.properties", "f.geometry")
    else:
        raw = spark.read.schema(COLLECTION_DDL).option("multiLine", True).json(path)
        feats = raw.select(F.col("_metadata.file_path").alias("_f"), F.posexplode("features").alias("_i", "f")) \
            .select(F.concat("_f", F.lit("#"), F.col("_i").cast("string")).alias("feature_id"),
                    "f.properties", "f.geometry")
    return _shape(feats)


# --------------------------------------------------------------------------- one document, many tasks

def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, ""))


def _depth(plain: Column) -> Column:
    """Brackets opened less brackets closed, outside of texts (``plain`` begins outside one)."""
    bare = F.regexp_replace(plain, '"[^"]*("|$)', "")
    return _count(bare, r"[^\[{]") - _count(bare, r"[^\]}]")


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, text): the JSON text of each element of a document's ``features``.

    The files are read as pieces that end at a closing brace, in the usual byte
    ranges.  Whether a piece begins inside a text, and how deep in brackets, follows
    from what is before it: the quotes and brackets are counted per piece, added up
    within each byte range and then over the ranges of a file (one row per range),
    so no task goes through a whole file.  A feature ends with a piece that comes
    back to the depth of the elements; the pieces of one feature are put
    together again.  Foreign members before or after the features are not taken;
    a document without features gives none.  A feature must fit a task."""
    raw = spark.read.option("lineSep", "}").text(path)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = _count(plain, '[^"]')
    inside = lambda start: (F.lit(start) + F.col("quotes")) % 2  # noqa: E731  whether the closing brace is in a text
    key = F.regexp_instr("value", F.lit(FEATURES_KEY))
    head = F.regexp_replace(F.substring(F.col("value"), F.lit(1), key - 1), r"(?s)\\.", "")
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("seq"), "value", quotes.alias("quotes"), plain.alias("plain")).select(
        "file", "range", "seq", "value", "quotes",
        (_depth(F.col("plain")) - (1 - inside(0))).alias("out"),
        (_depth(F.concat(F.lit('"'), "plain")) - (1 - inside(1))).alias("in"),
        F.when(key > 0, _depth(head)).alias("key"))
    pieces = scratch_table(pieces, "geojson")

    before = Window.partitionBy("file", "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ranges_before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    def carry(rows: DataFrame, **sums: Column) -> DataFrame:
        """Rows with the sums over all earlier ranges of their file."""
        per = rows.groupBy("file", "range").agg(*[c.alias(n) for n, c in sums.items()])
        per = per.select("file", "range", *[F.coalesce(F.sum(n).over(ranges_before), F.lit(0)).alias(n) for n in sums])
        return rows.join(per, ["file", "range"])

    def running(column: Column) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    rows = pieces.select("file", "range", "seq", "quotes", "out", "in", "key").withColumn("q", running(F.col("quotes")))
    rows = carry(rows, q0=F.sum("quotes")).withColumn("text", (F.col("q0") + F.col("q")) % 2 == 1)
    rows = rows.withColumn("delta", F.when(F.col("text"), F.col("in")).otherwise(F.col("out"))).withColumn("d", running(F.col("delta")))
    rows = carry(rows, d0=F.sum("delta")).withColumn("d", F.col("d0") + F.col("d"))
    ends = ((F.col("text").cast("int") + F.col("quotes")) % 2 == 0) & (F.col("d") + F.col("delta") == 2)
    rows = rows.withColumn("ends", ends.cast("int")).withColumn(
        "opens", F.coalesce(~F.col("text") & (F.col("d") + F.col("key") == 1), F.lit(False)).cast("int"))
    rows = rows.withColumn("opened", F.sum("opens").over(upto))
    rows = carry(rows, opened0=F.max("opened")).withColumn("opened", F.col("opened") + F.col("opened0") > 0)
    rows = rows.withColumn("ends", F.when(F.col("opened"), F.col("ends")).otherwise(0)).withColumn("n", running(F.col("ends")))
    rows = carry(rows, n0=F.sum("ends")).where("opened").select("file", "range", "seq", "opens", (F.col("n0") + F.col("n")).alias("i"))

    value = F.when(F.col("opens") == 1, F.regexp_replace("value", f"(?s)^.*?{FEATURES_KEY}", "")).otherwise(F.col("value"))
    both = pieces.select("file", "range", "seq", "value").join(rows, ["file", "range", "seq"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("range", "seq", F.concat(value, F.lit("}")).alias("t")))), lambda x: x["t"])
    whole = both.groupBy("file", "i").agg(F.array_join(parts, "").alias("text"))
    return whole.select("file", "i", F.regexp_replace("text", r"^[\s,]+", "").alias("text"))
