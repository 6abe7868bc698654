"""Map layers per zoom: clusters and heat as the map draws them, worked out from
cells of the web map's square grid.

A cell of level L is one of 2^L columns and rows of the Mercator square.  Points
are counted once in the cells of the finest level that is needed; a coarser cell
is its index without the last bits, so every zoom follows from those counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import nonzero_point

#: Pixels of a map tile's side, and the latitude at which the Mercator square ends.
TILE = 256
EDGE = 85.05112877980659


def _level(zoom: int, pixels: int) -> int:
    """Level whose cells are ``pixels`` wide at ``zoom``."""
    if pixels < 1 or TILE % pixels:
        raise ValueError("a cell is a power of two of pixels wide, a tile at most")
    return zoom + (TILE // pixels).bit_length() - 1


def _cell(share: Column, level: int) -> Column:
    """Index of a place from 0 to 1; rounded, so that a place on a border has the same cell everywhere."""
    at = F.floor(F.round(share * float(1 << level), 6)).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.lit((1 << level) - 1), at)).cast("bigint")


def mercator_cells(points: DataFrame, level: int, lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """``points`` with the column ``x`` and row ``y`` of their cell; places beyond the square are in its outermost cells."""
    phi = F.radians(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col(lat).cast("double"))))
    across = (F.col(lon).cast("double") + 180.0) / 360.0
    down = (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0
    return points.withColumn("x", _cell(across, level)).withColumn("y", _cell(down, level))


def quadkey(x: Column, y: Column, level: Column) -> Column:
    """The cell's digits from the coarsest level down; a cell's key begins with its parents' keys."""
    bit = lambda v, i: F.call_function("getbit", v, i).cast("int")
    digits = F.transform(F.sequence(level - 1, F.lit(0), F.lit(-1)), lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string"))
    return F.when(level > 0, F.array_join(digits, "")).otherwise("")


def density_pyramid(person_pts: DataFrame, zooms=range(0, 19), pixels: int = 64) -> DataFrame:
    """Clusters per zoom: (zoom, quadkey, personas, puntos, centro_lat, centro_lon),
    cells of ``pixels`` pixels at that zoom.  The points are aggregated once, in
    the cells of the finest zoom; each of those cells then counts in its cell
    of every zoom, so a place with a third of all points costs one row per task."""
    zooms = sorted(zooms)
    finest = _level(zooms[-1], pixels)
    points = mercator_cells(person_pts.where(nonzero_point()), finest)
    cells = points.groupBy("x", "y").agg(F.sum("total_personas").alias("p"), F.count(F.lit(1)).alias("n"),
                                         F.sum("latitud").alias("lat"), F.sum("longitud").alias("lon"))
    each = cells.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    up = (F.lit(zooms[-1]) - F.col("zoom")).cast("int")
    coarse = lambda c: F.call_function("shiftright", F.col(c), up)
    out = each.groupBy("zoom", coarse("x").alias("x"), coarse("y").alias("y")).agg(
        F.sum("p").cast("bigint").alias("personas"), F.sum("n").cast("bigint").alias("puntos"),
        F.sum("lat").alias("lat"), F.sum("lon").alias("lon"))
    mean = lambda c: F.round(F.col(c).cast("double") / F.col("puntos"), 9)
    level = F.col("zoom") + (finest - zooms[-1])
    return out.select("zoom", quadkey(F.col("x"), F.col("y"), level).alias("quadkey"), "personas", "puntos",
                      mean("lat").alias("centro_lat"), mean("lon").alias("centro_lon"))


def kernel(pixels: int, radius: int, blur: int) -> list[tuple[int, int, int]]:
    """(columns, rows, weight) of the cells around a point: full weight within
    ``radius`` pixels less the blur, falling to 0 at ``radius`` + ``blur``, in thousandths."""
    reach = radius + blur
    steps = range(-(reach // pixels), reach // pixels + 1)
    weigh = lambda d: round(1000 * max(0.0, min(1.0, (reach - d) / (2 * blur))))
    found = [(i, j, weigh(pixels * math.hypot(i, j))) for i in steps for j in steps]
    return [k for k in found if k[2]]


def heat_kernel(person_pts: DataFrame, zooms=(8, 11, 13, 14), pixels: int = 4, radius: int = 12, blur: int = 8) -> DataFrame:
    """Heat per zoom: (zoom, x, y, calor), the persons of each cell of ``pixels``
    pixels scattered over the cells around it by ``kernel``, in thousandths of a
    person.  Points are added up per cell and zoom first, so a cell is scattered
    once, over a fixed number of neighbours; cells beyond the square are left out."""
    zooms = sorted(zooms)
    finest = _level(zooms[-1], pixels)
    points = mercator_cells(person_pts.where(nonzero_point() & (F.col("total_personas") > 0)), finest)
    cells = points.groupBy("x", "y").agg(F.sum("total_personas").alias("p"))
    up = (F.lit(zooms[-1]) - F.col("zoom")).cast("int")
    coarse = lambda c: F.call_function("shiftright", F.col(c), up)
    each = cells.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    each = each.groupBy("zoom", coarse("x").alias("x"), coarse("y").alias("y")).agg(F.sum("p").alias("p"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel(pixels, radius, blur)])
    spread = each.withColumn("k", F.explode(around)).select(
        "zoom", (F.col("x") + F.col("k.i")).alias("x"), (F.col("y") + F.col("k.j")).alias("y"), (F.col("p") * F.col("k.w")).alias("c"))
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("zoom") + (finest - zooms[-1])).cast("int"))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < side) & (F.col("y") < side)
    return spread.where(inside).groupBy("zoom", "x", "y").agg(F.sum("c").cast("bigint").alias("calor"))
