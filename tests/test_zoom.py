"""Clusters and heat per zoom against cells worked out point by point."""

import decimal
import math
import random
from collections import defaultdict

import pytest

from fieldpulse.operators import zoom


def _points(spark, rows):
    return spark.createDataFrame([(decimal.Decimal(str(a)), decimal.Decimal(str(b)), p) for a, b, p in rows],
                                 "latitud decimal(18,9), longitud decimal(18,9), total_personas int").repartition(3)


def _xy(lat, lon, level):
    lat = math.radians(max(-zoom.EDGE, min(zoom.EDGE, lat)))
    share = ((lon + 180) / 360, (1 - math.log(math.tan(lat) + 1 / math.cos(lat)) / math.pi) / 2)
    return tuple(max(0, min((1 << level) - 1, math.floor(round(s * (1 << level), 6)))) for s in share)


def _key(x, y, level):
    return "".join(str((x >> i & 1) + 2 * (y >> i & 1)) for i in range(level - 1, -1, -1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(round(rng.uniform(-80, 80), 5), round(rng.uniform(-179, 179), 5), rng.randrange(0, 9)) for _ in range(150)]
    out += [(4.65, -74.1, 2)] * 200                                             # a hot place
    return out + [(0, -74.1, 5), (4.6, 0, 5), (89.9, 10.0, 1), (-89.9, -10.0, 1), (10.0, 180.0, 3), (10.0, -180.0, 3), (11.0, 200.0, 4)]


def test_pyramid(spark, rows):
    want = defaultdict(lambda: [0, 0])
    for lat, lon, p in rows:
        if lat and lon:
            for z in (0, 3, 9, 18):
                w = want[z, _key(*_xy(lat, lon, z + 2), z + 2)]
                w[0] += p
                w[1] += 1
    got = zoom.density_pyramid(_points(spark, rows), zooms=(9, 0, 18, 3)).collect()
    assert {(r.zoom, r.quadkey): [r.personas, r.puntos] for r in got} == dict(want)
    hot = [r for r in got if r.zoom == 18 and r.puntos == 200]
    assert [(r.centro_lat, r.centro_lon, r.personas) for r in hot] == [(4.65, -74.1, 400)]


def test_keys_begin_with_their_parents(spark, rows):
    got = zoom.density_pyramid(_points(spark, rows), zooms=range(0, 6)).collect()
    total = {z: sum(r.puntos for r in got if r.zoom == z) for z in range(6)}
    assert set(total.values()) == {len(rows) - 2}
    for r in got:
        if r.zoom < 5:
            children = [c for c in got if c.zoom == r.zoom + 1 and c.quadkey.startswith(r.quadkey)]
            assert sum(c.puntos for c in children) == r.puntos and sum(c.personas for c in children) == r.personas
    whole = zoom.density_pyramid(_points(spark, rows), zooms=[0], pixels=256).collect()
    assert [(r.quadkey, r.puntos) for r in whole] == [("", len(rows) - 2)]


def test_heat(spark, rows):
    around = zoom.kernel(4, 12, 8)
    assert (0, 0, 1000) in around and {(-i, j, w) for i, j, w in around} == set(around) == {(j, i, w) for i, j, w in around}
    assert max(w for i, j, w in around if abs(i) == 4) < 1000 and all(math.hypot(i, j) * 4 < 20 for i, j, _ in around)
    want = defaultdict(int)
    for lat, lon, p in rows:
        if lat and lon and p:
            for z in (2, 8):
                x, y = _xy(lat, lon, z + 6)
                for i, j, w in around:
                    if 0 <= x + i < 1 << z + 6 and 0 <= y + j < 1 << z + 6:
                        want[z, x + i, y + j] += p * w
    got = zoom.heat_kernel(_points(spark, rows), zooms=(2, 8)).collect()
    assert {(r.zoom, r.x, r.y): r.calor for r in got} == dict(want)


def test_nothing_to_draw_and_bad_cells(spark):
    for rows in ([], [(0, 0, 3)], [(0, 5, 3)]):
        assert zoom.density_pyramid(_points(spark, rows)).count() == 0 and zoom.heat_kernel(_points(spark, rows)).count() == 0
    for pixels in (0, 3, 512):
        with pytest.raises(ValueError):
            zoom.density_pyramid(_points(spark, []), pixels=pixels)
