"""Samples of a grid inside tiles, across their edges, next to missing pixels and outside."""

import math

from pathloom.sources import rasters

GRID = rasters.Grid(west=100.0, north=80.0, pixel=10.0, side=2)
PIXELS = {(c, r): 3.0 * c + 7.0 * r + (c * r) ** 2 for c in range(4) for r in range(4) if (c, r) != (3, 3)} | {(0, 3): -9999.0, (1, 3): math.inf}


def brute(x, y, smooth):
    across, down = (x - 100) / 10, (80 - y) / 10
    if not smooth:
        weights = {(math.floor(across), math.floor(down)): 1.0}
    else:
        c, r = math.floor(across - 0.5), math.floor(down - 0.5)
        fx, fy = across - 0.5 - c, down - 0.5 - r
        weights = {(c + i, r + j): (fx if i else 1 - fx) * (fy if j else 1 - fy) for i in (0, 1) for j in (0, 1)}
    total = 0.0
    for pixel, weight in weights.items():
        value = PIXELS.get(pixel)
        if weight > 0:
            if value is None or value == -9999 or math.isinf(value):
                return None
            total += weight * value
    return round(total, 9)


def test_samples(spark):
    raster = rasters.tiles(spark.createDataFrame([(c, r, v) for (c, r), v in PIXELS.items()], "column long, row long, value double"), GRID)
    assert raster.count() == 4 and {len(r["values"]) for r in raster.collect()} == {4}
    points = [(k, 96.0 + 2.5 * (k % 20), 84.0 - 2.5 * (k // 20)) for k in range(400)]
    frame = spark.createDataFrame([(*p, "v") for p in points], "id long, x double, y double, values string")
    for smooth in (False, True):
        found = {r["id"]: None if r["value"] is None else round(r["value"], 9) for r in rasters.sample(frame, ["id"], raster, GRID, smooth).collect()}
        assert found == {k: brute(x, y, smooth) for k, x, y in points}
        assert sum(v is None for v in found.values()) > 20 and sum(v is not None for v in found.values()) > 50
    assert rasters.sample(frame.limit(0), ["id"], raster, GRID).count() == 0
    assert rasters.sample(frame, ["id"], raster.limit(0), GRID).filter("value is not null").count() == 0
