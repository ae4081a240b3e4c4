"""Projections against published points, each other, and back."""

import math

import pytest
from pyspark.sql import functions as F

from shoreline.functions import geo
from shoreline.functions.projections import GRS80, SYSTEMS, Lambert, PolarStereographic, TransverseMercator, projection_of
from shoreline.sources.rasters import Frame


def table(spark, places):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places)], "id long, lon double, lat double")


def forward(spark, p, places):
    x, y = p.forward(F.col("lon"), F.col("lat"))
    return [(r.x, r.y) for r in table(spark, places).select("id", x.alias("x"), y.alias("y")).orderBy("id").collect()]


AREAS = {2154: (-5, 10, 41, 51), 3034: (-20, 40, 30, 70), 3413: (-180, 180, 55, 89.9), 3995: (-180, 180, 60, 89.9), 3031: (-180, 180, -89.9, -60), 3857: (-179, 179, -80, 80), 32651: (118, 128, 0, 83), 32733: (10, 20, -79, 0)}


@pytest.mark.parametrize("code", AREAS)
def test_there_and_back(spark, code):
    """Under a tenth of a millimetre."""
    p, (w, e, s, n) = projection_of(code), AREAS[code]
    places = table(spark, [(w + (e - w) * (k * 37 % 101) / 101, s + (n - s) * (k * 61 % 97) / 97) for k in range(400)])
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    back = places.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat})
    off = F.greatest(F.abs(geo.normalize_longitude(F.col("lon2") - F.col("lon"), False)) * F.cos(F.radians("lat")), F.abs(F.col("lat2") - F.col("lat"))) * 111_320.0
    assert back.agg(F.max(off)).first()[0] < 1e-4 and back.where("x is null or isnan(x) or isnan(y)").count() == 0


def test_published_points(spark):
    """Poles, origins and true scale, and the worked example of the conic on the ellipsoid of Clarke 1866."""
    x, y = forward(spark, Lambert(33.0, 45.0, 23.0, -96.0, ellipsoid=(6_378_206.4, 294.978698214)), [(-75.0, 35.0)])[0]
    assert x == pytest.approx(1_894_410.9, abs=0.1) and y == pytest.approx(1_564_649.5, abs=0.1)
    assert forward(spark, SYSTEMS[2154], [(3.0, 46.5)])[0] == pytest.approx((700_000.0, 6_600_000.0), abs=1e-6)
    for code, lat in ((3413, 90.0), (3031, -90.0)):
        assert forward(spark, SYSTEMS[code], [(12.0, lat)])[0] == pytest.approx((0.0, 0.0), abs=1e-6)
    (_, a), (_, b) = forward(spark, PolarStereographic(70.0, -45.0), [(-45.0, 70.0), (-45.0, 70.001)])
    e2 = 1 / 298.257223563 * (2 - 1 / 298.257223563)
    metres = 6_378_137.0 * (1 - e2) / (1 - e2 * math.sin(math.radians(70.0005)) ** 2) ** 1.5 * math.radians(0.001)
    assert b - a == pytest.approx(metres, rel=1e-4)
    east, north = forward(spark, TransverseMercator(123.0, ellipsoid=GRS80), [(123.0, 0.0)])[0]
    assert (east, north) == pytest.approx((500_000.0, 0.0), abs=1e-9)
    assert forward(spark, SYSTEMS[3857], [(180.0, 0.0)])[0] == pytest.approx((20_037_508.342789, 0.0), abs=1e-5)


def test_agrees_with_the_inverse_of_utm(spark):
    p = projection_of(32651)
    x, y = p.forward(F.col("lon"), F.col("lat"))
    t = table(spark, [(120.0 + k % 7, 10.0 + k % 61) for k in range(200)]).withColumns({"x": x, "y": y})
    lon, lat = geo.utm_to_lonlat(F.col("x"), F.col("y"), 51, True)
    assert t.agg(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()[:] == pytest.approx((0.0, 0.0), abs=1e-8)


def test_rasters_in_other_systems(spark):
    f = Frame(600_000.0, 6_700_000.0, 25.0, -25.0, 10, 10, "EPSG:2154", "metre")
    p = f.centers(spark.createDataFrame([(3, 4)], "row int, col int"))
    lon, lat = f.lonlat(F.col("x"), F.col("y"))
    x, y = projection_of(2154).forward(lon, lat)
    assert p.select(x, y, "x", "y").first()[:] == pytest.approx((600_112.5, 6_699_912.5, 600_112.5, 6_699_912.5), abs=1e-4)
    with pytest.raises(ValueError):
        Frame(0.0, 0.0, 1.0, -1.0, 1, 1, "EPSG:27700", "metre").lonlat(F.lit(0.0), F.lit(0.0))
