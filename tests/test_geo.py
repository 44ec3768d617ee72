import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions.geo import EARTH_RADIUS_M, geo_feature, haversine_m, haversine_pairs_m, linestring_length_m
from kerbside.operators.nearby import haversine_pairs


def metres(lon1, lat1, lon2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(a)))


def test_both_distance_forms(spark):
    rnd = random.Random(1)
    points = [tuple(rnd.uniform(-a, a) for a in (180.0, 90.0, 180.0, 90.0)) for _ in range(200)]
    df = spark.createDataFrame(points, "a double, b double, c double, d double")
    args = [F.col(x) for x in "abcd"]
    for r in df.select("*", haversine_m(*args).alias("x"), haversine_pairs_m(*args).alias("y")).collect():
        assert r["x"] == pytest.approx(metres(*r[:4]), rel=1e-6, abs=1e-3)
        assert r["y"] == pytest.approx(metres(*r[:4]), rel=1e-6, abs=1e-3)


@pytest.mark.parametrize("shape, length", [
    ('{"geometry":{"type":"Point","coordinates":[2.0,48.0]}}', None),
    ('{"geometry":{"type":"LineString","coordinates":[[2.0,48.0]]}}', None),
    ('{"geometry":{"type":"LineString","coordinates":[[2.0,48.0],[2.0,48.01]]}}', metres(2, 48, 2, 48.01)),
    ('{"geometry":{"type":"LineString","coordinates":[[2.0,48.0],[2.0,48.01],[2.01,48.01]]}}',
     metres(2, 48, 2, 48.01) + metres(2, 48.01, 2.01, 48.01)),
    ("{not json", None), (None, None), ('{"type":"Feature"}', None),
])
def test_line_length(spark, shape, length):
    df = spark.createDataFrame([(shape,)], "geo_shape string")
    got = df.select(linestring_length_m(geo_feature(df, "geo_shape")).alias("m")).first()["m"]
    assert got is None if length is None else got == pytest.approx(length)


@pytest.mark.parametrize("radius", [5_000.0, 400_000.0, 3_000_000.0])
def test_radius_join_finds_every_pair_once(spark, radius):
    """Around Paris, across the date line and at the poles."""
    rnd = random.Random(int(radius))
    spread = math.degrees(radius / EARTH_RADIUS_M) * 2

    def cloud(lon, lat, n):
        wide = min(spread / max(math.cos(math.radians(lat)), 0.05), 180.0)
        out = []
        for _ in range(n):
            x, y = lon + rnd.uniform(-wide, wide), lat + rnd.uniform(-spread, spread)
            out.append(((x + 180) % 360 - 180, max(-90.0, min(90.0, y))))
        return out

    centres = [(2.35, 48.85), (179.99, 10.0), (-179.99, -60.0), (0.0, 89.9), (100.0, -89.9)]
    roads = [p for c in centres for p in cloud(*c, 25)]
    venues = [p for c in centres for p in cloud(*c, 25)]
    left = spark.createDataFrame([(str(i), y, x) for i, (x, y) in enumerate(roads)], "iu_ac string, latitude double, longitude double")
    right = spark.createDataFrame([(y, x) for x, y in venues], "venue_latitude double, venue_longitude double")
    got = sorted((r["iu_ac"], r["venue_latitude"], r["venue_longitude"]) for r in haversine_pairs(left, right, radius).collect())
    want = sorted((str(i), v[1], v[0]) for i, r in enumerate(roads) for v in set(venues) if metres(*r, *v) <= radius)
    assert got == want and want
