"""Great-circle distances, line lengths and a grid for radius joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.schemas import GEO_FEATURE

EARTH_RADIUS_M = 6_371_000.0


def _half_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    return (
        F.pow(F.sin(dlat / 2), 2.0)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2.0)
    )


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres, atan2 form."""
    a = _half_chord(lon1, lat1, lon2, lat2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_pairs_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres, arcsin form; the root is held at 1 against rounding at the antipode."""
    a = _half_chord(lon1, lat1, lon2, lat2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def geo_feature(df: DataFrame, name: str) -> Column:
    """The nested feature, parsed first when the column holds JSON text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.from_json(F.col(name), GEO_FEATURE)
    return F.col(name)


def linestring_length_m(feature: Column) -> Column:
    """Sum of the steps between neighbours; null unless a LineString of two points or more."""
    line = feature["geometry"]["coordinates"]
    steps = F.arrays_zip(
        F.slice(line, F.lit(1), F.size(line) - 1).alias("a"),
        F.slice(line, F.lit(2), F.size(line) - 1).alias("b"),
    )
    total = F.aggregate(
        steps,
        F.lit(0.0),
        lambda acc, s: acc + haversine_m(s["a"][0], s["a"][1], s["b"][0], s["b"][1]),
    )
    return F.when((feature["geometry"]["type"] == "LineString") & (F.size(line) >= 2), total)


class RadiusGrid:
    """Cells for an equi-join that finds every pair within a radius.

    The globe is cut into latitude bands at least one radius high. Each band is
    cut into equal longitude cells, wide enough that two points within the
    radius, one of them in the band, lie in the same or in neighbouring cells.
    Longitude wraps round; bands near a pole are a single cell.
    """

    def __init__(self, radius_m: float):
        if radius_m <= 0:
            raise ValueError("radius_m must be greater than 0.")
        reach = radius_m / EARTH_RADIUS_M * (1 + 1e-9)
        self._reach = reach
        self._band_height = math.degrees(reach)

    def _cells(self, band: Column) -> Column:
        """Number of longitude cells in a band."""
        south = F.radians((band - 1) * self._band_height - 90.0)
        north = F.radians((band + 2) * self._band_height - 90.0)
        edge = F.greatest(F.abs(south), F.abs(north))
        ratio = F.sin(F.lit(self._reach / 2)) / F.cos(edge)
        usable = (edge < math.pi / 2 - self._reach) & (ratio < 0.25)
        width = 2 * F.asin(F.least(ratio, F.lit(1.0)))
        return F.when(usable, F.floor(F.lit(2 * math.pi * (1 - 1e-9)) / width)).otherwise(F.lit(1)).cast("long")

    def _placed(self, df: DataFrame, lon: str, lat: str, step: Column) -> DataFrame:
        """Add _band, moved by a step, with its _cells and the _cell of the longitude. Every
        value is a column of its own, so that none is worked out more than once."""
        turn = (F.col(lon) + 180.0) / 360.0
        return (
            df.withColumn("_band", F.floor((F.col(lat) + 90.0) / self._band_height) + step)
            .withColumn("_cells", self._cells(F.col("_band")))
            .withColumn("_turn", turn - F.floor(turn))
            .withColumn("_cell", F.least(F.floor(F.col("_turn") * F.col("_cells")), F.col("_cells") - 1))
            .drop("_turn")
        )

    def with_home(self, df: DataFrame, lon: str, lat: str) -> DataFrame:
        """Add the (_band, _cell) of each point."""
        return self._placed(df, lon, lat, F.lit(0)).drop("_cells")

    def with_neighbourhood(self, df: DataFrame, lon: str, lat: str) -> DataFrame:
        """List each point under every (_band, _cell) whose points may be within the radius;
        each cell appears once."""
        steps = df.withColumn("_step", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
        near = F.array_distinct(F.array(*[F.pmod(F.col("_cell") + i, F.col("_cells")) for i in (-1, 0, 1)]))
        return (
            self._placed(steps, lon, lat, F.col("_step"))
            .withColumn("_cell", F.explode(near)).drop("_step", "_cells")
        )
