"""Great circles, and bins of the globe in which places within a radius meet."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


class Globe:
    """Bins of latitude bands twice as high as the radius; a band has as many bins of longitude as keep them as wide at its far edge.

    A point lies in one bin, and the circle around a place touches about four."""

    def __init__(self, radius_km: float):
        self.radius = radius_km / EARTH_KM
        self.reach = math.degrees(self.radius) * 1.0001  # a hair more, so that rounding moves no pair apart
        self.step = 2 * self.reach
        self.top = math.floor(180 / self.step)

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / self.step), F.lit(self.top)).cast("long")

    def bins(self, band: Column) -> Column:
        edge = F.greatest(F.abs(band * self.step - 90), F.abs((band + 1) * self.step - 90))
        return F.greatest(F.floor(360 / self.step * F.cos(F.radians(F.least(edge, F.lit(90.0))))), F.lit(1)).cast("long")

    def bin(self, lon: Column, bins: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * bins), bins).cast("long")

    def around(self, lat: Column, lon: Column) -> Column:
        """All (band, bin) that may hold a point within the radius."""
        far = F.abs(lat) + math.degrees(self.radius) >= 90  # the circle holds a pole: every longitude
        reach = F.when(far, 180.0).otherwise(F.degrees(F.asin(F.least(math.sin(self.radius) / F.cos(F.radians(F.when(far, 0.0).otherwise(lat))), F.lit(1.0)))) * 1.0001)
        bands = F.sequence(F.greatest(self.band(lat - self.reach), F.lit(0)), F.greatest(self.band(lat + self.reach), F.lit(0)))

        def of(band: Column) -> Column:
            n = self.bins(band)
            low, high = F.floor((lon - reach + 180) / 360 * n), F.floor((lon + reach + 180) / 360 * n)
            return F.transform(F.sequence(low, F.least(high, low + n - 1)), lambda k: F.struct(band.alias("band"), F.pmod(k, n).cast("long").alias("bin")))

        return F.flatten(F.transform(bands, of))
