"""Lambert conformal conic projection on the WGS84 ellipsoid, as column arithmetic."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84.
SEMI_MAJOR, INVERSE_FLATTENING = 6378137.0, 298.257223563
_FLATTENING = 1 / INVERSE_FLATTENING
ECCENTRICITY = math.sqrt(_FLATTENING * (2 - _FLATTENING))


@dataclass(frozen=True)
class Domain:
    """A grid: size, spacing and north-west corner, in metres of a conic projection or in degrees."""

    name: str
    version: int
    crs: str
    nx: int
    ny: int
    spacing: float
    west: float
    north: float
    cycle_s: int
    sat_cadence_s: int

    def __post_init__(self) -> None:
        if min(self.version, self.nx, self.ny, self.cycle_s, self.sat_cadence_s) <= 0 or self.spacing <= 0:
            raise ValueError(f"domain {self.name}: sizes, spacing and periods must be positive")

    @property
    def conic(self) -> dict[str, float] | None:
        """Parameters of the conic projection, or None for degrees."""
        found = dict(re.findall(r"\+(lat_0|lon_0|lat_1|lat_2)=(-?[\d.]+)", self.crs))
        return {k: float(v) for k, v in found.items()} if "proj=lcc" in self.crs else None


#: The analysis domains.
DOMAINS = {
    d.name: d
    for d in (
        Domain("pilot_e", 1, "+proj=lcc +lat_0=23 +lon_0=87 +lat_1=21 +lat_2=25 +datum=WGS84 +units=m +no_defs", 500, 450, 2000.0, -500000.0, 450000.0, 600, 900),
        Domain("pilot_h", 1, "+proj=lcc +lat_0=31.25 +lon_0=78 +lat_1=30 +lat_2=32.5 +datum=WGS84 +units=m +no_defs", 300, 250, 2000.0, -300000.0, 250000.0, 600, 900),
        Domain("national_s", 1, "EPSG:4326", 800, 800, 0.04, 66.0, 38.0, 900, 1800),
    )
}


def _isometric(phi: float) -> float:
    s = ECCENTRICITY * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) * ((1 + s) / (1 - s)) ** (ECCENTRICITY / 2)


def _parallel_radius(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (ECCENTRICITY * math.sin(phi)) ** 2)


def conic_constants(lat_0: float, lat_1: float, lat_2: float) -> tuple[float, float, float]:
    """Cone constant, scale, and radius of the origin's parallel."""
    p0, p1, p2 = map(math.radians, (lat_0, lat_1, lat_2))
    if math.isclose(lat_1, lat_2, abs_tol=1e-12):
        cone = math.sin(p1)
    else:
        cone = (math.log(_parallel_radius(p1)) - math.log(_parallel_radius(p2))) / (math.log(_isometric(p1)) - math.log(_isometric(p2)))
    scale = _parallel_radius(p1) / (cone * _isometric(p1) ** cone)
    return cone, scale, SEMI_MAJOR * scale * _isometric(p0) ** cone


def project(domain: Domain, lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in the domain's own coordinates."""
    conic = domain.conic
    if conic is None:
        return lon.cast("double"), lat.cast("double")
    cone, scale, rho0 = conic_constants(conic["lat_0"], conic["lat_1"], conic["lat_2"])
    phi = F.radians(lat)
    s = F.lit(ECCENTRICITY) * F.sin(phi)
    isometric = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(ECCENTRICITY / 2))
    rho = F.lit(SEMI_MAJOR * scale) * F.pow(isometric, F.lit(cone))
    theta = F.lit(cone) * (F.radians(lon) - F.lit(math.radians(conic["lon_0"])))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def grid_index(domain: Domain, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Fractional row and column of a point."""
    x, y = project(domain, lat, lon)
    return (y - F.lit(domain.north)) / F.lit(-domain.spacing), (x - F.lit(domain.west)) / F.lit(domain.spacing)


def centres(spark, domain: Domain) -> DataFrame:
    """(row, col, x, y) of all cell centres."""
    row, col = (F.col("id") / domain.nx).cast("int"), (F.col("id") % domain.nx).cast("int")
    return spark.range(domain.nx * domain.ny).select(
        row.alias("row"), col.alias("col"), (F.lit(domain.west) + (col + 0.5) * domain.spacing).alias("x"), (F.lit(domain.north) - (row + 0.5) * domain.spacing).alias("y")
    )
