"""Hazard labels: JSON lines, validation rules, grading and matching to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.globe import EARTH_KM, Globe

DEFINITION_VERSION = "1"
#: Hazards and whether each is a proxy.
HAZARDS = {
    "lightning_30": False,
    "lightning_60": False,
    "ci_30": False,
    "ci_60": False,
    "hail": False,
    "gust": False,
    "cloudburst_point": False,
    "cloudburst_area_proxy": True,
}
EVIDENCE = "array<struct<evidence_id: string, kind: string, source: string, instrument_confirmed: boolean, observed_values: map<string, double>>>"
SCHEMA = (
    "event_id string, hazard string, definition_version string, grade string, obs_time timestamp, latitude double, longitude double, source string, "
    f"radius_km double, location_error_km double, time_error_min double, synthetic boolean, proxy boolean, evidence {EVIDENCE}"
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from JSON lines; blank lines are skipped, missing flags are false."""
    rows = spark.read.schema(SCHEMA).json(path)
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("synthetic", "proxy")}
    return rows.withColumns({**flags, "radius_km": F.coalesce("radius_km", F.lit(0.0)), "definition_version": F.coalesce("definition_version", F.lit(DEFINITION_VERSION))})


def write_labels(labels: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order."""
    labels.select(*sorted(labels.columns)).write.mode("errorifexists").json(path)


def hazard_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(HAZARDS.items()), "hazard string, is_proxy boolean"))


def violations(labels: DataFrame) -> DataFrame:
    """Adds violations (names of all rules broken) and research_only to labels."""
    rows = labels.join(hazard_table(labels.sparkSession), "hazard", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    confirmed = F.coalesce(F.exists("evidence", lambda e: F.coalesce(e["instrument_confirmed"], F.lit(False))), F.lit(False))
    b = F.col("grade") == "B"
    rules = {
        "event_id": blank("event_id"),
        "hazard": F.col("is_proxy").isNull(),
        "definition_version": ~F.col("definition_version").eqNullSafe(DEFINITION_VERSION),
        "grade": ~F.coalesce(F.col("grade").isin("A", "B", "C"), F.lit(False)),
        "obs_time": F.col("obs_time").isNull(),
        "coordinates": ~F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)),
        "source": blank("source"),
        "radius": F.coalesce(F.col("radius_km") < 0, F.lit(False)),
        "location_error": F.coalesce(F.col("location_error_km") < 0, F.lit(False)),
        "time_error": F.coalesce(F.col("time_error_min") < 0, F.lit(False)),
        "evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "grade_a_instrument": (F.col("grade") == "A") & ~confirmed,
        "grade_b_location": b & ~F.coalesce(F.col("location_error_km") <= 10, F.lit(False)),
        "grade_b_time": b & ~F.coalesce(F.col("time_error_min") <= 60, F.lit(False)),
        "proxy": F.coalesce(F.col("proxy") != F.col("is_proxy"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.withColumn("violations", found).withColumn("research_only", F.col("synthetic") | F.col("proxy") | (F.col("grade") == "C")).drop("is_proxy")


def add_labels(catalogue: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue with new labels; an id that exists or comes twice raises."""
    both = catalogue.unionByName(new)
    repeated = both.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate event_id: "), F.col("event_id"))).cast("boolean")).otherwise(F.lit(True))
    return both.join(repeated, "event_id").where(ok).drop("_n")


def grade_labels(catalogue: DataFrame, grades: DataFrame) -> DataFrame:
    """Catalogue after regrading (event_id, grade, location_error_km, time_error_min): both errors are overwritten, by null too."""
    g = grades.select("event_id", F.struct("grade", "location_error_km", "time_error_min").alias("_g"))
    rows = catalogue.join(g, "event_id", "left")
    fields = ("grade", "location_error_km", "time_error_min")
    return rows.withColumns({f: F.when(F.col("_g").isNotNull(), F.col(f"_g.{f}")).otherwise(F.col(f)) for f in fields}).drop("_g")


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def near_in_space_and_time(points: DataFrame, events: DataFrame, radius_km: float, window_min: float, before: bool = False) -> DataFrame:
    """(point_id, event_id, km, minutes) of events within the radius and the minutes after a point (and before, if asked).

    Events are dealt to the bins of the globe and of time that their circle and window touch, a point lies in one, so only
    what is near in both is compared. A null or NaN coordinate or a null time is near nothing.
    """
    globe, width = Globe(radius_km), max(1, round(window_min * 60e6))
    micros, back = F.unix_micros(F.col("at").cast("timestamp")), round(window_min * 60e6) if before else 0
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    sane = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & F.col("at").isNotNull()
    p = points.where(sane).select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("at").alias("p_at"), globe.band(lat).alias("_band"), F.floor(micros / width).alias("_time"))
    p = p.withColumn("_bin", globe.bin(F.col("p_lon"), globe.bins(F.col("_band"))))
    e = events.where(sane).select("event_id", "lat", "lon", "at", F.explode(globe.around(lat, lon)).alias("_cell"), micros.alias("_at"))
    e = e.withColumn("_time", F.explode(F.sequence(F.floor((F.col("_at") - round(window_min * 60e6)) / width), F.floor((F.col("_at") + back) / width))))
    e = e.select("event_id", "lat", "lon", "at", F.col("_cell.band").alias("_band"), F.col("_cell.bin").alias("_bin"), "_time")
    minutes = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("p_at").cast("timestamp"))) / F.lit(6e7)
    rows = p.join(e, ["_band", "_bin", "_time"]).select("point_id", "event_id", distance_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")).alias("km"), minutes.alias("minutes"))
    return rows.where((F.col("km") <= radius_km) & F.col("minutes").between(-window_min if before else 0, window_min))
