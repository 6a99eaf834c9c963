"""Labels computed from observations: flashes, reports and gusts near a point, convective initiation of tracks, cloudbursts.

The hazard definitions name these rules; what counts as near is a parameter with the definition's value as default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogline.functions.numeric import at_least
from fogline.functions.tables import cut
from fogline.functions.globe import Globe as _Globe
from fogline.sources.labels import distance_km

#: Fixed values of the hazard definitions: kilometres and minutes.
LIGHTNING_KM, HAIL_KM, HAIL_MIN, GUST_KM, GUST_MIN = 8.0, 25.0, 45.0, 25.0, 30.0
GUST_MS, ECHO_DBZ, CLOUDBURST_MM, AREA_CELLS = 17.0, 35.0, 100.0, 5


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def has_match(points: DataFrame, events: DataFrame, radius_km: float, after_min: float, before_min: float = 0.0, point_id: str = "point_id") -> DataFrame:
    """``points`` with ``positive``: whether any event lies within the radius, from ``before_min`` before to ``after_min`` after.

    ``points`` has point_id (unique), lat, lon and at; ``events`` lat, lon and at. Both limits are inclusive. A point or event with
    a null or NaN coordinate or a null time matches nothing. Events at one place and time count once, and are dealt to the bins that
    their circle and window touch: bins follow the latitude, wrap at the date line, and a circle around a pole takes the few bins
    there. A point lies in one bin. The meeting is an existence test: it ends at a point's first hit, and no pair is written.
    """
    globe, width = _Globe(radius_km), max(1, round((after_min + before_min) * 60e6))
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    sane = known("lat") & known("lon") & F.col("at").isNotNull()
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    at, before, after = _micros("at"), round(before_min * 60e6), round(after_min * 60e6)
    p = points.where(sane).select(F.col(point_id).alias("_id"), lat.alias("_lat"), lon.alias("_lon"), at.alias("_at"), globe.band(lat).alias("_band"), F.floor(at / width).alias("_time"))
    p = p.withColumn("_bin", globe.bin(F.col("_lon"), globe.bins(F.col("_band"))))
    e = events.where(sane).select(lat.alias("lat"), lon.alias("lon"), at.alias("at")).distinct().withColumn("cell", F.explode(globe.around(F.col("lat"), F.col("lon"))))
    e = e.withColumn("time", F.explode(F.sequence(F.floor((F.col("at") - after) / width), F.floor((F.col("at") + before) / width))))
    e = e.select("lat", "lon", "at", F.col("cell.band").alias("band"), F.col("cell.bin").alias("bin"), "time")
    near = (F.col("at").between(F.col("_at") - before, F.col("_at") + after)) & (distance_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= radius_km)
    hits = p.join(e, (F.col("_band") == F.col("band")) & (F.col("_bin") == F.col("bin")) & (F.col("_time") == F.col("time")) & near, "left_semi").select("_id").distinct()
    hits = hits.withColumn("_hit", F.lit(True))
    return points.join(hits, F.col(point_id) == F.col("_id"), "left").select(*points.columns, F.coalesce("_hit", F.lit(False)).alias("positive"))


def lightning_labels(points: DataFrame, flashes: DataFrame, minutes: float) -> DataFrame:
    """Whether at least one flash falls within 8 km in the next minutes."""
    return has_match(points, flashes, LIGHTNING_KM, minutes)


def hail_labels(points: DataFrame, reports: DataFrame) -> DataFrame:
    """Whether a report of grade A or B lies within 25 km and 45 minutes of an object."""
    return has_match(points, reports.where(F.col("grade").isin("A", "B")), HAIL_KM, HAIL_MIN, HAIL_MIN)


def gust_labels(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Whether a gust of at least 17 m/s (column gust) or a squall report (column squall) lies within 25 km and 30 minutes."""
    return has_match(points, stations.where(at_least(F.col("gust"), GUST_MS) | F.coalesce(F.col("squall"), F.lit(False))), GUST_KM, GUST_MIN, GUST_MIN)


def initiations(echoes: DataFrame, edges: DataFrame, flashes: DataFrame | None = None, threshold: float = ECHO_DBZ) -> DataFrame:
    """(track_id, started, initiated, inherited): when a tracked object first had an echo of the threshold or a flash.

    ``echoes`` has track_id, at and peak; ``flashes`` track_id and at; ``edges`` parent and child. A track that comes out of others,
    by a split or a merger, has initiated when the first of them had, if that was before it started: what a parent does after
    it left is the parent's own. ``initiated`` is null where nothing qualifies. Times go down the lineage one generation a round,
    until none changes; loops and unknown tracks in the edges do no harm.
    """
    first = echoes.groupBy("track_id").agg(F.min("at").alias("started"), F.min(F.when(at_least(F.col("peak"), threshold), F.col("at"))).alias("own"))
    if flashes is not None:
        struck = flashes.groupBy(F.col("track_id").alias("_id")).agg(F.min("at").alias("struck"))
        first = first.join(struck, F.col("track_id") == F.col("_id"), "left").select("track_id", "started", F.least("own", "struck").alias("own"))
    first = first.withColumn("initiated", F.col("own"))
    links = cut(edges.select("parent", "child").where("parent <> child").distinct())
    state = cut(first)
    changed = state.where("initiated is not null")
    while True:
        handed = links.join(changed.select(F.col("track_id").alias("parent"), F.col("initiated").alias("handed")), "parent").groupBy("child").agg(F.min_by("handed", "handed").alias("handed"))
        better = F.coalesce((F.col("handed") <= F.col("started")) & (F.col("initiated").isNull() | (F.col("handed") < F.col("initiated"))), F.lit(False))
        moved = state.join(handed, F.col("track_id") == F.col("child"), "left").select("track_id", "started", "own", F.when(better, F.col("handed")).otherwise(F.col("initiated")).alias("initiated"), better.alias("moved"))
        moved = cut(moved)
        state, changed = moved.drop("moved"), moved.where("moved")
        if changed.isEmpty():
            return state.select("track_id", "started", "initiated", F.coalesce(~F.col("initiated").eqNullSafe(F.col("own")), F.lit(False)).alias("inherited"))


def initiation_labels(issues: DataFrame, initiated: DataFrame, minutes: float) -> DataFrame:
    """``issues`` (track_id, at, ...) with positive, already and lead_min: initiation in the next minutes, or before the issue.

    A track that is unknown or never initiates is neither; lead_min is null unless positive.
    """
    rows = issues.join(initiated.select(F.col("track_id").alias("_id"), F.col("initiated").alias("_when")), F.col("track_id") == F.col("_id"), "left")
    gap = (_micros("_when") - _micros("at")) / F.lit(60e6)
    positive = F.coalesce((gap > 0) & (gap <= minutes), F.lit(False))
    return rows.select(*issues.columns, positive.alias("positive"), F.coalesce(gap <= 0, F.lit(False)).alias("already"), F.when(positive, gap).alias("lead_min"))


def hourly_sums(gauges: DataFrame, hours: int = 6) -> DataFrame:
    """``gauges`` (station, at, mm) with ``hour_mm``: what fell at the station in the hour that ends with the row, its start left out.

    Rows of one time count together. Null, NaN and negative amounts count as none. A station's rows are cut into blocks of hours, and
    the last hour of a block is also put into the next, so a station with very many rows is spread over tasks.
    """
    hour, width = 3_600_000_000, hours * 3_600_000_000
    amount = F.when(at_least(F.col("mm"), 0.0), F.col("mm").cast("double")).otherwise(F.lit(0.0))
    rows = gauges.withColumn("_at", _micros("at")).withColumn("_mm", amount).where("_at is not null")
    own = F.floor(F.col("_at") / width)
    rows = rows.withColumn("_own", own).withColumn("_block", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_at") + hour) / width)))))
    back = Window.partitionBy("station", "_block").orderBy("_at").rangeBetween(1 - hour, 0)
    return rows.withColumn("hour_mm", F.sum("_mm").over(back)).where("_own = _block").drop("_at", "_mm", "_own", "_block")


def cloudburst_points(gauges: DataFrame, limit: float = CLOUDBURST_MM) -> DataFrame:
    """Gauge rows at which the hour reaches the limit."""
    return hourly_sums(gauges).where(F.col("hour_mm") >= limit)
