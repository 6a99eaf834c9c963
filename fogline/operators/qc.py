"""Quality control of observed fields, cell by cell and frame by frame.

Frames are rows (frame keys, channel, row, col, value, mask). Values and bounds are compared as 32-bit floats. Flags of a
frame are a sorted set of texts. Invalid cells hold the channel's fill value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.numeric import between_f32, clamp, finite

#: Physical ranges by channel.
SATELLITE_RANGES = {
    "ir1": (150.0, 400.0),
    "ir2": (150.0, 400.0),
    "wv": (150.0, 400.0),
    "mir": (150.0, 400.0),
    "vis": (0.0, 1.5),
    "swir": (0.0, 1.5),
    "d_ir1_dt": (-100.0, 100.0),
    "ir1_minus_ir2": (-100.0, 100.0),
    "wv_minus_ir1": (-200.0, 200.0),
    "ot_score": (0.0, 1.0),
}
RADAR_RANGES = {
    "zmax": (-32.0, 80.0),
    "z_cappi1": (-32.0, 80.0),
    "z_cappi2": (-32.0, 80.0),
    "z_m10c": (-32.0, 80.0),
    "z_m20c": (-32.0, 80.0),
    "vil": (0.0, 500.0),
    "vil_density": (0.0, 50.0),
    "mesh": (0.0, 150.0),
    "sri": (0.0, 500.0),
    "div_lowlvl": (-0.1, 0.1),
    "marc": (-100.0, 100.0),
    "vr_lowest": (-100.0, 100.0),
}
VELOCITY_CHANNELS = ("div_lowlvl", "marc", "vr_lowest")
NWP_RANGES = {
    "cape": (0.0, 20000.0),
    "cin": (-20000.0, 2000.0),
    "lcl": (0.0, 20000.0),
    "shear01": (0.0, 150.0),
    "shear06": (0.0, 150.0),
    "pwat": (0.0, 150.0),
    "frz_lvl": (0.0, 20000.0),
    "h_m10c": (0.0, 20000.0),
    "h_m20c": (0.0, 20000.0),
    "dcape_proxy": (0.0, 100.0),
    "mfc850": (-1000.0, 1000.0),
    "conv10m": (-1000.0, 1000.0),
    "precip_rate": (0.0, 2000.0),
}
#: Fixed value: what invalid cells hold.
FILL = 0.0


def age_minutes(obs: Column, issue: Column) -> Column:
    """Minutes from observation to issue, at least 0; null if either is missing."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.when(obs.isNotNull() & issue.isNotNull(), F.greatest(F.lit(0.0), (us(issue) - us(obs)) / F.lit(6e7)))


def available(arrival: Column, issue: Column) -> Column:
    """Whether the data had arrived at issue time; false where either is missing."""
    return F.coalesce(arrival <= issue, F.lit(False))


def freshness(obs: Column, arrival: Column, max_age_s: Column | int) -> Column:
    """'future' for observations over five minutes ahead of their arrival, 'stale' for those too old, else null."""
    limit = max_age_s if isinstance(max_age_s, Column) else F.lit(max_age_s)
    lag = (F.unix_micros(arrival.cast("timestamp")) - F.unix_micros(obs.cast("timestamp"))) / F.lit(1e6)
    return F.when(lag < -300, "future").when(lag > limit, "stale")


def observation_problem(payload_bytes: Column, issue: Column, valid: Column, arrival: Column, forecast: Column) -> Column:
    """First rule that an observation breaks, or null."""
    return (
        F.when(F.coalesce(payload_bytes, F.lit(0)) <= 0, "empty_payload")
        .when(issue.isNotNull() & valid.isNotNull() & (issue > valid), "issue_after_valid")
        .when(~F.coalesce(forecast, F.lit(False)) & issue.isNotNull() & (arrival < issue), "arrival_before_issue")
    )


def bounded(cells: DataFrame, low: Column | float, high: Column | float, fill: float = FILL, value: str = "value", mask: str = "mask") -> DataFrame:
    """Adds valid, rejected (finite but out of range), non_finite and the value with invalid cells filled."""
    v, ok = F.col(value), F.coalesce(F.col(mask).cast("boolean"), F.lit(False))
    real, inside = finite(v), between_f32(v, low, high)
    out = cells.withColumn("valid", real & inside & ok).withColumn("rejected", real & ~inside).withColumn("non_finite", ~real)
    return out.withColumn("value_qc", F.when(F.col("valid"), v.cast("float")).otherwise(F.lit(fill).cast("float")))


def frame_summary(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame: coverage, whether it is missing altogether, and its flags."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(F.bool_or("rejected"), "physical_range_rejected"),
            flag(F.bool_or("non_finite"), "non_finite_rejected"),
            flag(~F.bool_or("valid"), "no_valid_pixels"),
        )
    )
    return checked.groupBy(*keys).agg(F.avg(F.col("valid").cast("double")).alias("coverage"), (~F.bool_or("valid")).alias("missing"), F.array_sort(flags).alias("flags"))


def range_table(spark, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(channel, low, high): a dimension of at most a few dozen rows."""
    return F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in ranges.items()], "channel string, low double, high double"))


def _ranged(cells: DataFrame, ranges: dict[str, tuple[float, float]], fill: float) -> DataFrame:
    """Bounds by channel; an unknown channel raises."""
    known = cells.join(range_table(cells.sparkSession, ranges), "channel", "left")
    low = F.when(F.col("low").isNull(), F.raise_error(F.concat(F.lit("unknown channel: "), F.col("channel"))).cast("double")).otherwise(F.col("low"))
    return bounded(known, low, F.col("high"), fill).drop("low", "high")


def _with_flag(summary: DataFrame, cond: Column, name: str) -> DataFrame:
    return summary.withColumn("flags", F.when(cond, F.array_sort(F.array_distinct(F.concat("flags", F.array(F.lit(name)))))).otherwise(F.col("flags")))


def satellite(cells: DataFrame, keys: Sequence[str], calibrated: bool = False, fill: float = FILL) -> tuple[DataFrame, DataFrame]:
    """Checked cells and frame summaries; uncalibrated data are flagged and not masked."""
    checked = _ranged(cells, SATELLITE_RANGES, fill)
    return checked, _with_flag(frame_summary(checked, [*keys, "channel"]), F.lit(not calibrated), "uncalibrated")


def radar(cells: DataFrame, keys: Sequence[str], has_velocity: bool, fill: float = FILL) -> tuple[DataFrame, DataFrame]:
    """Blocked cells (column ``blocked``) are masked; velocity channels without velocity are masked throughout."""
    blocked = F.coalesce(F.col("blocked").cast("boolean"), F.lit(False)) if "blocked" in cells.columns else F.lit(False)
    blind = F.col("channel").isin(*VELOCITY_CHANNELS) & F.lit(not has_velocity)
    masked = cells.withColumn("_blocked", blocked).withColumn("mask", F.coalesce(F.col("mask").cast("boolean"), F.lit(False)) & ~blocked & ~blind)
    checked = _ranged(masked, RADAR_RANGES, fill)
    summary = frame_summary(checked, [*keys, "channel"])
    seen = checked.groupBy(*keys, "channel").agg(F.bool_or("_blocked").alias("_any_blocked"))
    summary = summary.join(seen, [*keys, "channel"])
    summary = _with_flag(summary, F.col("_any_blocked"), "blocked_pixels").drop("_any_blocked")
    return checked.drop("_blocked"), _with_flag(summary, blind, "no_velocity")


def lightning(cells: DataFrame, keys: Sequence[str], access_verified: bool, health: float, high: float = 1e9, fill: float = FILL) -> tuple[DataFrame, DataFrame]:
    """Without verified access everything is missing; bad health is a flag and a reason but masks nothing."""
    source = cells if access_verified else cells.withColumn("mask", F.lit(False))
    checked = bounded(source, 0.0, high, fill)
    summary = frame_summary(checked, [*keys, "channel"]).withColumn("missing_reason", F.lit("ltg_unavailable" if not access_verified else "ltg_bad_health" if health <= 0 else None).cast("string"))
    if not access_verified:
        return checked, summary.withColumn("flags", F.array(F.lit("ltg_unavailable")))
    return checked, _with_flag(summary, F.lit(health <= 0), "ltg_bad_health")


def lightning_row_problem(lat: Column, lon: Column, kind: Column, at: Column) -> Column:
    """First rule that a flash breaks, or null."""
    return (
        F.when(lat.isNull() | lon.isNull() | kind.isNull() | at.isNull(), "missing_field")
        .when(~lat.between(-90, 90) | ~lon.between(-180, 180) | F.isnan(lat) | F.isnan(lon), "outside_wgs84")
        .when(~kind.isin("CG", "IC"), "unknown_type")
    )


def nwp(cells: DataFrame, keys: Sequence[str], cycle: Column, arrival: Column, issue: Column, fill: float = FILL) -> tuple[DataFrame, DataFrame]:
    """Model fields count only with a known cycle and if they had arrived at issue time."""
    reason = F.when(cycle.isNull(), "nwp_cycle_unknown").when(~available(arrival, issue), "nwp_not_arrived")
    tagged = cells.withColumn("_reason", reason).withColumn("mask", F.coalesce(F.col("mask").cast("boolean"), F.lit(False)) & reason.isNull())
    checked = _ranged(tagged, NWP_RANGES, fill)
    summary = frame_summary(checked, [*keys, "channel"])
    why = checked.groupBy(*keys, "channel").agg(F.min("_reason").alias("missing_reason"))
    summary = summary.join(why, [*keys, "channel"])
    return checked.drop("_reason"), summary.withColumn("flags", F.when(F.col("missing_reason").isNotNull(), F.array("missing_reason")).otherwise(F.col("flags")))


def missing_frame(spark, ny: int, nx: int, reason: str, fill: float = FILL) -> DataFrame:
    """All cells of a frame that never came: filled, invalid, and without an age."""
    return spark.range(ny * nx).select(
        (F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"), F.lit(fill).cast("float").alias("value_qc"), F.lit(False).alias("valid"),
        F.lit(None).cast("double").alias("age_min"), F.array(F.lit(reason)).alias("flags"), F.lit(reason).alias("missing_reason"),
    )


def mask_bundle(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per channel the age in [0, 120] (120 if unknown), whether it is missing and why, and distinct manifest ids in order."""
    age = F.coalesce(clamp(F.col("age_min").cast("double"), 0.0, 120.0), F.lit(120.0))
    return frames.select(*keys, "channel", age.alias("age_min"), "missing", "missing_reason", F.array_distinct(F.coalesce("manifest_ids", F.array().cast("array<string>"))).alias("manifest_ids"))
