"""Feature contracts: order, normalisation, masks, support checks and the input ladder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.functions.numeric import finite


@dataclass(frozen=True)
class FeatureContract:
    """Channels in tensor order with their statistics and bounds, and the versions they belong to."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    mins: tuple[float, ...]
    maxs: tuple[float, ...]
    channel_version: int = 1
    grid_version: int = 1
    versions: dict = field(default_factory=dict)

    def faults(self) -> list[str]:
        """Names of all rules that the contract breaks."""
        columns = {"means": self.means, "stds": self.stds, "mins": self.mins, "maxs": self.maxs}
        rules = {
            "no channel": not self.names,
            "repeated channel": len({*self.names}) < len(self.names),
            **{f"{name}: one number per channel": len(x) != len(self.names) for name, x in columns.items()},
            **{f"{name}: not finite": not np.isfinite(x).all() for name, x in columns.items()},
            "stds: not positive": min(self.stds, default=1.0) <= 0,
            "bounds: lower above upper": any(low > high for low, high in zip(self.mins, self.maxs, strict=False)),
        }
        return [name for name, broken in rules.items() if broken]

    def __post_init__(self) -> None:
        if found := self.faults():
            raise ValueError("; ".join(found))

    def order_of(self, live: Sequence[str], channel_version: int | None = None) -> list[int]:
        """Place of every contract channel among the live ones; raises with all differences between the two."""
        place = {name: i for i, name in enumerate(live)}
        rules = {
            "repeated": len(place) < len(live),
            f"missing {sorted({*self.names} - {*place})}": not {*self.names} <= {*place},
            f"unexpected {sorted({*place} - {*self.names})}": not {*place} <= {*self.names},
            f"version {channel_version} is not {self.channel_version}": channel_version not in (None, self.channel_version),
        }
        if found := [name for name, broken in rules.items() if broken]:
            raise ValueError("live channels: " + "; ".join(found))
        return [place[n] for n in self.names]

    def table(self, spark) -> DataFrame:
        rows = [(n, i, *map(float, s)) for i, (n, *s) in enumerate(zip(self.names, self.means, self.stds, self.mins, self.maxs, strict=True))]
        return F.broadcast(spark.createDataFrame(rows, "channel string, pos int, mean double, std double, low double, high double"))


def normalize(cells: DataFrame, contract: FeatureContract) -> DataFrame:
    """Adds pos, valid and normal: (value - mean) / deviation inside bounds and mask, 0 elsewhere."""
    joined = cells.join(contract.table(cells.sparkSession), "channel")
    v = F.col("value").cast("double")
    ok = finite(v) & (v >= F.col("low")) & (v <= F.col("high")) & F.coalesce(F.col("mask").cast("boolean"), F.lit(False))
    return joined.withColumn("valid", ok).withColumn("normal", F.when(ok, (v - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))).drop("mean", "std", "low", "high")


def missing_channels(channels: DataFrame, contract: FeatureContract, keys: Sequence[str]) -> DataFrame:
    """(keys, channel) of contract channels that a frame lacks."""
    frames = channels.select(*keys).distinct()
    wanted = frames.crossJoin(contract.table(channels.sparkSession).select("channel"))  # frames x contract
    return wanted.join(channels.select(*keys, "channel").distinct(), [*keys, "channel"], "left_anti")


def unexpected_channels(channels: DataFrame, contract: FeatureContract, keys: Sequence[str]) -> DataFrame:
    """(keys, channel) of channels that the contract does not know."""
    return channels.select(*keys, "channel").distinct().where(~F.col("channel").isin(*contract.names))


def model_tensor(cells: DataFrame, contract: FeatureContract) -> DataFrame:
    """Long tensor (row, col, plane, value): normalised values, masks, then ages in hours up to 2."""
    n = len(contract.names)
    planes = F.explode(F.array(
        F.struct(F.col("pos").alias("plane"), F.col("normal").alias("x")),
        F.struct((F.col("pos") + n).alias("plane"), F.col("valid").cast("double").alias("x")),
        F.struct((F.col("pos") + 2 * n).alias("plane"), F.least(F.col("age_min") / 60.0, F.lit(2.0)).alias("x")),
    ))
    keys = [c for c in cells.columns if c not in ("channel", "pos", "value", "mask", "valid", "normal", "age_min")]
    return cells.select(*keys, planes.alias("p")).select(*keys, "p.plane", F.col("p.x").alias("value"))


def channel_means(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, "channel").agg(F.avg("value").alias("value"))


RIDGE = 1e-6


def mahalanobis(vectors: DataFrame, mean: Sequence[float], covariance=None, threshold: float = 3.0, vector: str = "vector") -> DataFrame:
    """Adds score and ood: distance of an array column from the training mean, out of support beyond the threshold.

    The covariance may be absent (identity), a list of variances, or a matrix, which is inverted on the driver.
    """
    d = F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    rows = vectors.withColumn("_d", d)
    add = lambda a, x: a + x
    c = None if covariance is None else np.asarray(covariance, dtype=float)
    if c is None or c.ndim == 1:
        if c is not None and (c <= 0).any():
            raise ValueError("variances must be positive")
        weights = [1.0] * len(mean) if c is None else [1.0 / (x + RIDGE) for x in c]
        score = F.sqrt(F.aggregate(F.zip_with("_d", F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * x * w), F.lit(0.0), add))
    else:
        inverse = np.linalg.pinv(c + RIDGE * np.eye(len(c)))
        matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in inverse])
        times = F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, F.col("_d"), lambda p, x: p * x), F.lit(0.0), add))
        score = F.sqrt(F.aggregate(F.zip_with("_d", times, lambda x, y: x * y), F.lit(0.0), add))
    bad = F.exists("_d", lambda x: ~finite(x))
    checked = F.when(bad, F.raise_error(F.lit("feature vector is not finite")).cast("double")).otherwise(score)
    return rows.withColumn("score", checked).withColumn("ood", F.col("score") > threshold).drop("_d")


#: Greatest age in minutes and least coverage by input group.
GROUP_RULES = {"sat": (45.0, 0.70), "radar": (20.0, 0.30), "ltg": (10.0, 0.01), "nwp": (float("inf"), 0.01)}


def input_ladder(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rung R0 to R4 from frame summaries (keys, group, missing, age_min, coverage): a group counts if any channel does."""
    rules = [F.bool_or((F.col("group") == g) & ~F.col("missing") & F.col("age_min").isNotNull() & (F.col("age_min") <= age) & (F.col("coverage") >= cover)).alias(g) for g, (age, cover) in GROUP_RULES.items()]
    valid = frames.groupBy(*keys).agg(*rules)
    sat, radar, ltg, nwp = (F.coalesce(F.col(g), F.lit(False)) for g in ("sat", "radar", "ltg", "nwp"))
    rung = F.when(radar & sat & ltg & nwp, "R0").when(sat & ltg & nwp, "R1").when(sat & nwp, "R2").when(nwp, "R3").otherwise("R4")
    return valid.select(*keys, rung.alias("rung"))
