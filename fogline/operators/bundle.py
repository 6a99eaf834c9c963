"""The feature bundle of a forecast: all contract channels on the grid, normalised, masked and aged, with rung, provenance and support."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.operators.features import FeatureContract, input_ladder, mahalanobis, model_tensor, normalize

#: Age in minutes of what is not there, and the greatest age that is told apart.
OLDEST = 120.0


@dataclass(frozen=True)
class FeatureBundle:
    """``header``: a row per frame (keys, names, rung, missing, provenance, and score and ood with a scorer); ``cells``: (keys, row,
    col, channel, pos, value, mask, valid, normal, age_min) of every contract channel and cell."""

    header: DataFrame
    cells: DataFrame
    contract: FeatureContract
    keys: tuple[str, ...]

    def tensor(self) -> DataFrame:
        """(keys, row, col, plane, value): normalised values, masks, then ages in hours up to 2."""
        return model_tensor(self.cells.select(*self.keys, "row", "col", "channel", "pos", "value", "mask", "valid", "normal", "age_min"), self.contract)


def feature_bundle(
    cells: DataFrame, frames: DataFrame, contract: FeatureContract, keys: Sequence[str], shape: tuple[int, int], mean: Sequence[float] | None = None, covariance=None, threshold: float = 3.0, channel_version: int | None = None
) -> FeatureBundle:
    """Bundle of quality-controlled cells (keys, channel, row, col, value, mask) and their frames (keys, channel, missing, age_min,
    coverage, manifest_ids). Channels are named ``group/name``; keys are not null.

    A frame has every channel of the contract, in its order: one that is not there, or is marked missing, has value 0, mask
    false and the oldest age in every cell, and is listed under ``missing``. A cell that a channel lacks is masked alike. A channel that
    the contract does not know, a cell off the grid, a cell that comes twice and another channel version raise. The rung says which
    groups of inputs are usable. With ``mean``, the score is the distance of the channels' mean normalised values from the training
    mean; ``ood`` is true beyond the threshold.
    """
    if channel_version is not None and channel_version != contract.channel_version:
        raise ValueError(f"version {channel_version} is not {contract.channel_version}")
    ny, nx = shape
    spark, keys = cells.sparkSession, tuple(keys)
    names = F.array(*[F.lit(n) for n in contract.names])

    def refuse(rows: DataFrame, bad, message) -> DataFrame:
        return rows.withColumn("channel", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(message).cast("string")).otherwise(F.col("channel")))

    strange = F.concat(F.lit("unexpected channel: "), F.coalesce("channel", F.lit("null")))
    frames = refuse(frames, ~F.col("channel").isin(*contract.names), strange)
    known = refuse(cells, ~F.col("channel").isin(*contract.names), strange)
    known = refuse(known, ~(F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1)), F.concat(F.lit(f"cell outside {ny} x {nx}: "), F.col("channel")))
    known = known.groupBy(*keys, "channel", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.max("value").alias("value"), F.bool_or("mask").alias("mask"), F.count(F.lit(1)).alias("_n"))
    known = refuse(known, F.col("_n") > 1, F.concat(F.lit("cell given twice: "), F.col("channel"))).drop("_n")

    grid = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    at_hand = frames.select(*keys, "channel", F.coalesce("missing", F.lit(False)).alias("_gone"), F.col("age_min").cast("double").alias("_age"))
    wanted = frames.select(*keys).distinct().withColumn("channel", F.explode(names))
    every = wanted.join(at_hand, [*keys, "channel"], "left").crossJoin(grid)  # the size of the bundle
    gone = F.coalesce("_gone", F.lit(True))
    rows = every.join(known, [*keys, "channel", "row", "col"], "left").select(
        *keys, "row", "col", "channel", F.when(gone, 0.0).otherwise(F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("value"), (~gone & F.coalesce("mask", F.lit(False))).alias("mask"),
        F.when(gone | F.col("_age").isNull(), OLDEST).otherwise(F.least(F.greatest("_age", F.lit(0.0)), F.lit(OLDEST))).alias("age_min"),
    )
    normal = normalize(rows, contract)

    absent = lambda c: F.coalesce(F.bool_and(F.when(F.col("channel") == c, F.coalesce("missing", F.lit(False)))), F.lit(True))
    listed = frames.groupBy(*keys).agg(
        F.array_compact(F.array(*[F.when(absent(c), F.lit(c)) for c in contract.names])).alias("missing"),
        F.array(*[F.struct(F.lit(c).alias("channel"), F.max(F.when(F.col("channel") == c, F.col("manifest_ids"))).alias("manifest_ids")) for c in contract.names]).alias("provenance"),
    )
    group = F.substring_index("channel", "/", 1)
    ladder = input_ladder(frames.withColumn("group", group).withColumn("missing", F.coalesce("missing", F.lit(False))), keys)
    header = listed.join(ladder, list(keys)).select(*keys, names.alias("names"), "rung", "missing", "provenance")
    if mean is not None:
        vector = F.array(*[F.avg(F.when(F.col("channel") == c, F.col("normal"))) for c in contract.names])
        scored = mahalanobis(normal.groupBy(*keys).agg(vector.alias("vector")), mean, covariance, threshold)
        header = header.join(scored.select(*keys, "score", "ood"), list(keys))
    return FeatureBundle(header, normal, contract, keys)
