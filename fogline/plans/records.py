"""Verification records: every score of a run on all its axes, with interval, baselines and figure id, and the row of the run.

Pairs are read once. A pair is spread over thresholds and over the forecast and its baselines as rows, summed by axes and event
block, and then rolled up: the sums are small, and thresholds, baselines, levels and replicates add rows to them, no plans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.identity import canonical_json, sha256_text
from fogline.functions.numeric import at_least, ratio
from fogline.operators import bootstrap
from fogline.operators.metrics import CATEGORICAL, COUNTS

#: Axes that may be totalled; a total is written "all".
TOTALLED = ("region", "season", "rung")
KEY = ("product", "lead_min", "threshold", *TOTALLED)
ALL = "all"
_ERRORS = ("error", "abs_error", "square_error")


@dataclass(frozen=True)
class RecordSpec:
    """Thresholds to score, baselines (name to the column of their forecast), and what identifies a run."""

    thresholds: Sequence[float]
    baselines: Mapping[str, str] = field(default_factory=dict)
    module: str = "M0"
    period: str = "all"
    frozen: bool = False
    data_manifest_hash: str = ""
    channel_version: int = 1
    definition_version: int = 1
    git_sha: str = ""
    seed: int = bootstrap.SEED
    model_versions: Sequence[str] = ()
    replicates: int = bootstrap.REPLICATES

    def body(self) -> dict:
        return {"thresholds": [float(t) for t in self.thresholds], "baselines": sorted(self.baselines), "module": self.module, "period": self.period, "replicates": self.replicates}

    def run_id(self) -> str:
        """The same for the same data, versions, code, seed, models (in any order) and spec."""
        return "vr-" + sha256_text(canonical_json({
            "channel_version": self.channel_version, "data_manifest_hash": self.data_manifest_hash, "definition_version": self.definition_version,
            "git_sha": self.git_sha, "model_versions": sorted(self.model_versions), "seed": self.seed, "spec": self.body(),
        }))[:16]


def run_row(spark: SparkSession, spec: RecordSpec) -> DataFrame:
    """The row of a run. Only a frozen run can be cited."""
    row = (spec.run_id(), spec.frozen, spec.frozen, spec.data_manifest_hash, spec.channel_version, spec.definition_version, spec.git_sha, spec.seed, sorted(spec.model_versions), sha256_text(canonical_json(spec.body())))
    names = "run_id string, frozen boolean, citable boolean, data_manifest_hash string, channel_version int, definition_version int, git_sha string, seed long, model_versions array<string>, spec_hash string"
    return spark.createDataFrame([row], names)


def _sums(pairs: DataFrame, spec: RecordSpec) -> DataFrame:
    """Sums by key, forecaster and block; without a threshold (null) a row has only errors, with one only counts."""
    forecasters = F.array(F.struct(F.lit("").alias("name"), F.col("forecast").cast("double").alias("value")), *[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in spec.baselines.items()])
    levels = F.array(F.lit(None).cast("double"), *[F.lit(float(t)) for t in spec.thresholds])
    axes = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in TOTALLED]
    rows = pairs.select(F.col("product").cast("string").alias("product"), F.col("lead_min").cast("int").alias("lead_min"), *axes, "block", F.col("observed").cast("double").alias("o"), F.explode(forecasters).alias("f"))
    rows = rows.select("product", "lead_min", *TOTALLED, "block", "o", F.col("f.name").alias("forecaster"), F.col("f.value").alias("f"), F.explode(levels).alias("threshold"))
    said, seen = at_least(F.col("f"), F.col("threshold")), at_least(F.col("o"), F.col("threshold"))
    cell = F.col("threshold").isNotNull()
    counts = {"hits": said & seen, "misses": ~said & seen, "false_alarms": said & ~seen, "correct_negatives": ~said & ~seen}
    e = F.when(~cell, F.col("f") - F.col("o"))
    errors = {"error": e, "abs_error": F.abs(e), "square_error": e * e}
    return rows.groupBy(*KEY, "forecaster", "block").agg(
        *[F.count_if(cell & c).alias(name) for name, c in counts.items()], *[F.coalesce(F.sum(v), F.lit(0.0)).alias(name) for name, v in errors.items()], F.count(F.lit(1)).alias("n")
    )


def records(pairs: DataFrame, spec: RecordSpec) -> DataFrame:
    """One row per metric, threshold and combination of axes: run_id, frozen, product, lead_min, threshold (text, "none" for error
    scores), scale_km (null: scores at points), region, season, rung, metric, value, n, baseline (map), figure_id, ci95.

    ``pairs`` has product, lead_min, region, season, rung, block, forecast, observed and the columns of the baselines. Region,
    season and rung are also totalled, as "all" (not a value of their own); a null there is "unknown". Product and lead stay apart: a null lead or a pair
    without forecast or observation counts as its comparison says (never at least a threshold) and makes error scores null, which
    are left out. A score that is undefined for the sample has no record, as a record's value must be finite. ci95 (low, high)
    comes from replicates over blocks; it is null where all of them are undefined.
    """
    values = (*COUNTS, *_ERRORS, "n")
    base = _sums(pairs, spec)
    by = [*KEY, "forecaster"]
    drawn = bootstrap.replicate_sums(base, by, "block", values, spec.replicates, spec.seed)
    for c in TOTALLED:  # sums of replicates add up as those of the sample do; blocks are no longer needed
        drawn = drawn.withColumn(c, F.explode(F.array(F.lit(ALL), F.col(c))))
    drawn = drawn.groupBy(*by, "replicate").agg(*[F.sum(v).alias(v) for v in values])
    error = {"mae": "abs_error", "mean_bias": "error"}
    undefined = F.lit(float("nan"))
    point = F.col("threshold").isNull()
    scores = {m: F.when(point, undefined).otherwise(score()) for m, score in CATEGORICAL.items()}
    scores |= {m: F.when(point, ratio(F.col(c), F.col("n"))).otherwise(undefined) for m, c in error.items()}
    scores["rmse"] = F.when(point, F.sqrt(ratio(F.col("square_error"), F.col("n")))).otherwise(undefined)
    found = bootstrap.intervals(drawn, by, scores).where(~F.isnan("value"))
    sizes = drawn.where("replicate = 0").select(*[F.col(c).alias(f"_{c}") for c in by], "n")
    found = found.join(sizes, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).select(*by, "metric", "value", "low", "high", "n")
    own = F.col("forecaster") == ""
    rows = found.groupBy(*KEY, "metric").agg(
        F.max(F.when(own, F.struct("value", "n", "low", "high"))).alias("own"), F.map_from_entries(F.array_sort(F.collect_list(F.when(~own, F.struct("forecaster", "value"))))).alias("baseline")
    )
    shown = F.coalesce(F.regexp_replace(F.col("threshold").cast("string"), r"\.0$", ""), F.lit("none"))
    figure = F.concat_ws("-", F.lit("F"), F.lit(spec.module), F.upper("metric"), shown, F.col("region"), F.lit(spec.period))
    return rows.where("own is not null").select(
        F.lit(spec.run_id()).alias("run_id"), F.lit(spec.frozen).alias("frozen"), "product", "lead_min", shown.alias("threshold"), F.lit(None).cast("double").alias("scale_km"), *TOTALLED, "metric",
        "own.value", "own.n", "baseline", figure.alias("figure_id"), F.when(F.col("own.low").isNotNull(), F.array("own.low", "own.high")).alias("ci95"),
    )
