"""The verification job: split, pair and score in one plan, and write the record of the run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.functions.identity import run_id
from fogline.operators.metrics import CATEGORICAL, continuous_errors, verification_cube
from fogline.operators.pairing import pair_first_after


@dataclass(frozen=True)
class VerificationSpec:
    """What a run scores: exceedance thresholds, axes of the cube, the cut-off and the longest lead."""

    thresholds: Sequence[float]
    axes: Sequence[str] = ()
    keys: Sequence[str] = ()
    as_of: str | None = None
    max_lead_min: int = 120
    models: Sequence[str] = ("model",)
    versions: Mapping[str, int] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return {"thresholds": list(self.thresholds), "axes": list(self.axes), "keys": list(self.keys), "as_of": self.as_of, "max_lead_min": self.max_lead_min, "versions": dict(self.versions)}


def verify(forecasts: DataFrame, truths: DataFrame, spec: VerificationSpec, data_hash: str = "") -> DataFrame:
    """Scores in long form: run_id, metric, threshold, the axes (null: all values), value and n.

    ``forecasts`` may carry the axes as further columns; pairs are made once and every threshold reads the same pairs.
    """
    pairs = pair_first_after(forecasts, truths, spec.keys, spec.as_of, spec.max_lead_min)
    extra = [a for a in spec.axes if a not in pairs.columns]
    if extra:
        pairs = pairs.join(forecasts.select("forecast_id", *extra), "forecast_id")
    name = run_id(data_hash, spec.models, spec.as_dict())
    parts = []
    for t in spec.thresholds:
        cube = verification_cube(pairs, spec.axes, t) if spec.axes else _whole(pairs, t)
        long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in CATEGORICAL])).alias("m")
        parts.append(cube.select(*spec.axes, F.lit(float(t)).alias("threshold"), "n", long).select("m.metric", "threshold", *spec.axes, "m.value", "n"))
    errors = continuous_errors(pairs, list(spec.axes))
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "rmse", "mean_bias")])).alias("m")
    parts.append(errors.select(*spec.axes, "n", long).select("m.metric", F.lit(None).cast("double").alias("threshold"), *spec.axes, "m.value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(name).alias("run_id"), "*")


def _whole(pairs: DataFrame, threshold: float) -> DataFrame:
    from fogline.operators.metrics import categorical_scores, contingency

    return categorical_scores(contingency(pairs, threshold=threshold))
