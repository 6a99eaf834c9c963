"""Verification scores as Spark aggregates.

Every function takes a DataFrame and grouping columns and returns one row per group, so one plan scores all axes of a run.
Undefined ratios are NaN. An empty input gives no group; ``require_rows`` is the check for callers that need one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogline.functions.numeric import at_least, ratio

COUNTS = ("hits", "misses", "false_alarms", "correct_negatives")


def require_rows(df: DataFrame) -> DataFrame:
    """The frame itself; raises if it has no row. An action, meant for the edge of a job."""
    if df.isEmpty():
        raise ValueError("at least one row is required")
    return df


def truthy(x: Column) -> Column:
    """Truth of a value where no threshold is given: nonzero, NaN included."""
    return F.coalesce(F.isnan(x.cast("double")) | (x.cast("double") != 0), F.lit(False))


def contingency(pairs: DataFrame, by: Sequence[str] = (), forecast: str = "forecast", observed: str = "observed", threshold: float | Column | None = None) -> DataFrame:
    """The four counts and n. With a threshold a value counts from it on; without one, if it is nonzero."""
    yes = (lambda c: truthy(F.col(c))) if threshold is None else (lambda c: at_least(F.col(c), threshold))
    f, o = yes(forecast), yes(observed)
    return pairs.groupBy(*by).agg(
        F.count_if(f & o).alias("hits"),
        F.count_if(~f & o).alias("misses"),
        F.count_if(f & ~o).alias("false_alarms"),
        F.count_if(~f & ~o).alias("correct_negatives"),
        F.count(F.lit(1)).alias("n"),
    )


def pod() -> Column:
    return ratio(F.col("hits"), F.col("hits") + F.col("misses"))


def far() -> Column:
    return ratio(F.col("false_alarms"), F.col("hits") + F.col("false_alarms"))


def csi() -> Column:
    return ratio(F.col("hits"), F.col("hits") + F.col("misses") + F.col("false_alarms"))


def frequency_bias() -> Column:
    return ratio(F.col("hits") + F.col("false_alarms"), F.col("hits") + F.col("misses"))


def ets() -> Column:
    """Equitable threat score: hits beyond those that chance would give."""
    chance = ratio((F.col("hits") + F.col("false_alarms")) * (F.col("hits") + F.col("misses")), F.col("n"))
    return ratio(F.col("hits") - chance, F.col("hits") + F.col("misses") + F.col("false_alarms") - chance)


CATEGORICAL = {"pod": pod, "far": far, "csi": csi, "bias": frequency_bias, "ets": ets}


def categorical_scores(table: DataFrame) -> DataFrame:
    """The five scores beside the counts of ``contingency``."""
    return table.select("*", *[score().alias(name) for name, score in CATEGORICAL.items()])


def _probability(p: str) -> Column:
    bad = F.col(p).isNull() | F.isnan(F.col(p).cast("double")) | (F.col(p) < 0) | (F.col(p) > 1)
    return F.when(bad, F.raise_error(F.lit(f"{p} must lie in [0, 1]")).cast("double")).otherwise(F.col(p).cast("double"))


def brier(cases: DataFrame, by: Sequence[str] = (), p: str = "p", outcome: str = "outcome") -> DataFrame:
    """Mean squared difference of probability and outcome. A probability outside [0, 1] raises."""
    return cases.groupBy(*by).agg(F.avg(F.pow(_probability(p) - F.col(outcome).cast("double"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def brier_skill(cases: DataFrame, by: Sequence[str] = (), p: str = "p", outcome: str = "outcome", reference: str | float = "reference") -> DataFrame:
    """1 - BS / BS of the reference, which is a checked column or one number; NaN where the reference is perfect."""
    ref = _probability(reference) if isinstance(reference, str) else F.lit(float(reference))
    own, other = F.avg(F.pow(_probability(p) - F.col(outcome), 2)), F.avg(F.pow(ref - F.col(outcome), 2))
    scored = cases.groupBy(*by).agg(own.alias("brier"), other.alias("brier_reference"), F.count(F.lit(1)).alias("n"))
    return scored.withColumn("bss", F.lit(1.0) - ratio(F.col("brier"), F.col("brier_reference")))


def reliability(cases: DataFrame, bins: int = 10, by: Sequence[str] = (), p: str = "p", outcome: str = "outcome") -> DataFrame:
    """Mean forecast and observed frequency of every probability bin; empty bins are listed with null means and count 0."""
    at = F.least(F.floor(_probability(p) * bins), F.lit(bins - 1)).cast("int")
    rows = cases.groupBy(*by, at.alias("bin")).agg(F.avg(p).alias("mean_forecast"), F.avg(F.col(outcome).cast("double")).alias("observed_frequency"), F.count(F.lit(1)).alias("count"))
    groups = cases.select(*by).distinct() if by else None
    frame = cases.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    every = groups.crossJoin(F.broadcast(frame)) if groups is not None else frame  # a fixed number of bins per group
    joined = every.join(rows, [*by, "bin"], "left")
    return joined.select(*by, "bin", (F.col("bin") / F.lit(bins)).alias("low"), ((F.col("bin") + 1) / F.lit(bins)).alias("high"), "mean_forecast", "observed_frequency", F.coalesce("count", F.lit(0)).alias("count"))


def crps_of(members: Column, observed: Column) -> Column:
    """CRPS of one ensemble held in an array: mean distance to the observation less half the mean distance of members.

    The second term is a weighted sum over the sorted members, so the cost is m log m and not m squared.
    """
    m = F.size(members).cast("double")
    distance = F.aggregate(members, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double") - observed)) / m
    ordered = F.sort_array(F.transform(members, lambda x: x.cast("double")))
    weighted = F.transform(ordered, lambda x, i: (2 * (i + 1) - m - 1) * x)
    return distance - F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / (m * m)


def crps(cases: DataFrame, by: Sequence[str] = (), members: str = "members", observed: str = "observed") -> DataFrame:
    """Mean CRPS of the cases of each group."""
    return cases.groupBy(*by).agg(F.avg(crps_of(F.col(members), F.col(observed))).alias("crps"), F.count(F.lit(1)).alias("n"))


def crps_long(rows: DataFrame, case: str, member_value: str = "value", observed: str = "observed") -> DataFrame:
    """CRPS per case of an ensemble in long form, one row per member: for ensembles too large for an array."""
    order = Window.partitionBy(case).orderBy(member_value)
    m = F.count(F.lit(1)).over(Window.partitionBy(case))
    ranked = rows.withColumn("_i", F.row_number().over(order)).withColumn("_m", m)
    x = F.col(member_value).cast("double")
    return ranked.groupBy(case).agg(
        (F.avg(F.abs(x - F.col(observed))) - F.sum((2 * F.col("_i") - F.col("_m") - 1) * x) / F.pow(F.first("_m"), F.lit(2))).alias("crps"), F.count(F.lit(1)).alias("members")
    )


def spread_skill(cases: DataFrame, by: Sequence[str] = (), members: str = "members", observed: str = "observed") -> DataFrame:
    """Mean population spread of the ensembles over the root mean square error of their means."""
    m = F.size(members).cast("double")
    mean = F.aggregate(members, F.lit(0.0), lambda a, x: a + x.cast("double")) / m
    rows = cases.withColumn("_mean", mean)
    var = F.aggregate(F.col(members), F.lit(0.0), lambda a, x: a + (x.cast("double") - F.col("_mean")) * (x.cast("double") - F.col("_mean"))) / m
    rows = rows.withColumn("_spread", F.sqrt(var))
    out = rows.groupBy(*by).agg(F.avg("_spread").alias("spread"), F.sqrt(F.avg(F.pow(F.col("_mean") - F.col(observed), 2))).alias("rmse"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("spread_skill", ratio(F.col("spread"), F.col("rmse")))


def continuous_errors(pairs: DataFrame, by: Sequence[str] = (), forecast: str = "forecast", observed: str = "observed") -> DataFrame:
    """Mean absolute error, root mean square error and mean error."""
    e = F.col(forecast).cast("double") - F.col(observed).cast("double")
    return pairs.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_bias"), F.count(F.lit(1)).alias("n"))


def exceedance(members: DataFrame, thresholds: Sequence[float], by: Sequence[str], value: str = "value") -> DataFrame:
    """Share of members at or above each threshold, for every group of ``by``."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = members.select(*by, value, levels)
    return rows.groupBy("threshold", *by).agg(F.avg(at_least(F.col(value), F.col("threshold")).cast("double")).alias("probability"))


def verification_cube(pairs: DataFrame, axes: Sequence[str], threshold: float, forecast: str = "forecast", observed: str = "observed") -> DataFrame:
    """Counts and scores for every combination of the axes, each axis also as a total (null); ``level`` is the grouping id."""
    f, o = at_least(F.col(forecast), threshold), at_least(F.col(observed), threshold)
    base = pairs.groupBy(*axes).agg(F.count_if(f & o).alias("hits"), F.count_if(~f & o).alias("misses"), F.count_if(f & ~o).alias("false_alarms"), F.count_if(~f & ~o).alias("correct_negatives"), F.count(F.lit(1)).alias("n"))
    cube = base.cube(*axes).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in (*COUNTS, "n")])
    return categorical_scores(cube)


def abstention_rate(decisions: DataFrame, by: Sequence[str] = (), abstained: str = "abstained") -> DataFrame:
    """Share of decisions that abstain."""
    return decisions.groupBy(*by).agg(F.avg(F.col(abstained).cast("double")).alias("abstention_rate"), F.count(F.lit(1)).alias("n"))
