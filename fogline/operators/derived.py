"""Derived channels: rates of change over a gap in time, differences of channels and of vectors between levels.

Cells are (keys..., channel, row, col, at, value, mask). What a derived cell is made of must be valid; else it is there with value 0
and mask false, so that normalisation and masks treat it as any missing cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogline.functions.numeric import finite


@dataclass(frozen=True)
class Rate:
    """Change of a channel per ``per_min`` minutes, against the frame nearest to ``lag_min`` before, at most ``tolerance_min`` off."""

    channel: str
    lag_min: float = 15.0
    tolerance_min: float = 7.5
    per_min: float = 15.0


@dataclass(frozen=True)
class Difference:
    """Channel ``a`` less channel ``b``."""

    a: str
    b: str


@dataclass(frozen=True)
class Shear:
    """Length of the difference of two vectors, each given by its two channels."""

    upper: tuple[str, str]
    lower: tuple[str, str]


def _usable() -> Column:
    return F.coalesce(F.col("mask").cast("boolean"), F.lit(False)) & finite(F.col("value"))


def rates(cells: DataFrame, wanted: Mapping[str, Rate], keys: Sequence[str] = ()) -> DataFrame:
    """Cells of the rates, with the columns of ``cells``. The gap that counts is the real one between the two frames.

    Of two frames equally near the earlier is taken; frames whose cell is masked are passed over. All candidates come from windows
    over one sort of a cell's frames, whatever the number of rates.
    """
    gaps = sorted({(r.lag_min, r.tolerance_min) for r in wanted.values()})
    if any(not 0 <= tolerance < lag for lag, tolerance in gaps):
        raise ValueError("a tolerance must be less than its lag")
    rows = cells.where(F.col("channel").isin(*{r.channel for r in wanted.values()})).withColumn("_at", F.unix_micros(F.col("at").cast("timestamp")))
    held = F.when(_usable(), F.struct(F.col("_at").alias("at"), F.col("value").cast("double").alias("value")))
    order = Window.partitionBy(*keys, "channel", "row", "col").orderBy("_at")
    for i, (lag, tolerance) in enumerate(gaps):
        lag_us, off = round(lag * 60e6), round(tolerance * 60e6)
        early = F.last(held, ignorenulls=True).over(order.rangeBetween(-lag_us - off, -lag_us))
        late = F.first(held, ignorenulls=True).over(order.rangeBetween(-lag_us, off - lag_us))
        rows = rows.withColumns({f"_early{i}": early, f"_late{i}": late})
        near = lambda c: F.abs(F.col("_at") - F.col(f"{c}.at") - lag_us)  # noqa: E731, B023
        later = F.col(f"_early{i}").isNull() | (near(f"_late{i}") < near(f"_early{i}"))
        rows = rows.withColumn(f"_then{i}", F.when(later, F.col(f"_late{i}")).otherwise(F.col(f"_early{i}")))
    each = [F.when(F.col("channel") == r.channel, F.struct(F.lit(name).alias("name"), F.col(f"_then{gaps.index((r.lag_min, r.tolerance_min))}").alias("then"), F.lit(float(r.per_min)).alias("per"))) for name, r in wanted.items()]
    rows = rows.withColumn("_rate", F.explode(F.array_compact(F.array(*each))))
    ok = _usable() & F.col("_rate.then").isNotNull()
    change = (F.col("value") - F.col("_rate.then.value")) / ((F.col("_at") - F.col("_rate.then.at")) / F.lit(60e6)) * F.col("_rate.per")
    derived = {"value": F.when(ok, change).otherwise(F.lit(0.0)), "mask": ok, "channel": F.col("_rate.name")}
    return rows.withColumns(derived).select(*cells.columns)


def combinations(cells: DataFrame, wanted: Mapping[str, Difference | Shear], keys: Sequence[str] = ()) -> DataFrame:
    """Cells of differences and shears, with the columns of ``cells``: one aggregation per cell and time brings all channels together.

    A cell at which none of the channels was seen has no row; one that lacks some of them is masked. With age_min, the
    greatest age of what it is made of counts. Of repeated cells of a channel the largest value counts.
    """
    parts = {name: (w.a, w.b) if isinstance(w, Difference) else (*w.upper, *w.lower) for name, w in wanted.items()}
    sources = sorted({c for p in parts.values() for c in p})
    cell = [*keys, "row", "col", "at"]
    of = lambda c, v: F.max(F.when((F.col("channel") == c) & _usable(), v))
    aged = "age_min" in cells.columns
    found = cells.where(F.col("channel").isin(*sources)).groupBy(*cell).agg(
        *[of(c, F.col("value").cast("double")).alias(f"_v{i}") for i, c in enumerate(sources)], *[F.max(F.when(F.col("channel") == c, F.col("age_min"))).alias(f"_a{i}") for i, c in enumerate(sources) if aged]
    )
    v = {c: F.col(f"_v{i}") for i, c in enumerate(sources)}

    def value(w: Difference | Shear) -> Column:
        if isinstance(w, Difference):
            return v[w.a] - v[w.b]
        return F.hypot(v[w.upper[0]] - v[w.lower[0]], v[w.upper[1]] - v[w.lower[1]])

    age = lambda p: [F.greatest(*[F.col(f"_a{sources.index(c)}") for c in p]).alias("age_min")] if aged else []
    rows = found.select(*cell, F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), value(w).alias("value"), *age(parts[n])) for n, w in wanted.items()])).alias("d"))
    more = ["d.age_min"] if aged else []
    flat = rows.select(*cell, "d.channel", F.coalesce("d.value", F.lit(0.0)).alias("value"), F.col("d.value").isNotNull().alias("mask"), *more)
    return flat.select(*cells.columns)


def with_derived(cells: DataFrame, wanted: Mapping[str, Rate | Difference | Shear], keys: Sequence[str] = ()) -> DataFrame:
    """``cells`` and all derived channels, ready for a contract that names both. ``cells`` has keys, channel, row, col, at, value, mask,
    and perhaps age_min."""
    cells = cells.withColumns({"value": F.col("value").cast("double"), "mask": F.coalesce(F.col("mask").cast("boolean"), F.lit(False))})
    out = cells
    if over_time := {n: w for n, w in wanted.items() if isinstance(w, Rate)}:
        out = out.unionByName(rates(cells, over_time, keys))
    if at_once := {n: w for n, w in wanted.items() if not isinstance(w, Rate)}:
        out = out.unionByName(combinations(cells, at_once, keys))
    return out
