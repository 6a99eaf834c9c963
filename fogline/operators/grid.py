"""Field algebra on long cell tables.

A field is rows of (keys..., row, col, value); ``valid`` is optional. Rows count from north, columns from west. All operators
but object detection are joins, windows and aggregates over cells, so a field of any size is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from fogline.functions.numeric import at_least, finite

REDUCERS = ("min", "max", "max_abs", "sum", "nearest", "mean")
#: Resampling policies of the channel catalogue and how cells of a window are reduced.
POLICIES = {
    "nearest-min": "min", "min": "min", "minimum": "min", "max": "max", "maximum": "max", "signed-max-abs": "max_abs", "max-abs": "max_abs",
    "nearest": "nearest", "sum": "sum", "area-mean": "mean", "mean": "mean", "bilinear": "bilinear",
}


def dense(cells: DataFrame, ny: int, nx: int, keys: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Every cell of the ny x nx grid for every key, missing values filled."""
    spark = cells.sparkSession
    frame = spark.range(ny * nx).select((F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    every = cells.select(*keys).distinct().crossJoin(frame) if keys else frame  # keys x cells is the size of the dense field
    return every.join(cells.select(*keys, "row", "col", "value"), [*keys, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def summed_area(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive two-dimensional prefix sums (column ``total``) of a dense field."""
    along = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_along", F.sum("value").over(along)).withColumn("total", F.sum("_along").over(down)).drop("_along")


def box_mean(cells: DataFrame, scale: int, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Means of the scale x scale windows that lie fully inside, at their north-west cell. The field must be dense."""
    if scale < 1:
        raise ValueError("scale must be positive")
    along = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(0, scale - 1)
    down = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(0, scale - 1)
    rows = cells.withColumn("_s", F.sum(value).over(along)).withColumn("_n", F.count(F.lit(1)).over(along)).where(F.col("_n") == scale)
    both = rows.withColumn("_t", F.sum("_s").over(down)).withColumn("_m", F.count(F.lit(1)).over(down)).where(F.col("_m") == scale)
    return both.select(*keys, "row", "col", (F.col("_t") / F.lit(float(scale * scale))).alias("value"))


def fractions_skill(pairs: DataFrame, scales: Sequence[int], keys: Sequence[str] = (), threshold: float | None = None, forecast: str = "forecast", observed: str = "observed") -> DataFrame:
    """Fractions skill score per scale of dense (keys, row, col, forecast, observed); with a threshold, of exceedances.

    A scale that does not fit inside the field has no row. Sums of boxes are differences of running sums, first along rows and
    then along columns: two shuffles and two sorts for all scales together, and the same work a cell for a box of any size.
    """
    scales = sorted({int(s) for s in scales})
    if not scales or scales[0] < 1:
        raise ValueError("scales must be positive")
    take = lambda c: (at_least(F.col(c), threshold).cast("double") if threshold is not None else F.col(c).cast("double"))
    base = pairs.select(*keys, "row", "col", take(forecast).alias("f"), take(observed).alias("o"))

    def boxes(rows: DataFrame, window: WindowSpec, sums: dict[str, tuple[str, int]]) -> DataFrame:
        """Sums of the last cells of every column of ``sums`` (from, scale), null where the box would begin outside."""
        running = {c: F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, 0)) for c in {c for c, _ in sums.values()}}
        rows = rows.withColumns({f"_run_{c}": w for c, w in running.items()} | {"_nth": F.row_number().over(window)})
        ends = {name: F.when(F.col("_nth") >= s, F.col(f"_run_{c}") - F.lag(f"_run_{c}", s, 0.0).over(window)) for name, (c, s) in sums.items()}
        return rows.withColumns(ends)

    along = boxes(base, Window.partitionBy(*keys, "row").orderBy("col"), {f"{c}{s}": (c, s) for s in scales for c in "fo"})
    strips = along.select(*keys, "row", "col", *[f"{c}{s}" for s in scales for c in "fo"])
    both = boxes(strips, Window.partitionBy(*keys, "col").orderBy("row"), {f"{c}{s}_": (f"{c}{s}", s) for s in scales for c in "fo"})
    sums = []
    for s in scales:
        f, o = (F.col(f"{c}{s}_") / float(s * s) for c in "fo")
        sums += [F.sum((f - o) * (f - o)).alias(f"mse{s}"), F.sum(f * f + o * o).alias(f"worst{s}")]
    found = both.groupBy(*keys).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.col(f"mse{s}").alias("mse"), F.col(f"worst{s}").alias("worst")) for s in scales])).alias("s")
    flat = found.select(*keys, each).select(*keys, "s.*").where("worst is not null")
    none = F.col("worst") == 0
    return flat.select(*keys, "scale", F.when(none, 1.0).otherwise(1.0 - F.col("mse") / F.when(none, 1.0).otherwise(F.col("worst"))).alias("fss"))


def probabilistic_fractions_skill(pairs: DataFrame, scales: Sequence[int], keys: Sequence[str] = (), forecast: str = "forecast", observed: str = "observed") -> DataFrame:
    """Fractions skill of probabilities; one outside [0, 1] raises."""
    p = F.col(forecast).cast("double")
    bad = F.isnan(p) | (p < 0) | (p > 1)
    checked = pairs.withColumn(forecast, F.when(bad, F.raise_error(F.lit("probability outside [0, 1]")).cast("double")).otherwise(p))
    return fractions_skill(checked, scales, keys, None, forecast, observed)


def axis_windows(spark, source: int, target: int, name: str) -> DataFrame:
    """(to_<name>, <name>): which source indices make each target index. Windows of a shrinking axis may overlap."""
    i = F.col("id")
    if target >= source:
        start = F.least(F.lit(source - 1), F.floor(i * source / F.lit(target)))
        stop = start + 1
    else:
        start = F.floor(i * source / F.lit(target))
        stop = F.greatest(start + 1, F.ceil((i + 1) * source / F.lit(target)))
    return spark.range(target).select(i.cast("int").alias(f"to_{name}"), F.explode(F.sequence(start.cast("int"), stop.cast("int") - 1)).alias(name))


def _windows(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int]) -> tuple[DataFrame, dict[str, Callable[[Column], Column]]]:
    """Cells spread over the target cells whose window they lie in, and what each reducer makes of a window's usable values."""
    spark = cells.sparkSession
    rows, cols = axis_windows(spark, shape[0], target[0], "row"), axis_windows(spark, shape[1], target[1], "col")
    usable = finite(F.col("value")) & (F.coalesce(F.col("valid").cast("boolean"), F.lit(False)) if "valid" in cells.columns else F.lit(True))
    spread = cells.join(F.broadcast(rows), "row").join(F.broadcast(cols), "col")  # axes have at most a few thousand entries
    spread = spread.withColumn("_v", F.when(usable, F.col("value").cast("double"))).withColumn("_place", F.when(usable, F.col("row") * shape[1] + F.col("col")))
    return spread, {
        "min": lambda v: F.min(v),
        "max": lambda v: F.max(v),
        "sum": lambda v: F.sum(v),
        "mean": lambda v: F.avg(v),
        "nearest": lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("_place"))),
        "max_abs": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(F.abs(v).alias("a"), (-F.col("_place")).alias("p")))),
    }


def regrid(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int], reducer: str, keys: Sequence[str] = (), fill: float = float("nan")) -> DataFrame:
    """Reduce the source window of every target cell over its valid finite values; a window without any gives ``fill``.

    ``valid`` is honoured if the table has it. Ties of ``max_abs`` and the choice of ``nearest`` go by row-major order.
    """
    if reducer not in REDUCERS:
        raise ValueError(f"unknown reducer: {reducer}")
    spread, reduced = _windows(cells, shape, target)
    found = spread.groupBy(*keys, "to_row", "to_col").agg(reduced[reducer](F.col("_v")).alias("value"))
    return found.select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.coalesce("value", F.lit(float(fill))).alias("value"))


def regrid_by(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int], reducers: Mapping[str, str], keys: Sequence[str], fill: float = float("nan")) -> DataFrame:
    """``regrid`` of many channels in one aggregation, each by its own reducer; ``keys`` contain channel."""
    spread, reduced = _windows(cells, shape, target)
    of = lambda r: F.col("channel").isin(*[c for c, x in reducers.items() if x == r])
    each = [reduced[r](F.when(of(r), F.col("_v"))).alias(f"_{r}") for r in sorted(set(reducers.values()))]
    found = spread.groupBy(*keys, "to_row", "to_col").agg(*each)
    value = F.coalesce(*[f"_{r}" for r in sorted(set(reducers.values()))], F.lit(float(fill)))  # a channel has one of them
    return found.select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), value.alias("value"))


def _axis_weights(spark, source: int, target: int, name: str) -> DataFrame:
    """(to_<name>, <name>, w_<name>): the two source indices of each target index, both ends aligned."""
    at = F.lit(0.0) if target == 1 else F.col("id") * F.lit(float(source - 1)) / F.lit(float(target - 1))
    low = F.least(F.floor(at), F.lit(source - 1)).cast("int")
    part = at - low
    pairs = F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.lit(source - 1)).alias("i"), part.alias("w")))
    rows = spark.range(target).select(F.col("id").cast("int").alias(f"to_{name}"), F.explode(pairs).alias("x"))
    return rows.select(f"to_{name}", F.col("x.i").alias(name), F.col("x.w").alias(f"w_{name}")).where(F.col(f"w_{name}") > 0)


def bilinear(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int], keys: Sequence[str] = (), fill: float = float("nan")) -> DataFrame:
    """Separable linear interpolation. A field (per key) with any NaN is resampled by nearest cell instead."""
    spark = cells.sparkSession
    sparse = cells.groupBy(*keys).agg(F.max(F.isnan(F.col("value").cast("double")).cast("int")).alias("_nan")) if keys else None
    flagged = cells.join(sparse, list(keys)) if keys else cells.crossJoin(cells.agg(F.max(F.isnan(F.col("value").cast("double")).cast("int")).alias("_nan")))
    whole, holed = flagged.where("_nan = 0").drop("_nan"), flagged.where("_nan = 1").drop("_nan")
    joined = whole.join(F.broadcast(_axis_weights(spark, shape[0], target[0], "row")), "row").join(F.broadcast(_axis_weights(spark, shape[1], target[1], "col")), "col")
    smooth = joined.groupBy(*keys, "to_row", "to_col").agg(F.sum(F.col("value") * F.col("w_row") * F.col("w_col")).alias("value"))
    smooth = smooth.select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), "value")
    return smooth.unionByName(regrid(holed, shape, target, "nearest", keys, fill))


def regrid_policy(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int], resampling: str, keys: Sequence[str] = (), fill: float = float("nan")) -> DataFrame:
    """Resample by the name a channel's catalogue entry gives; bilinear with a validity mask means the mean of valid cells."""
    name = POLICIES.get(resampling.lower().replace("_", "-"))
    if name is None:
        raise ValueError(f"unsupported resampling policy: {resampling}")
    if name == "bilinear":
        return regrid(cells, shape, target, "mean", keys, fill) if "valid" in cells.columns else bilinear(cells, shape, target, keys, fill)
    return regrid(cells, shape, target, name, keys, fill)


def persistence(cells: DataFrame, leads: int) -> DataFrame:
    """The field repeated for every lead step from 1."""
    return cells.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads))))


def source_cell(motion_u: Column, motion_v: Column, step: Column) -> tuple[Column, Column]:
    """Cell that the value comes from, half steps rounded to even."""
    return F.rint(F.col("row") - motion_v * step).cast("int"), F.rint(F.col("col") - motion_u * step).cast("int")


def advect(cells: DataFrame, motion: DataFrame, steps: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Field after each number of steps along a motion field (keys, row, col, u, v), always from the original field.

    Every target cell looks back along its own motion; from outside the grid comes 0. Adds ``lead``.
    """
    leads = F.explode(F.array(*[F.lit(int(s)) for s in steps]))
    targets = motion.select(*keys, "row", "col", "u", "v", leads.alias("lead"))
    r, c = source_cell(F.col("u"), F.col("v"), F.col("lead"))
    looking = targets.select(*keys, "lead", "row", "col", r.alias("_r"), c.alias("_c"))
    source = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col("value"))
    on = (F.col("_r") == F.col("_sr")) & (F.col("_c") == F.col("_sc"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return looking.join(source, on, "left").select(*keys, "lead", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def lagrangian_persistence(cells: DataFrame, motion: DataFrame, leads: int, keys: Sequence[str] = ()) -> DataFrame:
    """Advection for steps 1 to ``leads``."""
    return advect(cells, motion, range(1, leads + 1), keys)


def ensemble(cells: DataFrame, motion: DataFrame, leads: int = 36, members: int = 24, seed: int = 0, noise: float = 0.02, motion_quality: float = 1.0, coverage: float = 1.0, frames: int = 2, keys: Sequence[str] = ()) -> tuple[DataFrame, str | None]:
    """Noisy members around the advected field, and the reason for abstaining if there is one.

    With fewer than two frames, or motion quality or coverage under 0.3, members repeat the latest field. The spread of the
    noise is the population deviation of the field times ``noise``; values stay at or above 0. Noise is drawn per member and
    cell from a digest of the seed, so a member does not depend on how the rows are partitioned.
    """
    if not (0 <= motion_quality <= 1 and 0 <= coverage <= 1):
        raise ValueError("motion_quality and coverage must lie in [0, 1]")
    if frames < 1:
        raise ValueError("one frame must be available at issue time")
    each = F.explode(F.sequence(F.lit(0), F.lit(members - 1)))
    if frames < 2 or motion_quality < 0.3 or coverage < 0.3:
        return persistence(cells, leads).withColumn("member", each), "poor_motion"
    spread = cells.groupBy(*keys).agg((F.stddev_pop("value") * noise).alias("_spread"))
    steady = lagrangian_persistence(cells, motion, leads, keys)
    steady = steady.join(spread, list(keys)) if keys else steady.crossJoin(F.broadcast(spread))  # one row
    rows = steady.withColumn("member", each)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*keys, "member", "lead", "row", "col")]))
    uniform = lambda at: (F.conv(F.substring(digest, at, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)  # noqa: E731  52 bits
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(14))
    return rows.withColumn("value", F.greatest(F.col("value") + normal * F.col("_spread"), F.lit(0.0))).drop("_spread"), None


def blend(members: DataFrame, model: DataFrame | None, weight: float | Sequence[float] = 0.5) -> tuple[DataFrame | None, str | None]:
    """Weighted mean of the ensemble mean and a model field by lead; without a model field nothing, and the reason."""
    if model is None:
        return None, "nwp_missing"
    weights = [weight] if isinstance(weight, int | float) else list(weight)
    if any(not 0 <= w <= 1 for w in weights):
        raise ValueError("weights must lie in [0, 1]")
    w = F.lit(float(weights[0])) if len(weights) == 1 else F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("lead").cast("int"))
    mean = members.groupBy("lead", "row", "col").agg(F.avg("value").alias("observed_mean"))
    both = mean.join(model.select("lead", "row", "col", F.col("value").alias("model_value")), ["lead", "row", "col"])
    return both.select("lead", "row", "col", (w * F.col("observed_mean") + (1 - w) * F.col("model_value")).alias("value")), None


def combined_mask(channels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells valid in all of the named channels of (channel, row, col, valid); a name that never occurs raises."""
    missing = F.array_except(F.array(*[F.lit(n) for n in names]), F.collect_set("channel"))
    rows = channels.where(F.col("channel").isin(*names))
    check = rows.agg(missing.alias("missing")).select(F.when(F.size("missing") > 0, F.raise_error(F.concat(F.lit("no such channel: "), F.array_join("missing", ", "))).cast("boolean")).otherwise(F.lit(True)).alias("known"))
    valid = rows.groupBy("row", "col").agg((F.bool_and(F.coalesce(F.col("valid").cast("boolean"), F.lit(False))) & (F.count_distinct("channel") == len(set(names)))).alias("valid"))
    return valid.crossJoin(F.broadcast(check)).where("known").drop("known")  # the check is one row
