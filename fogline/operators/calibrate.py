"""Isotonic calibration per product, lead, rung and season, with fallbacks for thin groups."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("product", "lead_min", "rung", "season")
MIN_POSITIVE = 2000


def pool_blocks(sx: np.ndarray, sy: np.ndarray, n: np.ndarray) -> list[tuple[float, float, int]]:
    """Blocks (sum of p, sum of outcomes, size) after merging neighbours whose means fall. Blocks end where the running sum of
    outcomes touches its convex minorant, so pooled stretches can be pooled again together."""
    held: list[tuple[float, float, int]] = []
    for x, y, m in zip(sx, sy, n, strict=True):
        block = (float(x), float(y), int(m))
        while held and held[-1][1] * block[2] > block[1] * held[-1][2]:
            before = held.pop()
            block = (before[0] + block[0], before[1] + block[1], before[2] + block[2])
        held.append(block)
    return held


def knots(blocks: list[tuple[float, float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Means of blocks; of knots at one place the first stays."""
    xs, ys = np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
    keep = np.concatenate([[True], xs[1:] != xs[:-1]])
    return xs[keep], ys[keep]


def pool_adjacent(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit: means of pooled blocks. Input order breaks ties."""
    order = np.argsort(p, kind="stable")
    return knots(pool_blocks(p[order], y[order], np.ones(len(p), dtype=np.int64)))


def _pool_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cases in order of key, p and ordinal to the blocks of every key of this task; memory is what a key's blocks take."""
    part, key, blocks, nth = TaskContext.get().partitionId(), None, [], 0

    def out() -> pd.DataFrame:
        done = pd.DataFrame(blocks, columns=["sx", "sy", "n"])
        for c, v in zip((*KEY, "positive_count"), key, strict=True):
            done[c] = v
        return done.assign(part=part, nth=np.arange(len(done)))

    for batch in batches:
        if batch.empty:
            continue
        values = batch[[*KEY, "positive_count"]]
        cuts = [0, *(1 + np.flatnonzero((values.iloc[1:].to_numpy() != values.iloc[:-1].to_numpy()).any(axis=1))), len(batch)]
        p, y = batch["_p"].to_numpy(), batch["_y"].to_numpy()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(values.iloc[a])
            if here != key:
                if key is not None:
                    yield out()
                key, blocks = here, []
            blocks = pool_blocks(
                np.concatenate([[x for x, _, _ in blocks], p[a:b]]), np.concatenate([[x for _, x, _ in blocks], y[a:b]]), np.concatenate([[x for _, _, x in blocks], np.ones(b - a)]).astype(np.int64)
            )
    if key is not None:
        yield out()


def fit_isotonic(
    cases: DataFrame, model_version: str, run_id: str, min_positive: int = MIN_POSITIVE, p: str = "p", outcome: str = "outcome", ordinal: str = "ordinal", levels: Sequence[Sequence[str]] = (("rung", "season"),), research_only: str | None = None
) -> DataFrame:
    """One table per key with enough positives: calibration_id, x and y knots, positive_count.

    ``levels`` says which of rung and season a table keeps: what it does not keep is "all" in the key, and such a table is fitted to
    all cases of its product and lead (and rung). A case that says "all" itself counts once. A probability or an outcome that is
    null or outside [0, 1] raises, and so does a case that the column ``research_only`` marks: such heads are never calibrated.

    Thin keys are dropped before anything is sorted. Ties in p keep the order of their ordinals, so they are not pooled
    beforehand. All levels are dealt at once by ranges of key, p and ordinal: a key or a probability that many cases share is
    spread over tasks, each pools what it holds, and a key's blocks are then pooled again. They are as many as its fit has steps
    and tasks have cuts.
    """
    unit = lambda c, what: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c).cast("double") < 0) | (F.col(c).cast("double") > 1), F.raise_error(F.lit(f"{what} outside [0, 1]")).cast("double")).otherwise(F.col(c).cast("double"))
    own = F.col(ordinal)
    if research_only is not None:
        own = F.when(F.coalesce(F.col(research_only), F.lit(False)), F.raise_error(F.lit("research-only heads are never calibrated")).cast(cases.schema[ordinal].dataType)).otherwise(own)
    keys = F.array_distinct(F.array(*[F.struct(*[(F.col(c) if c in kept else F.lit("all")).alias(c) for c in ("rung", "season")]) for kept in levels]))
    rows = cases.select("product", "lead_min", F.explode(keys).alias("_k"), unit(p, "probability").alias("_p"), unit(outcome, "outcome").alias("_y"), own.alias("_o"))
    rows = rows.select("product", "lead_min", "_k.rung", "_k.season", "_p", "_y", "_o")
    rich = rows.groupBy(*KEY).agg(F.sum("_y").cast("long").alias("positive_count")).where(F.col("positive_count") >= min_positive)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_schema = ", ".join(f"{k} {types[k]}" for k in KEY)
    order = [*KEY, "_p", "_o"]
    dealt = rows.join(rich, list(KEY)).repartitionByRange(*order).sortWithinPartitions(*order)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "nth"])
        x, y = knots(pool_blocks(group["sx"].to_numpy(), group["sy"].to_numpy(), group["n"].to_numpy()))
        key = {k: (int(v) if k == "lead_min" else v) for k in KEY if (v := group[k].iloc[0]) is not None}
        body = {"fitted_on_run_id": run_id, "key": key, "model_version": model_version, "x": x.tolist(), "y": y.tolist()}
        name = "cal-" + hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]
        return pd.DataFrame([[*(group[k].iloc[0] for k in KEY), name, x, y, int(group["positive_count"].iloc[0])]], columns=[*KEY, "calibration_id", "x", "y", "positive_count"])

    blocks = dealt.mapInPandas(_pool_ranges, f"sx double, sy double, n long, {key_schema}, positive_count long, part long, nth long")
    return blocks.groupBy(*KEY).applyInPandas(fit, f"{key_schema}, calibration_id string, x array<double>, y array<double>, positive_count long")


#: Keys with their own table, then one of all seasons, then one of all seasons and rungs: the order in which ``find_table`` looks.
LADDER = (("rung", "season"), ("rung",), ())


def fit_ladder(cases: DataFrame, model_version: str, run_id: str, min_positive: int = MIN_POSITIVE, **more) -> DataFrame:
    """Tables of all steps of the ladder in one pass; ``find_table`` falls back from a thin key to the next step."""
    return fit_isotonic(cases, model_version, run_id, min_positive, levels=LADDER, **more)


def find_table(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds the calibration of each key: its own, else that of all seasons, else that of all seasons and rungs (``all``);
    ``fallback`` says which step was taken, null where none is left."""
    step = lambda name, season, rung: tables.select(
        F.col("product"), F.col("lead_min"), F.col("rung").alias("_r"), F.col("season").alias("_s"), F.struct("calibration_id", "x", "y", "positive_count").alias(name)
    ).where((F.col("_s") == "all" if season else F.lit(True)) & (F.col("_r") == "all" if rung else F.lit(True)))
    w = wanted
    own = step("own", False, False)
    w = w.join(own.withColumnsRenamed({"_r": "rung", "_s": "season"}), list(KEY), "left")
    w = w.join(step("by_rung", True, False).withColumnRenamed("_r", "rung").drop("_s"), ["product", "lead_min", "rung"], "left")
    w = w.join(step("by_lead", True, True).drop("_r", "_s"), ["product", "lead_min"], "left")
    level = F.when(F.col("own").isNotNull(), 0).when(F.col("by_rung").isNotNull(), 1).when(F.col("by_lead").isNotNull(), 2)
    found = F.coalesce("own", "by_rung", "by_lead")
    return w.withColumn("fallback", level).withColumn("_t", found).select(*wanted.columns, "fallback", "_t.calibration_id", "_t.x", "_t.y", "_t.positive_count")


def predict(p: Column, x: Column, y: Column) -> Column:
    """Linear interpolation between knots, constant beyond both ends; null without knots."""
    q = F.least(F.greatest(p.cast("double"), F.lit(0.0)), F.lit(1.0))
    below = F.size(F.filter(x, lambda k: k <= q))
    n = F.size(x)
    x0, x1 = F.get(x, below - 1), F.get(x, below)
    y0, y1 = F.get(y, below - 1), F.get(y, below)
    inner = y0 + (q - x0) * (y1 - y0) / F.when(x1 == x0, F.lit(1.0)).otherwise(x1 - x0)
    return F.when(x.isNull() | (n < 1), F.lit(None).cast("double")).when(below == 0, F.get(y, F.lit(0))).when(below >= n, F.get(y, n - 1)).otherwise(inner)
