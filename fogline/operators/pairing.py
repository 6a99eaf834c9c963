"""Pair forecasts with the first truth that falls into their window.

A truth fits a forecast if ``issue < obs <= issue + lead`` and, with a cut-off, it had arrived by then. Of those that fit, the
smallest (obs, arrival, id) is taken. That is the next truth after the issue, if it is not too late: forecasts and truths are
sorted together, and a window carries the next truth back in time. Time is cut into buckets as long as the longest lead; the
first truth of a bucket is also put into the one before it, so no forecast has to look further. There is no join, and the work
grows with the rows and not with pairs of them.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_first_after(forecasts: DataFrame, truths: DataFrame, keys: Sequence[str] = (), as_of: str | None = None, max_lead_min: int = 120) -> DataFrame:
    """Forecasts (forecast_id, issue_time, lead_min, value) with truth_id, obs_time, arrival_time and observed of their truth.

    ``keys`` must be equal on both sides; a null key meets nothing. Forecasts without a truth, with a null time or lead, or with
    a lead above ``max_lead_min`` (which raises) are not in the result; a repeated forecast is paired each time. Rows come in no
    order; sort by issue, lead and id to read them.
    """
    width = max(60, max_lead_min * 60) * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lead = F.when(F.col("lead_min") > max_lead_min, F.raise_error(F.lit("lead beyond max_lead_min")).cast("int")).otherwise(F.col("lead_min"))
    f = forecasts.select(*keys, F.struct("forecast_id", "issue_time", lead.alias("lead_min"), F.col("value").alias("forecast")).alias("f"), us("issue_time").alias("at"))
    f = f.withColumn("bucket", F.floor(F.col("at") / width))
    t = truths if as_of is None else truths.where(F.col("arrival_time").cast("timestamp") <= F.lit(as_of).cast("timestamp"))
    t = t.select(*keys, F.struct("obs_time", "arrival_time", "truth_id", F.col("value").alias("observed")).alias("t"), us("obs_time").alias("at")).where("at is not null")
    t = t.withColumn("bucket", F.floor(F.col("at") / width))
    ahead = t.groupBy(*keys, "bucket").agg(F.min("t").alias("t"), F.min("at").alias("at")).withColumn("bucket", F.col("bucket") - 1)
    rows = f.unionByName(t, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    # from late to early; at one time forecasts come before truths, and the smallest truth comes last
    back = Window.partitionBy(*keys, "bucket").orderBy(F.col("at").desc(), F.col("f").isNull(), F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("t", F.last("t", ignorenulls=True).over(back)).where("f is not null and t is not null")
    fits = us("t.obs_time") <= F.col("at") + F.col("f.lead_min").cast("long") * 60_000_000
    return found.where(fits).select(*keys, "f.forecast_id", "f.issue_time", "f.lead_min", "f.forecast", "t.truth_id", "t.obs_time", "t.arrival_time", "t.observed")


#: Stretches of time that frames are cut into; their number does not grow with the data.
STRETCHES = 4096


def _last_k(group: Sequence[str], at: str, k: int, least: int, out: Sequence[str]):
    """Over rows in order of the columns ``group`` and of time, frames before issues: at every issue the last k frames by observation,
    if there are ``least``, oldest first, as rows (group, at, frame, obs, arrival, nth) under the names ``out``. State is k frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            found = []
            columns = [batch[c].tolist() for c in (at, "issue", "obs", "frame", "at")]
            keys = zip(*[batch[c].tolist() for c in group], strict=True) if group else [()] * len(batch)
            for here, when, is_issue, obs, frame, arrival in zip(keys, *columns, strict=True):
                if here != key:
                    key, held = here, []
                if is_issue:
                    found += [] if len(held) < least else [(*here, when, f, o, a, nth) for nth, (o, f, a) in enumerate(held, 1)]
                else:
                    insort(held, (obs, frame, arrival))
                    del held[:-k]
            yield pd.DataFrame(found, columns=list(out))

    return run


def latest_frames(issues: DataFrame, frames: DataFrame, k: int, keys: Sequence[str] = (), stretches: int = STRETCHES) -> DataFrame:
    """(keys, issue_time, frame_id, obs_time, arrival_time, nth): for every issue time the last ``k`` frames by observation that had
    arrived by then, oldest first as ``nth`` from 1; frames of one observation time go by id.

    An issue with fewer than ``k`` usable frames has no row: the caller abstains. A frame that arrives before it is observed
    raises; one without a time is never usable. Frames and issues meet on ``keys``, where null meets nothing; a repeated issue
    counts once, a repeated frame each time. Other columns of frames are joined by frame_id.

    Time is cut into stretches. Each keeps its last k frames; what is carried into a stretch is the last k of all before, so
    a stretch needs its own rows and k more. Rows are shuffled as frames plus issues, and no frame meets an issue that it does not serve.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    named = [F.col(c).isNotNull() for c in keys]
    late = F.when(F.col("arrival_time") < F.col("obs_time"), F.raise_error(F.lit("frame arrives before it is observed")).cast("long")).otherwise(us("arrival_time"))
    f = frames.select(*keys, late.alias("at"), us("obs_time").alias("obs"), F.col("frame_id").alias("frame")).where("at is not null and obs is not null and frame is not null")
    i = issues.select(*keys, us("issue_time").alias("at")).where("at is not null").distinct()
    for c in named:
        f, i = f.where(c), i.where(c)
    ends = f.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    low = ends["a"] or 0
    width = max(1, ((ends["b"] or 0) - low) // stretches + 1)
    stretch = F.least(F.greatest(F.floor((F.col("at") - low) / width), F.lit(-1)), F.lit(stretches)).cast("int")  # before the first frame, and after the last
    f, i = f.withColumn("stretch", stretch), i.withColumn("stretch", stretch)
    back = Window.partitionBy(*keys, "stretch").orderBy(F.desc("obs"), F.desc("frame"), F.desc("at"))
    tops = f.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= k).drop("_n")
    asked = i.select(*keys, "stretch").distinct()
    types = {x.name: x.dataType.simpleString() for x in f.schema.fields}
    ddl = "".join(f"`{c}` {types[c]}, " for c in keys)

    blank = {"obs": F.lit(0).cast("long"), "frame": F.lit(0).cast(types["frame"]), "issue": F.lit(True)}  # no nulls: ids stay whole numbers
    marked = tops.withColumn("issue", F.lit(False)).unionByName(asked.withColumns(blank | {"at": F.lit(0).cast("long")}))
    dealt = (marked.repartition(*keys) if keys else marked.repartition(1)).sortWithinPartitions(*keys, "stretch", F.desc("issue"))  # k rows a stretch
    names = [*keys, "stretch", "frame", "obs", "at", "nth"]
    carried = dealt.mapInPandas(_last_k(keys, "stretch", k, 1, names), f"{ddl}stretch int, frame {types['frame']}, obs long, at long, nth int").drop("nth")
    here = f.join(asked, [*keys, "stretch"], "left_semi").unionByName(carried)
    rows = here.withColumn("issue", F.lit(False)).unionByName(i.withColumns(blank))
    dealt = rows.repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "at", "issue")
    names = [*keys, "stretch", "issue_us", "frame", "obs", "arrival", "nth"]
    found = dealt.mapInPandas(_last_k([*keys, "stretch"], "at", k, k, names), f"{ddl}stretch int, issue_us long, frame {types['frame']}, obs long, arrival long, nth int")
    time = lambda c: F.timestamp_micros(c)
    return found.select(*keys, time("issue_us").alias("issue_time"), F.col("frame").alias("frame_id"), time("obs").alias("obs_time"), time("arrival").alias("arrival_time"), "nth")
