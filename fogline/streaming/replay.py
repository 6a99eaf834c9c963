"""Replay of landed manifests on a virtual clock, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fogline.functions.identity import replay_path


def raw_manifests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of manifests; ``path`` and ``type`` stand in for object_key and kind."""
    have = set(rows.columns)
    either = lambda a, b: F.coalesce(*[F.col(c) for c in (a, b) if c in have]) if have & {a, b} else F.lit(None).cast("string")
    named = rows.withColumn("object_key", either("object_key", "path")).withColumn("kind", F.coalesce(either("kind", "type"), F.lit("raw")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(blank("source") | blank("object_key") | blank("sha256"), "missing_identity")
        .when(F.col("kind") != "raw", "not_raw")
        .when(F.col("obs_time").isNull() | F.col("arrival_time").isNull(), "missing_time")
    )
    judged = named.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def replay_events(manifests: DataFrame, replay_id: str, domain: str, start: str, end: str) -> DataFrame:
    """Events that a replay emits between both times, which are included; virtual_time is the arrival."""
    space = replay_path("events", replay_id)
    inside = manifests.where((F.col("arrival_time") >= F.lit(start).cast("timestamp")) & (F.col("arrival_time") <= F.lit(end).cast("timestamp")))
    return inside.select(
        F.lit(replay_id).alias("replay_id"), F.lit(domain).alias("domain"), "source", "object_key", F.col("sha256").alias("manifest_sha256"),
        F.col("arrival_time").alias("virtual_time"), F.concat(F.lit(f"{space}/ingest."), F.col("source")).alias("topic"), F.lit(space).alias("namespace"),
    )


def released_at(virtual_time: Column, start: str, speed: float, tick_s: float) -> Column:
    """Number of the tick, from 1, that releases an event: ticks move the virtual clock by tick_s times speed."""
    if speed <= 0 or tick_s <= 0:
        raise ValueError("speed and tick must be positive")
    gone = (F.unix_micros(virtual_time.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / F.lit(1e6)
    return F.greatest(F.ceil(gone / F.lit(speed * tick_s)), F.lit(1)).cast("long")


def replay_ticks(events: DataFrame, start: str, end: str, speed: float, tick_s: float) -> DataFrame:
    """Per tick that releases anything: events, first and last virtual time, and the clock's progress after the tick."""
    total = F.greatest((F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / F.lit(1e6), F.lit(1.0))
    ticked = events.withColumn("tick", released_at(F.col("virtual_time"), start, speed, tick_s))
    out = ticked.groupBy("tick").agg(F.count(F.lit(1)).alias("events"), F.min("virtual_time").alias("first"), F.max("virtual_time").alias("last"))
    return out.withColumn("progress", F.least(F.col("tick") * speed * tick_s / total, F.lit(1.0)))


def between_clocks(events: DataFrame, before: str, now: str) -> DataFrame:
    """Events that moving the clock from ``before`` to ``now`` releases. A clock that moves backwards raises."""
    if pd.Timestamp(now, tz="UTC") < pd.Timestamp(before, tz="UTC"):
        raise ValueError(f"the clock moves back from {before} to {now}")
    return events.where((F.col("virtual_time") > F.lit(before).cast("timestamp")) & (F.col("virtual_time") <= F.lit(now).cast("timestamp")))


#: Interval that a step of a replay releases: events after ``after_us`` up to ``now_us``.
CLOCK = "replay_id string, step long, after_us long, now_us long, progress double, status string"


def _asked(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps (replay_id, step, real_seconds or target) beside the start, end and speed of their run, in microseconds. Steps of
    an unknown replay, steps that give neither or both, negative seconds and runs without length or speed raise."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    run = runs.select(F.col("replay_id").alias("_run"), us("t_start").alias("start_us"), us("t_end").alias("end_us"), F.col("speed").cast("double").alias("speed"))
    fault = (
        F.when(F.col("_run").isNull(), "replay not found")
        .when((F.col("speed") <= 0) | (F.col("start_us") >= F.col("end_us")), "a replay needs a positive speed and a start before its end")
        .when(F.col("real_seconds").isNull() == F.col("target").isNull(), "a step gives real_seconds or a target")
        .when(F.col("real_seconds") < 0, "real_seconds must not be negative")
    )
    joined = steps.select("replay_id", "step", "real_seconds", "target").join(run, F.col("replay_id") == F.col("_run"), "left")
    return joined.select(
        "replay_id", F.col("step").cast("long").alias("step"), F.round(F.col("real_seconds").cast("double") * F.col("speed") * 1e6).cast("long").alias("move_us"),
        us("target").alias("target_us"), "start_us", "end_us", F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True).alias("_fine"),
    ).where("_fine").drop("_fine")


def replay_clock(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """What each step of each replay releases (``CLOCK``), in order of step.

    A step moves the clock by real seconds times the run's speed, or to a target; it stops at the end of the run. The first step also
    releases what arrived exactly at the start. A target before the clock raises.
    """
    asked = _asked(steps, runs)
    upto = Window.partitionBy("replay_id").orderBy("step")  # a row per step of one replay
    leg = F.count("target_us").over(upto)
    moved = F.sum(F.coalesce("move_us", F.lit(0))).over(Window.partitionBy("replay_id", "_leg").orderBy("step"))
    base = F.coalesce(F.first("target_us").over(Window.partitionBy("replay_id", "_leg").orderBy("step")), F.col("start_us"))
    now = asked.withColumn("_leg", leg).withColumn("now_us", F.least(base + moved, "end_us"))
    before = F.coalesce(F.lag("now_us").over(upto), F.col("start_us"))
    out = now.withColumn("_before", before).withColumn("after_us", F.when(F.lag("now_us").over(upto).isNull(), F.col("start_us") - 1).otherwise(F.col("_before")))
    back = F.when(F.col("target_us") < F.col("_before"), F.raise_error(F.lit("the clock of a replay moves back")).cast("boolean")).otherwise(True)
    span = F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1_000_000))
    progress = F.least(F.lit(1.0), (F.col("now_us") - F.col("start_us")) / span)
    status = F.when(F.col("now_us") >= F.col("end_us"), "completed").otherwise("running")
    return out.where(back).select("replay_id", "step", "after_us", "now_us", progress.alias("progress"), status.alias("status"))


def replay_clock_stream(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """``replay_clock`` for a stream of steps: all that is kept of a replay is its clock and the number of its last step.

    Steps of a replay arrive in order across batches; within one they are put in order. A step at or before the last one
    raises as a clock moving back does, and the batch is not committed.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, clock = held.get if held.exists else (None, None)
        out = []
        for s in pd.concat(list(batches)).sort_values("step").itertuples():
            if last is not None and s.step <= last:
                raise ValueError(f"step {s.step} of replay {key[0]} comes after step {last}")
            at = s.start_us if clock is None else clock
            if not pd.isna(s.target_us) and s.target_us < at:
                raise ValueError(f"the clock of replay {key[0]} moves back")
            now = min(int(s.end_us), int(s.target_us) if not pd.isna(s.target_us) else at + int(s.move_us))
            span = max(s.end_us - s.start_us, 1_000_000)
            out.append((key[0], s.step, s.start_us - 1 if clock is None else clock, now, min(1.0, (now - s.start_us) / span), "completed" if now >= s.end_us else "running"))
            last, clock = int(s.step), now
        held.update((last, clock))
        yield pd.DataFrame(out, columns=["replay_id", "step", "after_us", "now_us", "progress", "status"])

    return _asked(steps, runs).groupBy("replay_id").applyInPandasWithState(update, CLOCK, "step long, now_us long", "append", GroupStateTimeout.NoTimeout)


def released(clock: DataFrame, events: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """The events (replay_id, virtual_time and more) that the steps of ``clock`` release, with the step.

    Both sides meet in buckets of virtual time, so the events of one long replay are dealt over many tasks; the clock may be a stream.
    """
    width = F.lit(bucket_s * 1_000_000)
    spans = clock.where("now_us > after_us").select(F.col("replay_id").alias("_run"), "step", "after_us", "now_us")
    spans = spans.withColumn("_span", F.explode(F.sequence(F.floor(F.col("after_us") / width), F.floor(F.col("now_us") / width))))
    timed = events.withColumn("_us", F.unix_micros(F.col("virtual_time").cast("timestamp"))).withColumn("_bucket", F.floor(F.col("_us") / width))
    met = (F.col("replay_id") == F.col("_run")) & (F.col("_bucket") == F.col("_span")) & (F.col("_us") > F.col("after_us")) & (F.col("_us") <= F.col("now_us"))
    return spans.join(timed, met).select("step", *[F.col(c) for c in events.columns])


def replay_state(events: DataFrame, now: str, start: str, end: str, by: Sequence[str] = ("replay_id",)) -> DataFrame:
    """Status and progress of replays at a virtual time."""
    at, a, b = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (now, start, end))
    progress = F.least(F.greatest((at - a) / F.greatest(b - a, F.lit(1_000_000)), F.lit(0.0)), F.lit(1.0))
    done = F.when(at >= b, "completed").otherwise("running")
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("manifest_count"), F.count_if(F.col("virtual_time") <= F.lit(now).cast("timestamp")).alias("released")).withColumns({"progress": progress, "status": done})


def replay_run(runs: DataFrame, replay_id: str) -> DataFrame:
    """The rows of one replay."""
    return runs.where(F.col("replay_id") == replay_id)


def without_replay(runs: DataFrame, replay_id: str) -> DataFrame:
    """All other replays; rows without an id stay."""
    return runs.where(~F.col("replay_id").eqNullSafe(replay_id))
