"""Leakage-aware splits of verification frames.

Frames carry frame_id, timestamp, event_id, domain, season and manifest_ids. Windows are given per split name as
``start/end`` texts; a date without a time as end includes that day. Random frame splits do not exist here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("chronological", "event_grouped", "geographic_holdout", "seasonal_holdout")
SPLIT_NAMES = ("train", "validation", "test")


def _instant(text: str, end: bool) -> datetime:
    text = text.strip()
    whole_day = len(text) == 10
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return at + timedelta(days=1) if end and whole_day else at


def windows_table(frames: DataFrame, windows: Mapping[str, Sequence[str]], buffer_hours: float = 0) -> DataFrame:
    """(split, start, stop) with the buffer taken off both ends; windows that the buffer turns around are left out."""
    rows = []
    for split, texts in windows.items():
        for text in [texts] if isinstance(texts, str) else texts:
            a, b = text.split("/")
            start = _instant(a, False) + timedelta(hours=buffer_hours)
            stop = _instant(b, True) - timedelta(hours=buffer_hours)
            if start < stop:
                rows.append((split, start, stop))
    return frames.sparkSession.createDataFrame(rows, "split string, start timestamp, stop timestamp")


def one_split(assigned: DataFrame, key: str = "frame_id") -> DataFrame:
    """(key, split) from possibly repeated assignments; raises where a key is in two splits."""
    both = F.raise_error(F.concat(F.lit("in more than one split: "), F.col(key).cast("string"))).cast("string")
    found = assigned.groupBy(key).agg(F.min("split").alias("low"), F.max("split").alias("high"))
    return found.select(key, F.when(F.col("low") != F.col("high"), both).otherwise(F.col("low")).alias("split"))


def chronological(frames: DataFrame, windows: Mapping[str, Sequence[str]], buffer_hours: float = 0) -> DataFrame:
    """(frame_id, split) of the frames inside a window; the rest are in no split."""
    spans = F.broadcast(windows_table(frames, windows, buffer_hours))  # a handful of configured windows
    at = F.col("timestamp").cast("timestamp")
    return one_split(frames.join(spans, (at >= F.col("start")) & (at < F.col("stop"))).select("frame_id", "split"))


def storm_day() -> Column:
    """Group of a frame: its event, or its UTC date."""
    return F.coalesce(F.col("event_id").cast("string"), F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd"))


def event_grouped_by_fraction(frames: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(frame_id, split): groups in order of their first frame, the first share to train, the next to validation."""
    if not (0 < train < 1 and 0 <= validation < 1 and train + validation < 1):
        raise ValueError("train and validation must leave a share for the test split")
    groups = frames.withColumn("group", storm_day()).groupBy("group").agg(F.min("timestamp").alias("first")).withColumn("day", F.to_date("first"))
    days = groups.groupBy("day").agg(F.count(F.lit(1)).alias("of_day"))  # one row per day, so one task may order them
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = days.select("day", (F.sum("of_day").over(upto) - F.col("of_day")).alias("before"), F.sum("of_day").over(whole).alias("n"))
    ranked = groups.join(days, "day").withColumn("nth", F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("first", "group")))
    n_train = F.greatest(F.floor(F.col("n") * train), F.lit(1))
    n_valid = F.floor(F.col("n") * validation)
    split = F.when(F.col("nth") <= n_train, "train").when(F.col("nth") <= n_train + n_valid, "validation").otherwise("test")
    return frames.withColumn("group", storm_day()).join(ranked.select("group", split.alias("split")), "group").select("frame_id", "split")


def event_grouped_by_windows(frames: DataFrame, windows: Mapping[str, Sequence[str]]) -> DataFrame:
    """(frame_id, split): a group goes whole to the split whose window holds any of its frames; two splits raise."""
    for name in windows:
        if name not in SPLIT_NAMES:
            raise KeyError(name)
    spans = F.broadcast(windows_table(frames, windows))
    grouped = frames.withColumn("group", storm_day())
    at = F.col("timestamp").cast("timestamp")
    hits = one_split(grouped.join(spans, (at >= F.col("start")) & (at < F.col("stop"))).select("group", "split"), "group")
    return grouped.join(hits, "group").select("frame_id", "split")


def event_grouped_by_assignment(frames: DataFrame, assignment: DataFrame) -> DataFrame:
    """(frame_id, split) from a table (group, split); a group without a valid split raises."""
    grouped = frames.withColumn("group", storm_day()).join(assignment, "group", "left")
    bad = F.raise_error(F.concat(F.lit("no valid split for group "), F.col("group"))).cast("string")
    ok = F.coalesce(F.col("split").isin(*SPLIT_NAMES), F.lit(False))
    return grouped.select("frame_id", F.when(ok, F.col("split")).otherwise(bad).alias("split"))


def holdout(frames: DataFrame, column: str, members: Mapping[str, Sequence[str]]) -> DataFrame:
    """(frame_id, split) by membership of a column (domain or season); values in two splits raise, others are dropped."""
    rows = [(value, split) for split, values in members.items() for value in values]
    table = F.broadcast(frames.sparkSession.createDataFrame(rows, f"{column} string, split string"))
    return one_split(frames.join(table, column).select("frame_id", "split"))


def leaked_manifests(frames: DataFrame, assigned: DataFrame) -> DataFrame:
    """Manifest ids that stand in more than one split, with the number of splits. Empty if nothing leaks."""
    rows = frames.join(assigned, "frame_id").select("split", F.explode("manifest_ids").alias("manifest_id"))
    return rows.groupBy("manifest_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def split(frames: DataFrame, strategy: str, allow_leaks: bool = False, **spec) -> DataFrame:
    """Dispatch by strategy name. Random splits of frames are refused: they leak. So is any split by which a manifest stands in
    two splits, unless ``allow_leaks``; the check is a job of its own, of which one row at most comes back."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown or forbidden split strategy: {strategy}")
    assigned = _by_strategy(frames, strategy, spec)
    if not allow_leaks and (leak := leaked_manifests(frames, assigned).first()):
        raise ValueError(f"manifest in {leak['splits']} splits: {leak['manifest_id']}")
    return assigned


def _by_strategy(frames: DataFrame, strategy: str, spec: dict) -> DataFrame:
    if strategy == "chronological":
        return chronological(frames, spec["windows"], spec.get("buffer_hours", 0))
    if strategy == "event_grouped":
        if "windows" in spec:
            return event_grouped_by_windows(frames, spec["windows"])
        if "assignment" in spec:
            return event_grouped_by_assignment(frames, spec["assignment"])
        return event_grouped_by_fraction(frames, *spec.get("fractions", (0.7, 0.15)))
    return holdout(frames, "domain" if strategy == "geographic_holdout" else "season", spec["members"])
