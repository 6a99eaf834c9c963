"""Streaming forms of ingest, deduplication, pairing and tracking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fogline.functions.tables import many_tasks
from fogline.operators.objects import TRACKS, Track, TrackerState, detections_of, track_step
from fogline.sources.manifests import MANIFEST_KEY, merge_manifest


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of Parquet files as a stream, with the schema of what is there; a table that is one file is found by name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def first_arrivals(arrivals: DataFrame, delay: str = "7 days", key: str = "observation_id", time: str = "arrival_time") -> DataFrame:
    """Each observation once: repeats within the delay are dropped, and state older than that is forgotten."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def pair_stream(forecasts: DataFrame, truths: DataFrame, max_lead_min: int = 120, delay: str = "3 hours") -> DataFrame:
    """All truths inside each forecast's window, as an interval join of two streams; both watermarks bound its state.

    The choice of the first truth is an aggregate over this result: see ``pair_first_after`` for the batch form.
    """
    f = forecasts.select("forecast_id", "issue_time", "lead_min", F.col("value").alias("forecast")).withWatermark("issue_time", delay)
    return _inside(f, truths.select("truth_id", "obs_time", "arrival_time", F.col("value").alias("observed")).withWatermark("obs_time", delay), max_lead_min)


def _inside(f: DataFrame, t: DataFrame, max_lead_min: int) -> DataFrame:
    """Pairs of forecasts (issue_time, lead_min) and truths (obs_time), both with a watermark, whose window holds the truth."""
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (max_lead_min * 60))
    f = f.withColumn("bucket", F.explode(F.array(bucket("issue_time"), bucket("issue_time") + 1)))
    t = t.withColumn("truth_bucket", bucket("obs_time"))
    bound = F.col("issue_time") + F.expr(f"INTERVAL {int(max_lead_min)} MINUTES")
    inside = (F.col("bucket") == F.col("truth_bucket")) & (F.col("obs_time") > F.col("issue_time")) & (F.col("obs_time") <= bound)
    return f.join(t, inside).drop("bucket", "truth_bucket").where(F.unix_micros(F.col("obs_time").cast("timestamp")) <= F.unix_micros(F.col("issue_time").cast("timestamp")) + F.col("lead_min").cast("long") * 60_000_000)


#: Blocks of time in the longest lead.
LEAD_BLOCKS = 24
#: Most ids of a block that one row carries while pairs are spread.
SLOT_IDS = 512


def _width_s(max_lead_min: int) -> int:
    return max(1, max_lead_min * 60 // LEAD_BLOCKS)


def _blocks(forecasts: DataFrame, truths: DataFrame, max_lead_min: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """(issue_block, lead_min) and (obs_block), the starts of the blocks that times lie in, each with a struct ``_one`` of what is named and the time."""
    width = _width_s(max_lead_min)

    def of(rows: DataFrame, time: str, block: str, *kept: str) -> DataFrame:
        at = F.col(time).cast("timestamp")
        start = F.timestamp_seconds(F.floor(F.unix_seconds(at) / width) * width)
        return rows.select(start.alias(block), *kept, F.struct(*[F.col(c) for c in more if c in rows.columns], F.unix_micros(at).alias("at")).alias("_one"))

    return of(forecasts, "issue_time", "issue_block", "lead_min"), of(truths, "obs_time", "obs_block")


def block_pairs_stream(forecasts: DataFrame, truths: DataFrame, max_lead_min: int = 120, delay: str = "3 hours") -> DataFrame:
    """(issue_block, lead_min, obs_block), each once: blocks of time, ``LEAD_BLOCKS`` in the longest lead, that can hold pairs of ``pair_stream``.

    Both sides are made distinct as streams before they are joined, within their watermarks, so that the state of the join and its
    rows follow the span of time, however many forecasts and truths it has: a block meets one more than its lead has, and its own.
    """
    width, (f, t) = _width_s(max_lead_min), _blocks(forecasts, truths, max_lead_min)
    f = f.drop("_one").withWatermark("issue_block", delay).dropDuplicates(["issue_block", "lead_min"])
    t = t.drop("_one").withWatermark("obs_block", delay).dropDuplicates(["obs_block"])
    reach = max_lead_min * 60 + width
    bucket = lambda c: F.floor(F.unix_seconds(c) / reach)
    f = f.withColumn("bucket", F.explode(F.array(bucket("issue_block"), bucket("issue_block") + 1)))
    t = t.withColumn("truth_bucket", bucket("obs_block"))
    meets = (F.col("bucket") == F.col("truth_bucket")) & (F.col("obs_block") >= F.col("issue_block")) & (F.col("obs_block") < F.col("issue_block") + F.expr(f"INTERVAL {reach} SECONDS"))
    return f.join(t, meets).drop("bucket", "truth_bucket").where(F.unix_seconds("obs_block") < F.unix_seconds("issue_block") + F.col("lead_min").cast("long") * 60 + width)


def spread_blocks(blocks: DataFrame, forecasts: DataFrame, truths: DataFrame, max_lead_min: int = 120) -> DataFrame:
    """(forecast_id, truth_id) of all pairs of ``pair_stream`` in the pairs of blocks.

    Ids come in slices and are paired row by row, where they lie: as they are where every truth of a block is in the window of every
    forecast of the other, by their times at the borders of the window.
    """
    width, tasks = _width_s(max_lead_min), many_tasks(blocks.sparkSession)
    f, t = _blocks(forecasts, truths, max_lead_min, "forecast_id", "truth_id")

    def sliced(rows: DataFrame, block: list[str], ones: str) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / SLOT_IDS).cast("int").alias("_parts"))
        part = F.pmod(F.xxhash64("_one"), F.col("_parts")).cast("int").alias("_part")
        return sizes, rows.join(sizes, block).select(*block, "_one", part).groupBy(*block, "_part").agg(F.collect_list("_one").alias(ones))

    t_sizes, t = sliced(t, ["obs_block"], "_truths")
    f = sliced(f, ["issue_block", "lead_min"], "_forecasts")[1].drop("_part")
    met = blocks.join(t_sizes, "obs_block").select("issue_block", "lead_min", "obs_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    met = met.join(f, ["issue_block", "lead_min"]).repartition(tasks, "obs_block", "_part").join(t.repartition(tasks, "obs_block", "_part"), ["obs_block", "_part"])
    lead = F.least(F.col("lead_min").cast("long"), F.lit(max_lead_min).cast("long")) * 60
    apart = F.unix_seconds("obs_block") - F.unix_seconds("issue_block")
    met = met.select(((apart >= width) & (apart + width <= lead)).alias("_all"), (lead * 1_000_000).alias("_lead"), "_forecasts", F.col("_truths.truth_id").alias("_ids"), F.col("_truths.at").alias("_at"))
    each = met.select("_all", "_lead", F.explode("_forecasts").alias("_f"), "_ids", "_at")
    later = lambda i: F.col("_at")[i] - F.col("_f.at")
    ids = F.when(F.col("_all"), F.col("_ids")).otherwise(F.filter("_ids", lambda _, i: (later(i) > 0) & (later(i) <= F.col("_lead"))))
    return each.select(F.col("_f.forecast_id").alias("forecast_id"), F.explode(ids).alias("truth_id"))


#: Parts that a manifest is dealt into by a hash of its key.
MANIFEST_PARTS = 64


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a location."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _index(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """Version of every part that holds rows, as the last batch committed (before the given one) left it."""
    numbers = [int(n[1:]) for n in _children(spark, f"{root}/index") if n.startswith("v") and "_SUCCESS" in _children(spark, f"{root}/index/{n}")]
    numbers = [n for n in numbers if before is None or n < before]
    return {r.part: r.version for r in spark.read.parquet(f"{root}/index/v{max(numbers)}").collect()} if numbers else {}  # a row per part


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest as the last batch left it; None before the first."""
    held = _index(spark, root)
    return spark.read.parquet(*[f"{root}/data/v{v}/part={p}" for p, v in sorted(held.items())]) if held else None


def ingest_stream(checked: DataFrame, manifest_path: str, quarantine_path: str, checkpoint: str, parts: int = MANIFEST_PARTS) -> StreamingQuery:
    """Merge accepted rows of a checked stream into the manifest, and append the others to the quarantine.

    The manifest is dealt into parts by a hash of its key. A batch rewrites the parts that it has rows of, under its number, and
    then commits an index that names the version of every part. A batch that runs again starts from the index of the batch
    before it and writes its own version again, so a restart does not count an arrival twice. Versions that neither this index nor
    the one before names are deleted after the commit: a reader has the time of a batch to finish.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            rows.where("reason is not null").write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
            part = F.pmod(F.xxhash64(MANIFEST_KEY), F.lit(parts)).cast("int")
            new = rows.where("reason is null").withColumn("part", part)
            touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``parts``
            held = _index(spark, manifest_path, number)
            known = [f"{manifest_path}/data/v{held[p]}/part={p}" for p in sorted(touched) if p in held]
            if touched:
                merged = merge_manifest(spark.read.parquet(*known) if known else None, new)
                merged.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{manifest_path}/data/v{number}")
            after = held | {p: number for p in touched}
            index = spark.createDataFrame(sorted(after.items()), "part int, version long")
            index.coalesce(1).write.mode("overwrite").parquet(f"{manifest_path}/index/v{number}")
            _forget(spark, manifest_path, number, {*held.items(), *after.items()})
        finally:
            rows.unpersist()

    return checked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, root: str, number: int, named: set[tuple[int, int]]) -> None:
    """Delete parts of committed batches that no pair (part, version) names, and indexes before the last two."""
    for version in _children(spark, f"{root}/data"):
        if not version.startswith("v") or int(version[1:]) > number:
            continue
        inner = [p for p in _children(spark, f"{root}/data/{version}") if p.startswith("part=")]
        gone = [p for p in inner if (int(p[5:]), int(version[1:])) not in named]
        for p in ([""] if len(gone) == len(inner) else gone):
            fs, at = _path(spark, f"{root}/data/{version}/{p}".rstrip("/"))
            fs.delete(at, True)
    for n in _children(spark, f"{root}/index"):
        if n.startswith("v") and int(n[1:]) < number - 1:
            fs, at = _path(spark, f"{root}/index/{n}")
            fs.delete(at, True)


STATE = "next_id int, active array<struct<track_id: string, x: double, y: double, area: int, peak: double, cells: array<int>, age: int, missed: int, parents: array<string>>>"


def track_stream(detections: DataFrame, domain: str = "domain", time: str = "frame_time", **options) -> DataFrame:
    """Tracks as frames arrive: the state of a domain is its active tracks and the next number.

    Frames of a domain must arrive in time order across batches; within one batch they are put in order.
    """
    types = {f.name: f.dataType.simpleString() for f in detections.schema.fields}
    schema = f"`{domain}` {types[domain]}, `{time}` {types[time]}, {TRACKS}"

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = TrackerState()
        if held.exists:
            next_id, active = held.get
            state = TrackerState(next_id, [Track(a[0], a[1], a[2], a[3], a[4], frozenset(a[5]), a[6], a[7], tuple(a[8])) for a in active])
        rows = pd.concat(list(frames))
        out = []
        for at, frame in rows.groupby(time, sort=True):
            state, found = track_step(state, detections_of(frame), **options)
            out += [{domain: key[0], time: at, **f} for f in found]
        held.update((state.next_id, [(t.track_id, t.x, t.y, t.area, t.peak, sorted(t.cells), t.age, t.missed, list(t.parents)) for t in state.active]))
        names = [domain, time, "track_id", "x", "y", "area_cells", "max_value", "lifecycle", "age_frames", "missed", "parents"]
        yield pd.DataFrame(out, columns=names)

    return detections.groupBy(domain).applyInPandasWithState(update, schema, STATE, "append", GroupStateTimeout.NoTimeout)
