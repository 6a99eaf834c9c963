"""Sharding by size-tiered compaction.

Arrivals are appended as runs of small immutable shards. Runs of like size form a tier; when a tier holds ``fan_in`` runs,
they are merged into one run of shards of about the target size, which belongs to a higher tier. Every change writes the
list of live shards as a new manifest and commits it by one rename that fails if that version exists, so readers see either
the old set of shards or the new one. A writer that loses the race takes the winner's manifest as its base and commits again: what it
has written is kept. Shards are never changed; ``vacuum`` deletes those that only old versions name, once these are old enough
for their readers to be done. What no version has named yet belongs to a writer at work and is left alone.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TARGET_BYTES, SMALL_BYTES, FAN_IN = 128 << 20, 8 << 20, 4
#: Seconds for which readers of a replaced version are given time, and after which a run that no version names is an orphan.
READER_S, ORPHAN_S = 3600.0, 7 * 86400.0
#: Commits that a writer tries; each failure means that another writer has succeeded.
TRIES = 100


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    """Shards that were written together."""

    name: str
    bytes: int
    shards: int

    def tier(self, small: int, fan_in: int) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / small, fan_in)))


class ShardStore:
    """Shards under ``root``: data/<run>/*.parquet, and manifests/v<number>.json naming the live runs."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.small_bytes, self.fan_in = target_bytes, small_bytes, fan_in
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def version(self) -> int:
        """Number of the last committed manifest; 0 before the first."""
        at = self._path("manifests")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        if not self._fs.exists(self._path("manifests", f"v{version:08d}.json")):
            raise ValueError(f"version {version} is not there any more")
        stream = self._fs.open(self._path("manifests", f"v{version:08d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], base: int) -> int:
        """Make ``runs`` version ``base`` + 1, or raise CommitConflict if there is one."""
        new = base + 1
        draft, final = self._path("manifests", f".draft-{self.spark._jvm.java.util.UUID.randomUUID()}"), self._path("manifests", f"v{new:08d}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps({"version": new, "runs": [r.__dict__ for r in runs]}).encode())
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else self._hadoop.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(draft, final, options)  # without OVERWRITE: fails if the version exists
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {new} exists") from e
            raise
        return new

    def _measure(self, name: str) -> Run | None:
        """Size of a finished run from its files; None if nothing was written."""
        at = self._path("data", name)
        sizes = [s.getLen() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".parquet")] if self._fs.exists(at) else []
        return Run(name, sum(sizes), len(sizes)) if sizes else None

    def _fresh(self, kind: str) -> str:
        return f"{kind}-{self.spark._jvm.java.util.UUID.randomUUID().toString()[:13]}"

    def _change(self, change: Callable[[list[Run]], list[Run] | None]) -> int | None:
        """Commit what ``change`` makes of the last version's runs; after a lost race, of those of the version that won. None if
        ``change`` has nothing to make of them."""
        for _ in range(TRIES):
            base = self.version()
            runs = change(self.runs(base))
            if runs is None:
                return None
            try:
                return self.commit(runs, base)
            except CommitConflict:
                continue
        raise CommitConflict(f"{TRIES} commits lost against other writers")

    def append(self, docs: DataFrame) -> int:
        """Add one arrival as a run of small shards: a shard per partition of ``docs``, nothing is shuffled."""
        name = self._fresh("run")
        docs.write.parquet(f"{self.root}/data/{name}")
        return self.add([run] if (run := self._measure(name)) else [])

    def add(self, new: list[Run]) -> int:
        """Commit runs that have been written."""
        return self._change(lambda runs: [*runs, *new])

    def stage_many(self, docs: DataFrame, arrival: str) -> list[Run]:
        """Write several arrivals in one pass, without a commit: one run for each value of the column ``arrival``, which is not
        stored, in the order of the values."""
        name = self._fresh("runs")
        docs.write.partitionBy(arrival).parquet(f"{self.root}/data/{name}")
        at = self._path("data", name)
        parts = [s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()] if self._fs.exists(at) else []
        return [r for p in sorted(parts) if (r := self._measure(f"{name}/{p}"))]

    def append_many(self, docs: DataFrame, arrival: str) -> int:
        """Add several arrivals with one pass and one commit."""
        return self.add(self.stage_many(docs, arrival))

    def read_runs(self, runs: list[Run]) -> DataFrame:
        """Rows of several runs. A column that some runs lack is null there; one of two types raises."""
        paths = [f"{self.root}/data/{r.name}" for r in runs]
        schemas = {self.spark.read.parquet(p).schema.json(): p for p in paths}
        if len(schemas) == 1:
            return self.spark.read.parquet(*paths)
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def compact(self) -> int:
        """Merge full tiers until none is left; returns the version.

        A merge reads small shards side by side and writes as many shards as the target size asks for. Partitions are
        joined and not shuffled, so a merge costs one read and one write of its runs.
        """
        while True:
            base = self.version()
            runs = self.runs(base)
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(r.tier(self.small_bytes, self.fan_in), []).append(r)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)
            if full is None:
                return base
            shards = max(1, round(sum(r.bytes for r in full) / self.target_bytes))
            name = self._fresh("merged")
            self.read_runs(full).coalesce(shards).write.parquet(f"{self.root}/data/{name}")
            merged, names = self._measure(name), {r.name for r in full}

            def swap(runs: list[Run], merged=merged, names=names) -> list[Run] | None:
                if not names <= {r.name for r in runs}:  # another writer merged some of them meanwhile
                    return None
                return [*[r for r in runs if r.name not in names], *([merged] if merged else [])]

            if self._change(swap) is None:
                self._fs.delete(self._path("data", name), True)

    def _age(self, path) -> float:
        return time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000

    def vacuum(self, reader_s: float = READER_S, orphan_s: float = ORPHAN_S) -> None:
        """Drop versions that were replaced at least ``reader_s`` seconds ago, and the runs that only they name; and runs that no
        version has named for ``orphan_s`` seconds, which a writer that died has left."""
        last, at = self.version(), self._path("data")
        numbers = [n for n in range(1, last + 1) if self._fs.exists(self._path("manifests", f"v{n:08d}.json"))]
        old = [n for n in numbers if n < last and self._age(self._path("manifests", f"v{n + 1:08d}.json")) >= reader_s]  # replaced by the next
        live = {r.name for n in numbers if n not in old for r in self.runs(n)}
        gone = {r.name for n in old for r in self.runs(n)} - live
        for n in old:  # first the manifest, so that no reader begins
            self._fs.delete(self._path("manifests", f"v{n:08d}.json"), False)
        for name in gone:
            self._fs.delete(self._path("data", *name.split("/")), True)
        for top in self._fs.listStatus(at) if self._fs.exists(at) else []:
            name = top.getPath().getName()
            inner = [f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(top.getPath()) if s.isDirectory()]
            for n in [n for n in (inner or [name]) if n not in live]:
                if self._age(self._path("data", *n.split("/"))) >= orphan_s:
                    self._fs.delete(self._path("data", *n.split("/")), True)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, each as a struct ``row``, with ``shard_file`` (the file that holds it) and ``shard_version``."""
        version = self.version() if version is None else version
        runs = self.runs(version)
        if not runs:
            raise ValueError("the store is empty")
        rows = self.read_runs(runs)
        file = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.*)$", 1)
        return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), file.alias("shard_file"), F.lit(version).cast("long").alias("shard_version"))


#: Arrivals that the table is dealt into, and shards whose numbers may be broadcast.
ARRIVALS, BROADCAST_SHARDS = 8, 100_000


def shard_documents(docs: DataFrame, root: str, id_col: str = "doc_id", arrivals: int = ARRIVALS, **sizes) -> DataFrame:
    """Append ``docs`` in ``arrivals`` arrivals, one commit each, merge full tiers after each, and read the last version back.

    All columns of ``docs`` come back, with shard (files in the order of their smallest id), shard_rows and version; columns of
    these names are replaced. Rows are dealt to arrivals by hash of id; null ids form part of arrival 0. Nulls, empty and very
    long texts and repeated rows are stored as they are. An empty table gives an empty result with the same columns. Arrivals are
    written in one pass. In a store that was empty, replaced runs go at once; in one that has readers, when these had their time.
    """
    names = [c for c in docs.columns if c not in ("shard", "shard_rows", "version")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    store = ShardStore(docs.sparkSession, root, **sizes)
    arrival = F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(arrivals)), F.lit(0)).cast("int")
    name = "arrival"
    while name in names:
        name += "_"
    fresh = store.version() == 0
    for run in store.stage_many(kept.withColumn(name, arrival), name):
        store.add([run])
        store.compact()
    store.vacuum(0.0 if fresh else READER_S)
    if not store.runs():
        return kept.limit(0).select("*", F.lit(0).cast("int").alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("version"))
    rows = store.read()
    files = rows.groupBy("shard_file").agg(F.min(F.col("row").getField(id_col)).alias("low"), F.count(F.lit(1)).alias("shard_rows"))
    numbered = files.select(F.col("shard_file").alias("file"), "shard_rows", (F.row_number().over(Window.orderBy("low", "shard_file")) - 1).alias("shard"))
    if sum(r.shards for r in store.runs()) <= BROADCAST_SHARDS:
        numbered = F.broadcast(numbered)
    joined = rows.join(numbered, rows["shard_file"] == numbered["file"])
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], "shard", "shard_rows", F.col("shard_version").alias("version"))
