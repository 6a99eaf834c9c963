"""Storm objects: detection, tracking and arrival windows.

Detection works frame by frame, tracking domain by domain over frames in time order, arrival issue by issue and member by
member. Each is a grouped kernel on bounded groups; everything around them - overlaps, windows, survival - is relational.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogline.functions.numeric import at_least, quantile_higher
from fogline.functions.tables import many_tasks

DETECTION = "object int, area_cells int, max_value double, centroid_x double, centroid_y double, row_min int, row_max int, col_min int, col_max int, cells array<int>"
MIN_AREA = 8


def components(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Label of each cell, equal for cells that touch by side or corner; labels follow row-major order of first cells."""
    order = np.lexsort((cols, rows))
    at = {(int(rows[i]), int(cols[i])): k for k, i in enumerate(order)}
    parent = list(range(len(order)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for (r, c), k in at.items():
        for dr, dc in ((0, -1), (-1, -1), (-1, 0), (-1, 1)):  # neighbours that come earlier in row-major order
            j = at.get((r + dr, c + dc))
            if j is not None:
                a, b = root(k), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    labels = np.empty(len(order), dtype=np.int64)
    labels[order] = [root(k) for k in range(len(order))]
    return labels


def detect_objects(cells: DataFrame, threshold: float, nx: int, keys: Sequence[str], min_area: int = MIN_AREA) -> DataFrame:
    """Connected areas at or above the threshold with at least ``min_area`` cells, per frame (``keys``).

    ``cells`` lists row * nx + col. Only cells above the threshold are shuffled to the kernel, so a group holds at most one
    frame's active cells.
    """
    active = cells.where(at_least(F.col("value"), threshold)).select(*keys, "row", "col", F.col("value").cast("double").alias("value"))
    fields = [f for f in active.schema.fields if f.name in keys]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, c, v = frame["row"].to_numpy(), frame["col"].to_numpy(), frame["value"].to_numpy()
        labels = components(r, c)
        out = []
        by_label = np.argsort(labels, kind="stable")
        for m in np.split(by_label, np.flatnonzero(np.diff(labels[by_label])) + 1):
            if len(m) < min_area:
                continue
            rr, cc = r[m], c[m]
            out.append([*(frame[k].iloc[0] for k in keys), len(out), len(m), float(v[m].max()), float(cc.mean()), float(rr.mean()), int(rr.min()), int(rr.max()), int(cc.min()), int(cc.max()), np.sort(rr * nx + cc).tolist()])
        return pd.DataFrame(out, columns=[*keys, "object", "area_cells", "max_value", "centroid_x", "centroid_y", "row_min", "row_max", "col_min", "col_max", "cells"])

    return active.groupBy(*keys).applyInPandas(run, f"{key_ddl}, {DETECTION}")


#: Most ids that one row carries while pairs of objects are made.
SLICE = 512
#: Most rows of a side that meet at one cell in one group of the join.
CELL_ROWS = 8192
#: Words of 64 bits that the cells before a cell are hashed to.
WORDS = 8


def _alike(objects: DataFrame, keys: Sequence[str], side: str, tasks: int) -> DataFrame:
    """(keys, cells, side_ids): objects with the same cells as one, their ids in slices; cells are distinct and in order."""
    known = F.filter(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cells")))), lambda c: c.isNotNull())
    each = objects.groupBy(*keys, "id").agg(known.alias("cells")).where(F.size("cells") > 0)
    of = each.groupBy(*keys, "cells").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("_parts"))
    members = each.join(of, [*keys, "cells"]).select(*keys, "id", "cells", F.pmod(F.xxhash64("id"), F.col("_parts")).alias("_part"))
    ids = F.transform(F.collect_list(F.struct("id")), lambda x: x["id"])  # null ids too
    return members.repartition(tasks, *keys, "cells", "_part").groupBy(*keys, "cells", "_part").agg(ids.alias(f"{side}_ids")).drop("_part")


def _at_cells(alike: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """A row per cell: (keys, _cell, side_ids, side_before with the cells before it, side_bits with their hashes)."""
    rows = alike.select(*keys, f"{side}_ids", "cells", F.posexplode("cells").alias("_nth", "_cell"))
    rows = rows.select(*keys, "_cell", f"{side}_ids", F.slice("cells", 1, F.col("_nth")).alias(f"{side}_before"))
    places = F.transform(f"{side}_before", lambda c: F.pmod(F.xxhash64(c), F.lit(64 * WORDS)).cast("int"))

    def word(w: int) -> Column:
        inside = F.filter("_places", lambda p: F.shiftright(p, 6) == w)
        return F.aggregate(inside, F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)))

    return rows.withColumn("_places", places).withColumn(f"{side}_bits", F.struct(*[word(w).alias(f"w{w}") for w in range(WORDS)])).drop("_places")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a_id, b_id) of objects (id, cells) that share a cell.

    Objects with the same cells are compared as one. Two of them meet at every cell that they share and become a pair at the
    first of these only, so pairs need no shuffle to be distinct: what is shuffled is a row per object and cell. Where a cell
    has many rows, both sides come in slices. Ids are paired last, row by row, where they lie.
    """
    tasks = many_tasks(a.sparkSession)
    wide = a.select("cells").union(b.select("cells")).schema["cells"].dataType  # cells of both sides must hash alike
    x, y = (_at_cells(_alike(o.withColumn("cells", F.col("cells").cast(wide)), keys, side, tasks), keys, side) for o, side in ((a, "_a"), (b, "_b")))
    cell = [*keys, "_cell"]

    def crowded(rows: DataFrame, parts: str) -> DataFrame:
        return rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias(parts)).where(f"{parts} > 1")  # a row for so many rows at least

    def dealt(rows: DataFrame, ids: str, own: str, other: str) -> DataFrame:
        rows = rows.join(F.broadcast(a_parts), cell, "left").join(F.broadcast(b_parts), cell, "left").fillna(1, ["_a_part", "_b_part"])
        return rows.withColumn(own, F.pmod(F.xxhash64(ids), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).repartition(tasks, *cell, "_a_part", "_b_part")

    a_parts, b_parts = crowded(x, "_a_part"), crowded(y, "_b_part")
    x, y = dealt(x, "_a_ids", "_a_part", "_b_part"), dealt(y, "_b_ids", "_b_part", "_a_part")
    meet = [*cell, "_a_part", "_b_part"]
    y = y.select(*[F.col(c).alias(f"_of_{c}") for c in meet], "_b_ids", "_b_before", "_b_bits")
    apart = reduce(and_, [F.col(f"_a_bits.w{w}").bitwiseAND(F.col(f"_b_bits.w{w}")) == 0 for w in range(WORDS)])
    first = apart | ~F.arrays_overlap("_a_before", "_b_before")
    slices = x.join(y, reduce(and_, [F.col(c) == F.col(f"_of_{c}") for c in meet]) & first).select(*keys, "_a_ids", "_b_ids")
    return slices.select(*keys, F.explode("_a_ids").alias("a_id"), "_b_ids").select(*keys, "a_id", F.explode("_b_ids").alias("b_id"))


def assign_min_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column at most once (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, came, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            seen[j0] = True
            free = ~seen[1:]
            slack = c[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[j1]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[came[j0]], came[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assign_greedy(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest pair first, each row and column at most once."""
    rows, cols, out = set(), set(), []
    for flat in np.argsort(cost, axis=None, kind="stable"):
        r, c = divmod(int(flat), cost.shape[1])
        if r not in rows and c not in cols:
            rows.add(r)
            cols.add(c)
            out.append((r, c))
    return out


@dataclass
class Track:
    track_id: str
    x: float
    y: float
    area: int
    peak: float
    cells: frozenset
    age: int = 1
    missed: int = 0
    parents: tuple[str, ...] = ()


@dataclass
class TrackerState:
    """What the tracker carries from frame to frame."""

    next_id: int = 1
    active: list[Track] = field(default_factory=list)


@dataclass(frozen=True)
class Detection:
    x: float
    y: float
    area: int
    peak: float
    cells: frozenset


ASSIGNMENTS = {"hungarian": assign_min_cost, "greedy": assign_greedy}


def track_step(state: TrackerState, found: Sequence[Detection], motion=None, km_per_cell: float = 2.0, gate_km: float = 30.0, assignment: str = "hungarian") -> tuple[TrackerState, list[dict]]:
    """One frame of tracking; returns the new state and the rows to report.

    Pairs are assigned by distance, area and peak change, and the gate is applied after that. A track that is not seen once
    is kept as Decaying and not reported; the second time it is reported as Dissipated and ends. ``motion(x, y)`` moves a
    track before it is compared.
    """
    if km_per_cell <= 0 or gate_km <= 0:
        raise ValueError("km_per_cell and gate_km must be positive")
    before = state.active
    match: dict[int, int] = {}
    if before and found:
        spots = [(t.x + (d := motion(t.x, t.y) if motion else (0.0, 0.0))[0], t.y + d[1]) for t in before]
        km = np.array([[math.hypot(px - d.x, py - d.y) * km_per_cell for d in found] for px, py in spots])
        area = np.array([[abs(math.log((d.area + 1) / (t.area + 1))) for d in found] for t in before])
        peak = np.array([[abs(d.peak - t.peak) / 10 for d in found] for t in before])
        for r, c in ASSIGNMENTS[assignment](km / gate_km + 0.5 * area + 0.3 * peak):
            if km[r, c] <= gate_km:
                match[c] = r
    out, alive, next_id = [], [], state.next_id
    for c, d in enumerate(found):
        old = before[match[c]] if c in match else None
        touching = {t.track_id for t in before if t.cells & d.cells}
        if old is None:
            track_id, age = f"T{next_id:06d}", 1
            next_id += 1
        else:
            track_id, age = old.track_id, old.age + 1
        if age == 1:
            phase = "Candidate"
        elif d.peak >= 45:
            phase = "Mature"
        elif d.peak <= old.peak - 5 and d.area < old.area:
            phase = "Decaying"
        else:
            phase = "Developing"
        alive.append(Track(track_id, d.x, d.y, d.area, d.peak, d.cells, age, 0, tuple(sorted(touching - {track_id}))))
        out.append({"track_id": track_id, "x": d.x, "y": d.y, "area_cells": d.area, "max_value": d.peak, "lifecycle": phase, "age_frames": age, "missed": 0, "parents": sorted(touching - {track_id})})
    for r, t in enumerate(before):
        if r in match.values():
            continue
        if t.missed + 1 >= 2:
            out.append({"track_id": t.track_id, "x": t.x, "y": t.y, "area_cells": t.area, "max_value": t.peak, "lifecycle": "Dissipated", "age_frames": t.age, "missed": t.missed + 1, "parents": list(t.parents)})
        else:
            alive.append(replace(t, missed=t.missed + 1))
    return TrackerState(next_id, alive), out


TRACKS = "track_id string, x double, y double, area_cells int, max_value double, lifecycle string, age_frames int, missed int, parents array<string>"
_TRACK_COLUMNS = ["track_id", "x", "y", "area_cells", "max_value", "lifecycle", "age_frames", "missed", "parents"]


def detections_of(frame: pd.DataFrame) -> list[Detection]:
    ordered = frame.sort_values("object")
    return [Detection(r.centroid_x, r.centroid_y, int(r.area_cells), float(r.max_value), frozenset(map(int, r.cells))) for r in ordered.itertuples() if r.object is not None and not pd.isna(r.object)]


def track_segments(detections: DataFrame, domain: str = "domain", time: str = "frame_time") -> DataFrame:
    """(domain, time, segment) of every frame: a new segment begins after two frames without an object, where no track goes on."""
    frames = detections.groupBy(domain, time).agg((F.count("object") == 0).alias("_empty"))
    order = Window.partitionBy(domain).orderBy(time)  # a row per frame
    cut = F.coalesce(F.lag("_empty", 1).over(order) & F.lag("_empty", 2).over(order), F.lit(False))
    return frames.withColumn("_cut", cut).select(domain, time, F.sum(F.col("_cut").cast("int")).over(order).cast("int").alias("segment"))


def track_objects(detections: DataFrame, domain: str = "domain", time: str = "frame_time", motion: DataFrame | None = None, **options) -> DataFrame:
    """Tracks of every domain over its frames in time order.

    Detections are those of ``detect_objects``; a frame without objects is a row with a null ``object``. ``motion`` (domain,
    time, row, col, u, v) is looked up at a track's last centroid; only cells that some centroid falls on are shuffled.

    A domain is cut where no track can go on, and each segment is tracked by itself; its numbers then go on from those given
    out before it. Weather without such a pause is one segment.
    """
    types = {f.name: f.dataType.simpleString() for f in detections.schema.fields}
    schema = f"`{domain}` {types[domain]}, segment int, `{time}` {types[time]}, {TRACKS}"

    def run(rows: pd.DataFrame, winds: pd.DataFrame | None) -> pd.DataFrame:
        state, out = TrackerState(), []
        by_time = {t: {(int(w.row), int(w.col)): (w.u, w.v) for w in g.itertuples()} for t, g in winds.groupby(time)} if winds is not None and len(winds) else {}
        for t, frame in rows.groupby(time, sort=True):
            here = by_time.get(t)
            look = (lambda x, y, here=here: here.get((round(y), round(x)), (0.0, 0.0))) if here else None
            state, found = track_step(state, detections_of(frame), look, **options)
            out += [[rows[domain].iloc[0], rows["segment"].iloc[0], t, *(f[c] for c in _TRACK_COLUMNS)] for f in found]
        return pd.DataFrame(out, columns=[domain, "segment", time, *_TRACK_COLUMNS])

    segments = track_segments(detections, domain, time)
    placed = detections.drop("segment").join(segments, [domain, time])
    if motion is None:
        tracked = placed.groupBy(domain, "segment").applyInPandas(lambda rows: run(rows, None), schema)
    else:
        spots = detections.where("object is not null").select(domain, F.rint("centroid_y").cast("int").alias("row"), F.rint("centroid_x").cast("int").alias("col")).distinct()
        near = motion.drop("segment").join(spots, [domain, "row", "col"], "left_semi").join(segments, [domain, time])
        tracked = placed.groupBy(domain, "segment").cogroup(near.groupBy(domain, "segment")).applyInPandas(run, schema)
    born = ((F.col("age_frames") == 1) & (F.col("lifecycle") == "Candidate")).cast("long")
    earlier = Window.partitionBy(domain).orderBy("segment").rangeBetween(Window.unboundedPreceding, -1)
    numbered = tracked.withColumn("_before", F.coalesce(F.sum(born).over(earlier), F.lit(0)))
    number = lambda c, before: F.format_string("T%06d", F.substring(c, 2, 20).cast("long") + before)
    parents = F.array_sort(F.transform("parents", lambda p: number(p, F.col("_before"))))
    return numbered.withColumns({"track_id": number(F.col("track_id"), F.col("_before")), "parents": parents}).drop("segment", "_before")


def lineage(tracks: DataFrame) -> DataFrame:
    """(parent, child, kind) edges from the parents that tracks report."""
    return tracks.select(F.explode("parents").alias("parent"), F.col("track_id").alias("child"), F.lit("split_or_merge").alias("kind"))


def first_hit(cells: Iterable[int], u: np.ndarray, v: np.ndarray, target: tuple[float, float, float], steps: int) -> int | None:
    """First step at which the moved footprint has a cell within the radius (in cells) of the target; None within ``steps``."""
    ny, nx = u.shape
    yy, xx = np.indices((ny, nx))
    sr, sc = np.rint(yy - v).astype(int), np.rint(xx - u).astype(int)
    inside = (sr >= 0) & (sr < ny) & (sc >= 0) & (sc < nx)
    moving = np.zeros(ny * nx, dtype=bool)
    moving[list(cells)] = True
    moving = moving.reshape(ny, nx)
    near = (xx - target[0]) ** 2 + (yy - target[1]) ** 2 <= target[2] ** 2
    for step in range(1, steps + 1):
        moving = np.where(inside, moving[np.clip(sr, 0, ny - 1), np.clip(sc, 0, nx - 1)], False)
        if (moving & near).any():
            return step
        if not moving.any():
            return None
    return None


def arrival_times(storms: DataFrame, targets: DataFrame, motion: DataFrame, shape: tuple[int, int], steps: int = 36, step_minutes: int = 10, km_per_cell: float = 2.0, parts: int = 64) -> DataFrame:
    """(track_id, target_id, radius_km, member, minutes): arrival per storm, target and member, null without one.

    ``storms`` (track_id, cells), ``targets`` (target_id, x, y, radius_km), ``motion`` (member, row, col, u, v). One member's
    motion field and one of ``parts`` shares of the storms make up a group, so a member's storms are not one task.
    """
    ny, nx = shape
    members = motion.select(F.col("member").alias("_member")).distinct()
    tasks = storms.select("track_id", "cells").crossJoin(F.broadcast(targets.select("target_id", "x", "y", "radius_km"))).crossJoin(members)  # storms x targets x members are the rows asked for
    tasks = tasks.withColumn("member", F.col("_member")).drop("_member").withColumn("part", F.pmod(F.xxhash64("track_id"), F.lit(parts)))
    winds = motion.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))  # a field is bounded by its grid
    winds = winds.join(F.broadcast(tasks.select("member", "part").distinct()), ["member", "part"], "left_semi")

    def run(asked: pd.DataFrame, wind: pd.DataFrame) -> pd.DataFrame:
        u, v = np.zeros((ny, nx)), np.zeros((ny, nx))
        u[wind["row"], wind["col"]], v[wind["row"], wind["col"]] = wind["u"], wind["v"]
        out = []
        for r in asked.itertuples():
            hit = first_hit(r.cells, u, v, (r.x, r.y, r.radius_km / km_per_cell), steps)
            out.append((r.track_id, r.target_id, r.radius_km, r.member, None if hit is None else hit * step_minutes))
        return pd.DataFrame(out, columns=["track_id", "target_id", "radius_km", "member", "minutes"]).astype({"minutes": "Int64"})

    return tasks.groupBy("member", "part").cogroup(winds.groupBy("member", "part")).applyInPandas(run, "track_id string, target_id string, radius_km double, member int, minutes long")


def decay_probability(durations: DataFrame, cutoffs: DataFrame, duration: str = "duration_min") -> DataFrame:
    """Share of positive durations at or below each cut-off of (key, cutoff).

    Durations are counted by hour first, so that only the hours pass through one window; within an hour each has its own.
    """
    positive = durations.where(F.col(duration) > 0).select(F.col(duration).alias("_d"))
    sizes = positive.agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") == 0, F.raise_error(F.lit("at least one positive duration is required")).cast("long")).otherwise(F.col("_n")).alias("_n"))
    points = cutoffs.select("key", F.col("cutoff").cast("double").alias("at"))
    steps = positive.groupBy(F.col("_d").cast("double").alias("at")).agg(F.count(F.lit(1)).alias("k"))
    merged = steps.select("at", "k", F.lit(None).cast("string").alias("key"), F.lit(0).alias("asks")).unionByName(points.select("at", F.lit(0).cast("long").alias("k"), "key", F.lit(1).alias("asks")))
    merged = merged.withColumn("hour", F.floor(F.col("at") / 60))
    hours = merged.groupBy("hour").agg(F.sum("k").alias("_k"))
    earlier = hours.select("hour", F.coalesce(F.sum("_k").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    upto = Window.partitionBy("hour").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    within = merged.withColumn("within", F.sum("k").over(upto)).where("asks = 1")
    counted = within.join(earlier, "hour").withColumn("below", F.col("within") + F.col("earlier"))
    return counted.crossJoin(F.broadcast(sizes)).select("key", (F.col("below") / F.col("_n")).alias("p_decay"))


def arrival_windows(times: DataFrame, decay: DataFrame | None = None) -> DataFrame:
    """Per storm and target: probability, t10, t50 and t90 by the higher rule, and the decay probability (0 without one)."""
    grouped = times.groupBy("track_id", "target_id", "radius_km").agg(F.collect_list("minutes").alias("at"), F.count(F.lit(1)).alias("members"))  # one entry per member
    out = grouped.select("track_id", "target_id", "radius_km", (F.size("at") / F.col("members")).alias("p_arrival"), *[quantile_higher(F.col("at"), q).alias(n) for n, q in (("t10", 0.1), ("t50", 0.5), ("t90", 0.9))])
    if decay is None:
        return out.withColumn("p_decay", F.lit(0.0))
    return out.join(decay.select(F.col("key").alias("track_id"), "p_decay"), "track_id", "left").withColumn("p_decay", F.coalesce("p_decay", F.lit(0.0)))
