"""Labels from observations, areas by tile and derived channels against brute force."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.operators import bundle, derived, features, labelling, objects, tiles

T0 = datetime(2026, 5, 1)
POINT, EVENT = "point_id long, lat double, lon double, at timestamp, note string", "lat double, lon double, at timestamp"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("radius", [8.0, 300.0, 3000.0, 12000.0])
def test_matches_on_the_whole_globe_equal_brute_force(spark, radius):
    rng = np.random.default_rng(int(radius))
    where = lambda n: list(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, n))).tolist(), rng.uniform(-180, 180, n).tolist(), strict=True)) + [(90.0, 5.0), (-90.0, -170.0), (0.0, 180.0), (0.0, -180.0), (89.99, -40.0), (10.0, 179.999)]
    near = lambda rows: [(min(90, max(-90, a + rng.normal() * radius / 150)), (b + rng.normal() * radius / 150 + 180) % 360 - 180) for a, b in rows]
    points = where(60)
    events = where(40) + near(points)
    p = [(i, float(a), float(b), T0 + timedelta(minutes=int(rng.integers(0, 200))), "n") for i, (a, b) in enumerate(points)]
    e = [(float(a), float(b), T0 + timedelta(minutes=int(rng.integers(0, 200)))) for a, b in events]
    odd = [(900, None, 1.0, T0, "n"), (901, float("nan"), 1.0, T0, "n"), (902, 1.0, 1.0, None, "n")]
    found = {r.point_id: r.positive for r in labelling.has_match(spark.createDataFrame(p + odd, POINT), spark.createDataFrame([*e, (None, 1.0, T0), (float("nan"), 1.0, T0)], EVENT), radius, 45, 10).collect()}
    want = {i: any(km((a, b), x[:2]) <= radius and timedelta(minutes=-10) <= x[2] - t <= timedelta(minutes=45) for x in e) for i, a, b, t, _ in p}
    assert found == want | {900: False, 901: False, 902: False}
    assert any(want.values())


def test_a_band_around_the_globe_does_not_meet_itself(spark):
    globe = labelling._Globe(8.0)
    rows = spark.range(0, 3600).select(F.lit(45.0).alias("lat"), (F.col("id") / 10 - 180).alias("lon"))
    cells = rows.select("lon", F.explode(globe.around(F.col("lat"), F.col("lon"))).alias("c")).select("lon", "c.band", "c.bin")
    own = rows.select(globe.band(F.col("lat")).alias("band"), globe.bin(F.col("lon"), globe.bins(globe.band(F.col("lat")))).alias("bin"))
    assert cells.groupBy("lon").count().agg(F.max("count")).first()[0] <= 12
    assert cells.join(own, ["band", "bin"]).count() < 3600 * 12


def test_matches_of_empty_tables_and_limits(spark):
    points = spark.createDataFrame([(1, 10.0, 20.0, T0, "n")], POINT)
    events = spark.createDataFrame([(10.0, 20.0, T0 + timedelta(minutes=30))], EVENT)
    assert labelling.lightning_labels(points, events, 30).first().positive
    assert not labelling.lightning_labels(points, events, 29).first().positive
    assert not labelling.lightning_labels(points, events.limit(0), 30).first().positive
    assert labelling.lightning_labels(points.limit(0), events, 30).count() == 0
    assert labelling.lightning_labels(points, events, 30).columns == [*points.columns, "positive"]


def test_initiation_follows_the_lineage(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    echoes = spark.createDataFrame(
        [("a", at(0), 20.0), ("a", at(10), 36.0), ("a", at(60), 50.0), ("b", at(20), 10.0), ("b", at(30), 40.0), ("c", at(5), 10.0), ("c", at(40), None), ("d", at(50), float("nan")), ("e", at(90), 1.0), ("f", at(0), 40.0)],
        "track_id string, at timestamp, peak double",
    )
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("d", "a"), ("x", "e"), ("b", "b"), ("a", "b")], "parent string, child string")
    flashes = spark.createDataFrame([("c", at(45))], "track_id string, at timestamp")
    got = {r.track_id: (r.initiated, r.inherited) for r in labelling.initiations(echoes, edges, flashes).collect()}
    assert got == {"a": (at(10), False), "b": (at(10), True), "c": (at(45), False), "d": (at(10), True), "e": (at(45), True), "f": (at(0), False)}
    issues = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("c", at(20)), ("c", at(10)), ("zz", at(0))], "track_id string, at timestamp")
    rows = [(r.track_id, r.positive, r.already, r.lead_min) for r in labelling.initiation_labels(issues, labelling.initiations(echoes, edges, flashes), 30).orderBy("track_id", "at").collect()]
    assert rows == [("a", True, False, 10.0), ("a", False, True, None), ("c", False, False, None), ("c", True, False, 25.0), ("zz", False, False, None)]


def test_hourly_sums_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [("s" if i % 3 else "t", T0 + timedelta(seconds=int(rng.integers(0, 86_400)) // 600 * 600), float(rng.random())) for i in range(300)] + [("s", None, 1.0), ("s", T0, None), ("s", T0, float("nan")), ("s", T0, -4.0)]
    gauges = spark.createDataFrame(rows, "station string, at timestamp, mm double")
    for hours in (1, 6, 100):
        for r in labelling.hourly_sums(gauges, hours).collect():
            want = sum(v for s, t, v in rows if s == r.station and t and r.at - timedelta(hours=1) < t <= r.at and v is not None and v > 0)
            assert r.hour_mm == pytest.approx(want)
        assert labelling.hourly_sums(gauges, hours).count() == len(rows) - 1


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_areas_by_tile_are_those_of_whole_frames(spark, tile):
    rng = np.random.default_rng(6)
    rows = []
    for frame in range(4):
        grid = rng.random((23, 19)) + (frame - 1) * 0.15
        grid[5, :] = 9.0 if frame == 2 else grid[5, :]  # over all tiles of a row
        rows += [(f"f{frame}", r, c, float(grid[r, c])) for r in range(23) for c in range(19)]
    cells = spark.createDataFrame([*rows, ("nan", 0, 0, float("nan")), (None, 1, 1, 9.0), (None, 1, 2, 9.0)], "frame string, row int, col int, value double")
    by_frame = {(r.frame, r.object): r for r in objects.detect_objects(cells.where("frame is not null"), 0.6, 19, ["frame"], 2).collect()}
    by_tile = {(r.frame, r.object): r for r in tiles.detect_in_tiles(cells.where("frame is not null"), 0.6, 19, ["frame"], 2, tile).collect()}
    assert by_frame.keys() == by_tile.keys()
    for key, a in by_frame.items():
        b = by_tile[key]
        assert a.cells == b.cells and a.area_cells == b.area_cells and a.max_value == b.max_value and (a.row_min, a.row_max, a.col_min, a.col_max) == (b.row_min, b.row_max, b.col_min, b.col_max)
        assert a.centroid_x == pytest.approx(b.centroid_x) and a.centroid_y == pytest.approx(b.centroid_y)


def test_a_large_grid_is_many_tasks(spark):
    """800 x 800 cells with one area along its diagonal and one along an edge."""
    side = spark.range(800)
    near = side.select(F.explode(F.sequence(F.greatest(F.col("id") - 1, F.lit(0)), F.least(F.col("id") + 1, F.lit(799)))).alias("col"), F.col("id").alias("row"))
    edge = side.select(F.col("id").alias("col"), F.lit(799).cast("long").alias("row"))
    cells = near.union(edge).distinct().withColumn("value", F.lit(100.0)).withColumn("domain", F.lit("national"))
    found = tiles.cloudburst_areas(cells, 800, ["domain"]).collect()
    assert [r.area_cells for r in found] == [cells.count()]
    sizes = tiles.labelled_cells(cells, 100.0, 800, ["domain"]).groupBy(F.floor(F.col("row") / 64), F.floor(F.col("col") / 64)).count()
    assert sizes.count() > 30
    assert tiles.cloudburst_areas(cells.limit(0), 800, ["domain"]).count() == 0


CELLS = "domain string, channel string, row int, col int, at timestamp, value double, mask boolean, age_min double"


def test_rates_take_the_nearest_usable_frame(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("x", "ir", 0, 0, at(m), float(v), ok, 1.0) for m, v, ok in [(0, 10, True), (14, 20, True), (20, 99, False), (30, 40, True), (52, 50, True), (60, 70, None), (300, 1, True)]]
    cells = spark.createDataFrame([*rows, ("x", "ir", 0, 0, at(44), float("nan"), True, 1.0), ("y", "ir", 0, 0, at(15), 5.0, True, 1.0)], CELLS)
    out = derived.rates(cells, {"d": derived.Rate("ir", 15, 7.5, 15), "slow": derived.Rate("ir", 30, 10, 60)}, ["domain"])
    assert out.columns == cells.columns
    got = {(r.domain, r.channel, int((r.at - T0).total_seconds()) // 60): (r.value, r.mask) for r in out.collect()}
    assert got["x", "d", 14] == (pytest.approx(10 / 14 * 15), True) and got["x", "d", 30] == (pytest.approx(20 / 16 * 15), True)
    assert got["x", "d", 52] == (pytest.approx(10 / 22 * 15), True)
    assert got["x", "d", 20] == (0.0, False) and got["x", "d", 60] == (0.0, False) and got["x", "d", 300] == (0.0, False) and got["y", "d", 15] == (0.0, False)
    assert got["x", "slow", 30] == (pytest.approx(30 / 30 * 60), True)
    with pytest.raises(ValueError, match="tolerance"):
        derived.rates(cells, {"d": derived.Rate("ir", 5, 5)}, ["domain"])


def test_derived_channels_reach_the_contract_with_masks(spark):
    rows = [("x", c, 0, 0, T0, v, ok, a) for c, v, ok, a in [("a", 5.0, True, 1.0), ("b", 2.0, True, 9.0), ("u1", 3.0, True, 0.0), ("v1", 4.0, True, 0.0), ("u0", 0.0, True, 0.0), ("v0", 0.0, False, 0.0)]]
    cells = spark.createDataFrame([*rows, ("x", "a", 0, 1, T0, 5.0, True, 1.0), ("x", "other", 0, 2, T0, 1.0, True, 1.0)], CELLS)
    wanted = {"a_b": derived.Difference("a", "b"), "s": derived.Shear(("u1", "v1"), ("u0", "v0")), "s0": derived.Shear(("u1", "v1"), ("u0", "u0"))}
    out = derived.with_derived(cells, wanted, ["domain"])
    got = {(r.channel, r.col): (r.value, r.mask, r.age_min) for r in out.where("channel in ('a_b', 's', 's0')").collect()}
    assert got == {("a_b", 0): (3.0, True, 9.0), ("s", 0): (0.0, False, 0.0), ("s0", 0): (5.0, True, 0.0), ("a_b", 1): (0.0, False, 1.0), ("s", 1): (0.0, False, None), ("s0", 1): (0.0, False, None)}
    contract = features.FeatureContract(("a", "a_b"), (0.0, 1.0), (1.0, 2.0), (-9.0, -9.0), (9.0, 9.0))
    normal = {(r.channel, r.col): (r.valid, r.normal) for r in features.normalize(out, contract).collect()}
    assert normal["a_b", 0] == (True, 1.0) and normal["a_b", 1] == (False, 0.0)
    assert derived.with_derived(cells.limit(0), wanted, ["domain"]).count() == 0


CONTRACT = features.FeatureContract(("sat/ir1", "nwp/cape"), (220.0, 500.0), (10.0, 100.0), (100.0, 0.0), (400.0, 5000.0))
FRAMES = "domain string, channel string, missing boolean, age_min double, coverage double, manifest_ids array<string>"


def bundle_cells(spark, *more):
    return spark.createDataFrame([("x", "sat/ir1", r, c, 230.0, True) for r in range(2) for c in range(2)] + list(more), "domain string, channel string, row int, col int, value double, mask boolean")


def test_a_missing_channel_becomes_zero_with_a_mask_and_the_rung_abstains(spark):
    frames = spark.createDataFrame([("x", "sat/ir1", False, 3.0, 1.0, ["m1"])], FRAMES)
    made = bundle.feature_bundle(bundle_cells(spark), frames, CONTRACT, ["domain"], (2, 2), mean=[0.0, 0.0])
    head = made.header.first()
    assert (head.rung, head.missing, head.names, head.score, head.ood) == ("R4", ["nwp/cape"], ["sat/ir1", "nwp/cape"], 1.0, False)
    assert [(p.channel, p.manifest_ids) for p in head.provenance] == [("sat/ir1", ["m1"]), ("nwp/cape", None)]
    planes = {}
    for r in made.tensor().collect():
        planes.setdefault(r.plane, []).append(r.value)
    assert planes == {0: [1.0] * 4, 1: [0.0] * 4, 2: [1.0] * 4, 3: [0.0] * 4, 4: [0.05] * 4, 5: [2.0] * 4}


def test_bundles_mask_what_is_marked_missing_or_not_there(spark):
    frames = spark.createDataFrame([("x", "sat/ir1", True, 3.0, 1.0, ["m1"]), ("x", "nwp/cape", None, None, 0.5, None)], FRAMES)
    cells = bundle_cells(spark, ("x", "nwp/cape", 0, 1, 600.0, True), ("x", "nwp/cape", 1, 1, float("nan"), True), ("x", "nwp/cape", 1, 0, 600.0, None))
    made = bundle.feature_bundle(cells, frames, CONTRACT, ["domain"], (2, 2))
    got = {(r.channel, r.row, r.col): (r.normal, r.valid, r.age_min) for r in made.cells.collect()}
    assert len(got) == 8 and got["nwp/cape", 0, 1] == (1.0, True, 120.0)
    assert all(v[:2] == (0.0, False) for k, v in got.items() if k != ("nwp/cape", 0, 1))
    assert made.header.first().missing == ["sat/ir1"]
    assert bundle.feature_bundle(cells.limit(0), frames.limit(0), CONTRACT, ["domain"], (2, 2)).cells.count() == 0


@pytest.mark.parametrize("row, message", [(("x", "radar/zmax", 0, 0, 1.0, True), "unexpected channel: radar/zmax"), (("x", "sat/ir1", 2, 0, 1.0, True), "outside"), (("x", "sat/ir1", 0, 0, 1.0, True), "twice")])
def test_bundles_refuse_what_breaks_the_contract(spark, row, message):
    frames = spark.createDataFrame([("x", "sat/ir1", False, 3.0, 1.0, ["m1"])], FRAMES)
    with pytest.raises(Exception, match=message):
        bundle.feature_bundle(bundle_cells(spark, row), frames, CONTRACT, ["domain"], (2, 2)).cells.collect()
    with pytest.raises(ValueError, match="version"):
        bundle.feature_bundle(bundle_cells(spark), frames, CONTRACT, ["domain"], (2, 2), channel_version=9)
