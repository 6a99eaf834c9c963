"""Fields, objects and tracks against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fogline.functions.projection import DOMAINS, grid_index
from fogline.operators import features, grid, objects, qc


def cells(spark, a, **extra):
    rows = [(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = r.value
    return out


@pytest.mark.parametrize("target", [(1, 1), (2, 3), (5, 7), (8, 11), (10, 12)])
def test_regrid_keeps_extremes_inside_the_windows(spark, target):
    a = np.random.default_rng(26084).normal(size=(8, 11))
    df = cells(spark, a)
    for name, f in (("min", np.min), ("max", np.max), ("mean", np.mean), ("sum", np.sum), ("max_abs", lambda w: w.flat[np.argmax(abs(w))]), ("nearest", lambda w: w.flat[0])):
        want = np.empty(target)
        for i in range(target[0]):
            for j in range(target[1]):
                r0, c0 = i * 8 // target[0], j * 11 // target[1]
                r1 = r0 + 1 if target[0] >= 8 else max(r0 + 1, -(-(i + 1) * 8 // target[0]))
                c1 = c0 + 1 if target[1] >= 11 else max(c0 + 1, -(-(j + 1) * 11 // target[1]))
                want[i, j] = f(a[r0:r1, c0:c1])
        np.testing.assert_allclose(array(grid.regrid(df, (8, 11), target, name), target), want)


def test_regrid_fills_masked_windows_and_rejects_unknown_policies(spark):
    df = spark.createDataFrame([(0, 0, 100.0, False), (0, 1, 1.0, True), (1, 0, 2.0, True), (1, 1, float("nan"), True)], "row int, col int, value double, valid boolean")
    assert grid.regrid(df, (2, 2), (1, 1), "max").first().value == 2.0
    assert grid.regrid(df.where("row = 0 and col = 0"), (2, 2), (1, 1), "max", fill=-1.0).first().value == -1.0
    with pytest.raises(ValueError):
        grid.regrid_policy(df, (2, 2), (1, 1), "cubic")


def test_fractions_skill_grows_with_the_scale(spark):
    f, o = np.zeros((9, 9)), np.zeros((9, 9))
    f[4, 4], o[4, 5] = 1, 1
    df = cells(spark, f).withColumnRenamed("value", "forecast").join(cells(spark, o).withColumnRenamed("value", "observed"), ["row", "col"])
    got = {r.scale: r.fss for r in grid.fractions_skill(df, [1, 3, 5]).collect()}
    assert got[1] == 0 and got[1] < got[3] < got[5] < 1
    same = df.withColumn("observed", F.col("forecast"))
    assert all(r.fss == 1 for r in grid.fractions_skill(same, [1, 3]).collect())


def test_advection_looks_back_from_the_original_field_without_wrapping(spark):
    a = np.zeros((3, 4))
    a[1, 3] = 7
    motion = cells(spark, a).select("row", "col", F.lit(1.0).alias("u"), F.lit(0.0).alias("v"))
    got = grid.lagrangian_persistence(cells(spark, a), motion, 2)
    assert got.where("value <> 0").count() == 0  # it left the grid
    b = np.zeros((3, 4))
    b[1, 0] = 7
    hits = {(r.lead, r.row, r.col) for r in grid.lagrangian_persistence(cells(spark, b), motion, 3).where("value = 7").collect()}
    assert hits == {(1, 1, 1), (2, 1, 2), (3, 1, 3)}


def test_ensemble_is_deterministic_and_falls_back(spark):
    a = np.random.default_rng(2).random((4, 4)) + 5
    motion = cells(spark, a).select("row", "col", F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    one, why = grid.ensemble(cells(spark, a), motion, leads=2, members=40, noise=0.5)
    two, _ = grid.ensemble(cells(spark, a).repartition(3), motion, leads=2, members=40, noise=0.5)
    same = lambda df: sorted((r.lead, r.row, r.col, r.member, round(r.value, 9)) for r in df.collect())  # noqa: E731  the spread is a sum of doubles
    assert why is None and same(one) == same(two)
    assert one.agg(F.avg("value")).first()[0] == pytest.approx(a.mean(), abs=0.05)
    flat, why = grid.ensemble(cells(spark, a), motion, leads=2, members=3, frames=1)
    assert why == "poor_motion" and flat.count() == 16 * 2 * 3
    with pytest.raises(ValueError):
        grid.ensemble(cells(spark, a), motion, frames=0)


def test_projection_origin(spark):
    row, col = grid_index(DOMAINS["pilot_e"], F.lit(23.0), F.lit(87.0))
    got = spark.range(1).select(row.alias("r"), col.alias("c")).first()
    assert got.r == pytest.approx(225, abs=1e-6) and got.c == pytest.approx(250, abs=1e-6)
    row, col = grid_index(DOMAINS["national_s"], F.lit(37.98), F.lit(66.02))
    got = spark.range(1).select(row.alias("r"), col.alias("c")).first()
    assert got.r == pytest.approx(0.5, abs=1e-6) and got.c == pytest.approx(0.5, abs=1e-6)


def test_components_equal_flood_fill():
    rng = np.random.default_rng(4)
    for _ in range(10):
        a = rng.random((9, 9)) < 0.35
        r, c = np.nonzero(a)
        labels = objects.components(r, c)
        seen = {}
        for start in zip(r, c, strict=True):
            if start in seen:
                continue
            stack, mark = [start], len(seen)
            while stack:
                y, x = stack.pop()
                if (y, x) in seen or not (0 <= y < 9 and 0 <= x < 9) or not a[y, x]:
                    continue
                seen[(y, x)] = mark
                stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        ours = {(int(y), int(x)): k for y, x, k in zip(r, c, labels, strict=True)}
        pairs = {(seen[k], ours[k]) for k in seen}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def detection(x, y, area, peak, at):
    return objects.Detection(x, y, area, peak, frozenset(at))


def test_track_keeps_its_number_and_ends_after_two_gaps():
    state, out = objects.track_step(objects.TrackerState(), [detection(5, 5, 9, 50, {1, 2})])
    assert out[0]["track_id"] == "T000001" and out[0]["lifecycle"] == "Candidate"
    state, out = objects.track_step(state, [detection(6, 5, 9, 50, {2, 3}), detection(60, 60, 9, 30, {99})])
    assert [(o["track_id"], o["lifecycle"]) for o in out] == [("T000001", "Mature"), ("T000002", "Candidate")]
    state, out = objects.track_step(state, [])
    assert out == [] and len(state.active) == 2
    state, out = objects.track_step(state, [])
    assert {o["lifecycle"] for o in out} == {"Dissipated"} and not state.active


def test_tracks_of_a_table_follow_the_steps(spark):
    frames = [("d", t, t, 8, 50.0, 2.0 + t, 5.0, list(range(8))) for t in range(3)]
    df = spark.createDataFrame([(d, t, 0, n, m, x, y, cs) for d, t, _, n, m, x, y, cs in frames], "domain string, frame_time int, object int, area_cells int, max_value double, centroid_x double, centroid_y double, cells array<int>")
    got = objects.track_objects(df).orderBy("frame_time").collect()
    assert [(r.track_id, r.age_frames, r.lifecycle) for r in got] == [("T000001", 1, "Candidate"), ("T000001", 2, "Mature"), ("T000001", 3, "Mature")]


def test_arrival_windows_use_the_higher_rule(spark):
    times = spark.createDataFrame([("t", "x", 1.0, m, v) for m, v in enumerate([10, 20, None, 40])], "track_id string, target_id string, radius_km double, member int, minutes long")
    r = objects.arrival_windows(times).first()
    assert (r.p_arrival, r.t10, r.t50, r.t90, r.p_decay) == (0.75, 20, 20, 40, 0.0)


def test_arrival_steps_through_the_motion_field():
    u, v = np.ones((3, 8)), np.zeros((3, 8))
    assert objects.first_hit([8], u, v, (5.0, 1.0, 1.0), 12) == 4
    assert objects.first_hit([8], -u, v, (5.0, 1.0, 1.0), 12) is None


def test_quality_control_boundaries(spark):
    df = spark.createDataFrame([("ir1", 0, 0, 220.0, True), ("ir1", 0, 1, 900.0, True), ("ir1", 0, 2, float("nan"), True)], "channel string, row int, col int, value double, mask boolean")
    checked, summary = qc.satellite(df, [])
    assert [r.valid for r in checked.orderBy("col").collect()] == [True, False, False]
    assert summary.first().flags == ["non_finite_rejected", "physical_range_rejected", "uncalibrated"]
    edge = spark.createDataFrame([("div_lowlvl", 0, 0, 0.1, True)], df.schema)
    assert qc.radar(edge, [], True)[0].first().valid  # bounds are compared as 32-bit floats
    assert qc.radar(edge, [], False)[1].first().flags == ["no_valid_pixels", "no_velocity"]
    with pytest.raises(Exception, match="unknown channel"):
        qc.satellite(df.withColumn("channel", F.lit("zz")), [])[0].collect()


def test_feature_contracts_refuse_bad_channels():
    make = features.FeatureContract
    c = make(("a", "b"), (0, 0), (1, 1), (0, 0), (9, 9))
    assert c.order_of(["b", "a"]) == [1, 0]
    for live in (["a"], ["a", "b", "c"], ["a", "a"]):
        with pytest.raises(ValueError):
            c.order_of(live)
    with pytest.raises(ValueError):
        make(("a", "a"), (0, 0), (1, 1), (0, 0), (9, 9))


def test_distance_raises_on_vectors_that_are_not_finite(spark):
    df = spark.createDataFrame([([2.0, 0.0],)], "vector array<double>")
    r = features.mahalanobis(df, [0.0, 0.0], [1.0, 1.0], 1.0).first()
    assert r.ood and r.score == pytest.approx(2, abs=1e-5)
    with pytest.raises(Exception, match="not finite"):
        features.mahalanobis(spark.createDataFrame([([float("inf"), 0.0],)], "vector array<double>"), [0.0, 0.0]).collect()


def test_streamed_tracks_equal_batch_tracks(spark, tmp_path):
    from fogline.streaming.jobs import read_stream, track_stream

    rows = [("d" + str(k % 2), t, 0, 8, 50.0, 2.0 + t, 5.0, list(range(8))) for k in range(2) for t in range(4)]
    df = spark.createDataFrame(rows, "domain string, frame_time int, object int, area_cells int, max_value double, centroid_x double, centroid_y double, cells array<int>")
    for t in range(4):
        df.where(F.col("frame_time") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = track_stream(read_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("tracks").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    key = ["domain", "frame_time", "track_id", "lifecycle", "age_frames"]
    a = spark.table("tracks").select(*key).toPandas().sort_values(key).reset_index(drop=True)
    b = objects.track_objects(df).select(*key).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_streamed_ingest_equals_one_merge(spark, tmp_path):
    from fogline.sources.manifests import check_payloads, merge_manifest
    from fogline.streaming.jobs import ingest_stream, read_manifest, read_stream

    landed = spark.createDataFrame(
        [("sat", "s1", f"http://x/{name}", bytearray(b"GIF89a" + body), "image/gif", 200, at) for name, body, at in (("a_202401010000.gif", b"1", 1704067500), ("a_202401010000.gif", b"1", 1704067800), ("b.gif", b"2", 1704067500))],
        "source string, station string, url string, payload binary, content_type string, status int, at long",
    ).withColumn("arrival_time", F.timestamp_seconds("at"))
    rows = landed.drop("at")
    for i, part in enumerate(rows.randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    checked = lambda df: check_payloads(df).withColumn("path", F.lit("p")).withColumn("metadata", F.lit("m")).withColumn("status", F.lit("ok"))
    run = ingest_stream(checked(read_stream(spark, str(tmp_path / "in"), 1)), str(tmp_path / "man"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    run.awaitTermination()
    want = merge_manifest(None, checked(rows).where("reason is null")).collect()
    got = read_manifest(spark, str(tmp_path / "man")).collect()
    assert [(r.observation_id, r.seen_count, r.first_seen, r.last_seen) for r in got] == [(r.observation_id, r.seen_count, r.first_seen, r.last_seen) for r in want]
    assert got[0].seen_count == 2
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["missing_source_timestamp"]


def test_a_batch_rewrites_only_the_parts_that_it_has_rows_of(spark, tmp_path):
    from fogline.streaming.jobs import ingest_stream, read_manifest, read_stream

    names = "observation_id string, source string, station string, obs_time timestamp, arrival_time timestamp, path string, status string, metadata string, reason string, payload_sha256 string, url string"
    at = datetime(2024, 1, 1)

    def land(ids, minute):
        rows = [(i, "s", "t", at, at + timedelta(minutes=minute), "p", f"m{minute}", "x", None, "h", "u") for i in ids]
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(check="ck"):
        ingest_stream(read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "man"), str(tmp_path / "bad"), str(tmp_path / check), parts=8).awaitTermination()

    counts = lambda: {r.observation_id: (r.seen_count, r.status) for r in read_manifest(spark, str(tmp_path / "man")).collect()}
    assert read_manifest(spark, str(tmp_path / "man")) is None
    land([f"o{i}" for i in range(100)], 0)
    run()
    assert len(list((tmp_path / "man/data/v0").glob("part=*"))) == 8
    land(["o7"], 5)
    run()
    assert len(list((tmp_path / "man/data/v1").glob("part=*"))) == 1
    assert counts() == {f"o{i}": ((2, "m5") if i == 7 else (1, "m0")) for i in range(100)}
    (tmp_path / "ck/commits/1").unlink()  # the driver died after the batch's own commit
    (tmp_path / "ck/commits/.1.crc").unlink(missing_ok=True)
    run()
    assert counts()["o7"] == (2, "m5")
    land(["o7", "new"], 9)
    run()
    assert counts()["o7"] == (3, "m9") and len(counts()) == 101
    held = {(p.parent.name, p.name) for p in (tmp_path / "man/data").glob("v*/part=*")}
    assert len(held) <= 8 + 2 + 1 and len(list((tmp_path / "man/index").glob("v*"))) == 2


def test_scales_that_do_not_fit_have_no_row(spark):
    rng = np.random.default_rng(8)
    rows = [(r, c, float(rng.random()), float(rng.random())) for r in range(6) for c in range(9)]
    df = spark.createDataFrame(rows, "row int, col int, forecast double, observed double")
    assert [r.scale for r in grid.fractions_skill(df, [7, 6, 2]).orderBy("scale").collect()] == [2, 6]
    with pytest.raises(ValueError, match="positive"):
        grid.fractions_skill(df, [0, 2])


def test_nowcast_categories_keep_what_is_empty(spark):
    from fogline.sources.manifests import nowcast_categories

    texts = ['{"category":"","warning":"red","district":"","district_name":"D"}', '{"category":null,"colour":0}', '[{"nowcast":false,"inner":{"severity":"x","station":0,"station_name":"S"}}]', "not json", None]
    got = nowcast_categories(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, payload string")).collect()
    assert sorted((r.id, r.category, r.district, r.station) for r in got if r.id < 2) == [(0, "", "D", None), (1, "0", None, None)]
    assert {(r.category, r.station) for r in got if r.id == 2} == {("False", None), ("x", "S")} and len(got) == 4


def test_a_clock_does_not_move_back(spark):
    from fogline.streaming.replay import between_clocks

    events = spark.createDataFrame([(datetime(2024, 1, 2),)], "virtual_time timestamp")
    assert between_clocks(events, "2024-01-01", "2024-01-02").count() == 1 and between_clocks(events, "2024-01-02", "2024-01-02").count() == 0
    with pytest.raises(ValueError, match="back"):
        between_clocks(events, "2024-01-02", "2024-01-01")


def test_nowcast_categories_of_every_shape(spark):
    """Against a walk over the parsed text; no Python worker in the plan."""
    import json

    from fogline.sources.manifests import NOWCAST_KEYS, nowcast_categories

    rng = np.random.default_rng(3)
    values = ["", "red", "a{b]", 'q"\\', 0, 7, True, False, None, [], {}]

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return values[rng.integers(len(values))]
        if rng.random() < 0.4:
            return [tree(depth - 1) for _ in range(rng.integers(4))]
        keys = [k for ks in NOWCAST_KEYS.values() for k in ks] + ["rows", "inner", "other"]
        return {str(k): tree(depth - 1) for k in rng.choice(keys, rng.integers(1, 6), replace=False)}

    def walk(value):
        if isinstance(value, dict):
            said = next((value[k] for k in NOWCAST_KEYS["category"] if value.get(k) is not None), None)
            if said is not None and not isinstance(said, (dict, list)):
                yield (str(said), *(next((value[k] for k in keys if value.get(k)), None) for field, keys in NOWCAST_KEYS.items() if field != "category"))
            for v in value.values():
                yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    trees = [tree(7) for _ in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id int, payload string")
    found = nowcast_categories(rows)
    plain = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), sort_keys=True) if isinstance(x, (dict, list)) else str(x)
    tidy = lambda x: plain(json.loads(x)) if isinstance(x, str) and x[:1] in "{[" and x[1:] and x[-1] in "]}" else plain(x)
    want = sorted(repr((i, *map(tidy, r))) for i, t in enumerate(trees) for r in walk(t))
    got = sorted(repr((r.id, *map(tidy, r[1:]))) for r in found.collect() if r.category[:1] not in "{[" or r.category == "")
    assert got == want and len(want) > 100
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Arrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_tracks_are_the_same_in_segments(spark):
    """Frames with pauses of none, one, two and more empty frames, against one pass over all of them."""
    from fogline.operators import objects

    rng = np.random.default_rng(11)
    rows, state, want = [], objects.TrackerState(), []
    for domain in ("a", "b"):
        state, x = objects.TrackerState(), 5.0
        for t in range(60):
            n = 0 if rng.random() < 0.5 else int(rng.integers(1, 4))
            frame = [(domain, t, k, x + 8 * k + float(rng.random()), 4.0, 3, 40.0 + k, [t % 5 + k, 100 + k]) for k in range(n)]
            rows += frame or [(domain, t, None, None, None, None, None, None)]
            state, out = objects.track_step(state, [objects.Detection(r[3], r[4], r[5], r[6], frozenset(r[7])) for r in frame])
            want += [(domain, t, o["track_id"], o["lifecycle"], o["age_frames"], o["missed"], list(o["parents"])) for o in out]
    df = spark.createDataFrame(rows, "domain string, frame_time int, object int, centroid_x double, centroid_y double, area_cells int, max_value double, cells array<int>")
    assert objects.track_segments(df).agg({"segment": "max"}).first()[0] > 3
    got = objects.track_objects(df).select("domain", "frame_time", "track_id", "lifecycle", "age_frames", "missed", "parents").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_replay_clock_in_batch_and_stream(spark, tmp_path):
    from fogline.streaming.jobs import read_stream
    from fogline.streaming.replay import released, replay_clock, replay_clock_stream

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    runs = spark.createDataFrame([("r", at(0), at(6), 60.0), ("s", at(0), at(2), 1.0)], "replay_id string, t_start timestamp, t_end timestamp, speed double")
    shape = "replay_id string, step long, real_seconds double, target timestamp"
    steps = [("r", 1, 0.0, None), ("r", 2, 60.0, None), ("r", 3, None, at(3)), ("r", 4, 30.0, None), ("r", 5, None, at(9)), ("r", 6, 10.0, None), ("s", 1, None, at(1))]
    events = spark.createDataFrame([("r", f"{h}", at(h)) for h in range(7)] + [("s", "x", at(1))], "replay_id string, object_key string, virtual_time timestamp")
    batch = replay_clock(spark.createDataFrame(steps, shape), runs)
    assert sorted((r.replay_id, r.object_key, r.step) for r in released(batch, events).collect()) == [("r", "0", 1), ("r", "1", 2), ("r", "2", 3), ("r", "3", 3), ("r", "4", 5), ("r", "5", 5), ("r", "6", 5), ("s", "x", 1)]
    for n, part in enumerate((steps[:2], steps[2:])):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        run = replay_clock_stream(spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), runs)
        run.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    for wrong in ([("r", 1, None, at(3)), ("r", 2, None, at(2))], [("r", 1, -1.0, None)], [("q", 1, 1.0, None)], [("r", 1, None, None)]):
        rows = spark.createDataFrame(wrong, shape)
        with pytest.raises(Exception, match="back|negative|found|gives"):
            replay_clock(rows, runs).collect()
    spark.createDataFrame([("r", 7, None, at(2))], shape).coalesce(1).write.parquet(str(tmp_path / "in" / "p9"))
    run = replay_clock_stream(spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), runs)
    with pytest.raises(Exception, match="back"):
        run.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
