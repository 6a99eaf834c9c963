"""Queries against their SQL on tables where they used to differ from it, or to do far too much work."""

import json
import uuid
from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline import queries as core
from fogline.functions import times
from fogline.operators import labelling, objects
from fogline.queries import ingest
from fogline.sources import labels, manifests
from fogline.streaming import jobs
from tests.conftest import same_as_sql
from tests.test_labelling import T0, km


@pytest.fixture
def against_sql(spark, tmp_path):
    """A function from a query's name and the SQL of an events table to the comparison of both."""

    def of(name, events):
        duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
        same_as_sql(core.QUERIES[name](spark, str(tmp_path)), con.sql(core.ORACLES[name]))

    return of


def test_downburst_scores_at_the_limits_of_a_class(against_sql):
    """Scores of exactly 0.33 and 0.66: every value, k and user that come to one."""
    against_sql("downburst", """SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' AS ts, u::BIGINT AS user_id, 'click' AS event_type, cents / 7 / 100 AS value, '{"k": ' || k || '}' AS props
FROM (SELECT k, u, s - 95000 - 2500 * k - 15000 * u AS cents FROM range(100) a(k), range(10) b(u), (VALUES (330000), (660000)) c(s)) WHERE cents >= 0 AND cents % 7 = 0""")


def test_daily_latencies_are_exact_beyond_a_few_thousand_cycles(against_sql):
    """60,000 different latencies a day and domain, some negative and some equal."""
    against_sql("operations_by_day", """SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 863999) AS ts, i % 7 AS user_id, CASE WHEN i % 2 = 0 THEN 'click' ELSE 'view' END AS event_type,
CASE WHEN i % 11 = 0 THEN 7.5 ELSE (i * 7919 % 200003 - 20000) / 1000.0::DOUBLE END AS value, '{"k": ' || i % 100 || '}' AS props FROM range(200000) x(i)""")


def test_overlaps_of_objects_that_repeat(spark, monkeypatch):
    """Objects with equal cells, in slices of two ids, against all pairs; ids that come twice, nulls, keys and cells that are missing."""
    monkeypatch.setattr(objects, "SLICE", 2)
    rng = np.random.default_rng(3)
    make = lambda n: [(int(k), int(i), [int(c) for c in rng.choice(12, 2)]) for i, k in zip(range(n), rng.integers(0, 2, n), strict=True)] + [(0, None, [1, None]), (0, 3, [4]), (0, 3, [5, 5]), (1, 90, []), (1, 91, None), (None, 92, [1])]
    a, b = make(40), make(60)
    frame = lambda rows: spark.createDataFrame(rows, "frame int, id int, cells array<int>")
    got = [tuple(r) for r in objects.overlapping(frame(a), frame(b), ["frame"]).collect()]
    cells = lambda x: {c for c in x[2] or () if c is not None}
    want = {(x[0], x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and cells(x) & cells(y)}
    assert len(got) == len(set(got)) and set(got) == want
    assert objects.overlapping(frame(a).limit(0), frame(b)).count() == 0


def test_overlapping_objects_are_shuffled_once_for_all_their_copies(spark):
    """A shuffle of pairs would grow with the square of the copies."""
    rows = spark.range(4000).select(F.col("id"), F.array(F.lit(1), F.lit(2)).alias("cells"))
    found = objects.overlapping(rows, rows)
    assert found.count() == 4000 * 4000
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate explode(_b_ids") < text.index("Exchange")


@pytest.mark.parametrize("before", [False, True])
def test_near_in_space_and_time_equals_all_pairs_around_the_globe(spark, before):
    rng = np.random.default_rng(5)
    at = lambda: T0 + timedelta(seconds=int(rng.integers(0, 20_000)))
    place = lambda: (float(rng.choice([-90.0, -89.9, 0.0, 59.9, 60.1, 89.8, 90.0])), float(rng.choice([-180.0, -179.8, 0.0, 179.9, 440.1])))
    p, e = ([(i, *place(), at()) for i in range(n)] for n in (80, 120))
    odd = [(900, None, 1.0, T0), (901, 0.0, float("nan"), T0), (902, 0.0, 0.0, None)]
    frame = lambda rows, name: spark.createDataFrame(rows + odd, f"{name} long, lat double, lon double, at timestamp")
    got = sorted((r.point_id, r.event_id) for r in labels.near_in_space_and_time(frame(p, "point_id"), frame(e, "event_id"), 40.0, 60.0, before).collect())
    low = -60 if before else 0
    want = sorted((i, j) for i, a, b, t in p for j, c, d, u in e if km((a, b), (c, d)) <= 40 and timedelta(minutes=low) <= u - t <= timedelta(minutes=60))
    assert got == want and len(want) > 50


def test_points_meet_only_events_of_their_longitude(spark, monkeypatch):
    """360 points and events at one latitude and time, a degree apart: a few hundred rows meet and not 129,600."""
    rows = spark.range(360).select(F.col("id").alias("point_id"), F.lit(0.0).alias("lat"), (F.col("id") - 180.0).alias("lon"), F.lit(T0).alias("at"))
    met = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (met.add(1), x)[1], "double").asNondeterministic()
    monkeypatch.setattr(labels, "distance_km", lambda a, b, c, d: seen(d) * 0)
    labels.near_in_space_and_time(rows, rows.withColumnRenamed("point_id", "event_id"), 40.0, 60.0).collect()
    assert 360 <= met.value <= 3 * 360


def test_few_rows_are_dealt_to_bins_for_hazard_labels(spark):
    """A circle touches about four bins, not nine, and only events are dealt to several; points are one row each."""
    globe = labelling._Globe(8.0)
    rows = spark.range(2000).select((F.col("id") % 160 - 80 + F.rand(1)).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    assert rows.select(F.avg(F.size(globe.around(F.col("lat"), F.col("lon"))))).first()[0] < 5
    points = spark.createDataFrame([(1, 1.0, 2.0, T0)], "point_id long, lat double, lon double, at timestamp")
    plan = labelling.has_match(points, points.select("lat", "lon", "at"), 8.0, 30)._jdf.queryExecution().optimizedPlan().toString()
    semi = plan[plan.index("Join LeftSemi"):]
    assert plan.count("Generate explode") == 2 and semi.index("Aggregate [lat") > semi.rindex("Generate explode")


def test_times_in_json_are_computed_once(spark):
    """Same times as outside of lambdas, in all forms; a text is cut into tokens once and not for every token."""
    forms = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+0530", "2024-01-02 03:04 IST", "02JAN2024 0304", "02jan2024 0304 UTC", "02/01/2024 03:04+05:30", "202401020304", "1704164645", "1704164645.5", " 2024-01-02 ", "x", "5", "", "2024-13-02", "12 UTC", "ISTZ"]
    rows = spark.createDataFrame([(i, t, '{"a":[{"b":"x"},{"Valid From":%s}],"date":"2024-05-06","n":{"t":[]}}' % json.dumps(t)) for i, t in enumerate(forms)], "i int, t string, payload string")
    found = manifests.json_times(rows)
    assert found.where(~F.col("valid_time").eqNullSafe(times.parse_timestamp(F.col("t")))).count() == 0
    assert found.where("issue_time = timestamp '2024-05-06' and any_time = coalesce(valid_time, issue_time)").count() == len(forms)
    assert found.where("valid_time is not null").count() == 11
    assert manifests.json_times(rows.select(F.lit("{").alias("payload"))).where("any_time is not null").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("initcap") == 1


def test_stream_pairs_hold_a_row_per_time_and_not_per_copy(monkeypatch, against_sql):
    """24 events in 30 copies: the stream gives each pair of times once, and the ids are spread over them in slices."""
    streamed, finished = [], ingest._finished
    monkeypatch.setattr(ingest, "_finished", lambda df, out: streamed.append(finished(df, out)) or streamed[-1])
    monkeypatch.setattr(jobs, "SLOT_IDS", 8, raising=False)
    against_sql("stream_pairs", """SELECT i + 1000 * c AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i * 7) AS ts, i AS user_id, CASE WHEN i % 2 = 0 THEN 'click' ELSE 'purchase' END AS event_type, 1.0::DOUBLE AS value, '{"k": 1}' AS props FROM range(24) a(i), range(30) b(c)""")
    assert 10 < streamed[0].count() < 144


def shuffled_rows(spark, run):
    """Rows that the jobs of ``run()`` wrote to shuffles."""
    sc, group = spark.sparkContext, f"rows-{uuid.uuid4().hex}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_overlaps_of_different_objects_shuffle_objects_and_not_pairs(spark):
    """600 objects with different cells that share one: 360,000 pairs, none of which is shuffled to be distinct."""
    rows = spark.range(600).select(F.col("id"), F.array(F.lit(-1).cast("long"), F.col("id") % 7, F.col("id") + 10).alias("cells"))
    found = []
    moved = shuffled_rows(spark, lambda: found.append(objects.overlapping(rows, rows).count()))
    assert found == [360_000] and 0 < moved < 30_000


@pytest.mark.parametrize("words", [1, 8])
def test_overlaps_at_crowded_cells_come_once(spark, monkeypatch, words):
    """More rows at a cell than one group takes, hashes of cells that collide, and cells of two types, against all pairs."""
    monkeypatch.setattr(objects, "SLICE", 3)
    monkeypatch.setattr(objects, "CELL_ROWS", 7, raising=False)
    monkeypatch.setattr(objects, "WORDS", words, raising=False)
    rng = np.random.default_rng(11)
    make = lambda n: [(int(i % 2), i, [int(c) for c in rng.choice(300, rng.integers(1, 60))]) for i in range(n)]
    a, b = make(60), make(80)
    got = [tuple(r) for r in objects.overlapping(spark.createDataFrame(a, "frame int, id int, cells array<int>"), spark.createDataFrame(b, "frame int, id int, cells array<long>"), ["frame"]).collect()]
    want = {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and set(x[2]) & set(y[2])}
    assert len(got) == len(set(got)) and set(got) == want and 500 < len(want) < 2400


def test_stream_pairs_hold_a_row_per_block_where_times_differ(spark, monkeypatch, against_sql):
    """600 times, each of a click and a purchase, also exactly a lead apart: pairs of blocks are held and shuffled, not of times; an id is missing."""
    streamed, finished = [], ingest._finished
    monkeypatch.setattr(ingest, "_finished", lambda df, out: streamed.append(finished(df, out)) or streamed[-1])
    monkeypatch.setattr(jobs, "SLOT_IDS", 5)
    events = """SELECT CASE WHEN i = 17 AND c = 1 THEN NULL ELSE i + 1000 * c END AS event_id, TIMESTAMP '2024-01-01 00:00:07' + to_seconds(i * 20) AS ts, i AS user_id,
CASE WHEN (i // 2 + c) % 2 = 0 THEN 'click' ELSE 'purchase' END AS event_type, 1.0::DOUBLE AS value, '{"k": 1}' AS props FROM range(600) a(i), range(2) b(c)"""
    moved = shuffled_rows(spark, lambda: against_sql("stream_pairs", events))
    assert 500 < streamed[0].count() < 3000 and 0 < moved < 40_000
