"""Scores, pairing, splits and calibration against closed forms and brute force."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.operators import calibrate, metrics, pairing, splits

NAN = float("nan")


def test_scores_of_a_perfect_forecast(spark):
    pairs = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)], "forecast double, observed double")
    row = metrics.categorical_scores(metrics.contingency(pairs, threshold=0.5)).first()
    assert (row.hits, row.misses, row.false_alarms, row.correct_negatives, row.n) == (2, 0, 0, 2, 4)
    assert (row.pod, row.far, row.csi, row.bias, row.ets) == (1, 0, 1, 1, 1)


def test_nan_is_not_above_a_threshold_but_counts_as_true_without_one(spark):
    pairs = spark.createDataFrame([(NAN, NAN), (0.0, 1.0)], "forecast double, observed double")
    assert metrics.contingency(pairs, threshold=0.5).first().correct_negatives == 1
    assert metrics.contingency(pairs).first().hits == 1


def test_undefined_ratios_are_nan(spark):
    pairs = spark.createDataFrame([(0.0, 0.0)], "forecast double, observed double")
    row = metrics.categorical_scores(metrics.contingency(pairs, threshold=0.5)).first()
    assert all(np.isnan(row[c]) for c in ("pod", "far", "csi", "bias", "ets"))


def test_a_probability_outside_the_unit_interval_raises(spark):
    cases = spark.createDataFrame([(1.5, 1.0)], "p double, outcome double")
    with pytest.raises(Exception, match="must lie in"):
        metrics.brier(cases).collect()


def test_require_rows(spark):
    with pytest.raises(ValueError):
        metrics.require_rows(spark.createDataFrame([], "x int"))


@pytest.mark.parametrize("m", [1, 2, 5, 9])
def test_crps_equals_the_mean_over_all_pairs(spark, m):
    rng = np.random.default_rng(m)
    xs, o = rng.normal(size=(6, m)), rng.normal(size=6)
    want = np.mean([np.mean(abs(x - y)) - np.mean(abs(x[:, None] - x[None, :])) / 2 for x, y in zip(xs, o, strict=True)])
    cases = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(xs, o, strict=True)], "members array<double>, observed double")
    assert metrics.crps(cases).first().crps == pytest.approx(want)


def test_pairing_equals_brute_force(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    forecasts = [(i, at(rng.randrange(200)), rng.choice([0, 30, 60, 120]), 1.0) for i in range(60)]
    truths = [(i, at(o := rng.randrange(260)), at(o + rng.randrange(40)), float(i)) for i in range(80)]
    f = spark.createDataFrame(forecasts, "forecast_id int, issue_time timestamp, lead_min int, value double")
    t = spark.createDataFrame(truths, "truth_id int, obs_time timestamp, arrival_time timestamp, value double")
    for as_of in (None, at(150)):
        want = {}
        for i, issue, lead, _ in forecasts:
            fit = [(o, a, k) for k, o, a, _ in truths if issue < o <= issue + timedelta(minutes=lead) and (as_of is None or a <= as_of)]
            if fit:
                want[i] = min(fit)[2]
        got = {r.forecast_id: r.truth_id for r in pairing.pair_first_after(f, t, as_of=as_of and str(as_of)).collect()}
        assert got == want
    with pytest.raises(Exception, match="beyond"):
        pairing.pair_first_after(f, t, max_lead_min=60).collect()


def _frames(spark, rows):
    return spark.createDataFrame([(i, datetime.fromisoformat(t), e, d, s, m) for i, t, e, d, s, m in rows], "frame_id int, timestamp timestamp, event_id string, domain string, season string, manifest_ids array<string>")


def test_splits_refuse_random_frames_and_straddling_groups(spark):
    frames = _frames(spark, [(1, "2026-05-01 12:00", "a", "x", "s", ["m1"]), (2, "2026-05-03 12:00", "a", "x", "s", ["m1"])])
    with pytest.raises(ValueError):
        splits.split(frames, "random_frames")
    windows = {"train": ["2026-05-01/2026-05-01"], "test": ["2026-05-03/2026-05-03"]}
    with pytest.raises(Exception, match="more than one split"):
        splits.event_grouped_by_windows(frames, windows).collect()
    with pytest.raises(KeyError):
        splits.event_grouped_by_windows(frames, {"other": []})
    assert {r.frame_id: r.split for r in splits.chronological(frames, windows).collect()} == {1: "train", 2: "test"}
    assert [r.manifest_id for r in splits.leaked_manifests(frames, splits.chronological(frames, windows)).collect()] == ["m1"]


def test_buffer_trims_both_ends_and_groups_are_taken_whole(spark):
    frames = _frames(spark, [(1, "2026-05-01 02:00", "a", "x", "s", []), (2, "2026-05-01 12:00", "a", "x", "s", []), (3, "2026-05-09 00:00", "a", "x", "s", [])])
    windows = {"train": ["2026-05-01/2026-05-01"]}
    assert [r.frame_id for r in splits.chronological(frames, windows, 6).collect()] == [2]
    assert sorted(r.frame_id for r in splits.event_grouped_by_windows(frames, windows).collect()) == [1, 2, 3]


def test_fraction_split_orders_groups_by_their_first_frame(spark):
    rows = [(i, f"2026-05-{1 + i // 2:02d} {6 + i % 2:02d}:00", f"e{i}", "x", "s", []) for i in range(20)]
    got = {r.frame_id: r.split for r in splits.event_grouped_by_fraction(_frames(spark, rows)).collect()}
    assert [got[i] for i in range(20)] == ["train"] * 14 + ["validation"] * 3 + ["test"] * 3


def test_isotonic_fit_equals_the_min_max_formula(spark):
    rng = np.random.default_rng(5)
    p, y = np.sort(rng.random(25)), (rng.random(25) < 0.5).astype(float)
    x, fit = calibrate.pool_adjacent(p, y)
    mean = lambda i, j: y[i : j + 1].mean()
    want = [max(min(mean(i, j) for j in range(k, 25)) for i in range(k + 1)) for k in range(25)]
    assert sorted(set(np.round(fit, 9))) == sorted(set(np.round(want, 9)))
    assert (np.diff(fit) >= 0).all() and (np.diff(x) > 0).all()


def test_calibration_of_thin_groups_and_prediction(spark):
    rows = [("a", 30, "R1", "s", q, o, i) for i, (q, o) in enumerate([(0.1, 0.0), (0.2, 0.0), (0.8, 1.0), (0.9, 1.0)])] + [("b", 30, "R1", "s", 0.5, 1.0, 9)]
    cases = spark.createDataFrame(rows, "product string, lead_min int, rung string, season string, p double, outcome double, ordinal int")
    tables = calibrate.fit_isotonic(cases, "m", "r", min_positive=2)
    found = tables.collect()
    assert [(r["product"], r.positive_count) for r in found] == [("a", 2)] and found[0].calibration_id.startswith("cal-")
    out = calibrate.find_table(cases, tables).withColumn("q", calibrate.predict(F.col("p"), F.col("x"), F.col("y"))).collect()
    got = {r.ordinal: r.q for r in out}
    assert got[9] is None and got[0] == 0.0 and got[3] == 1.0


def test_assignments_on_small_matrices():
    from fogline.operators.objects import assign_greedy, assign_min_cost

    rng = np.random.default_rng(1)
    for _ in range(40):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = rng.random((n, m))
        k = min(n, m)
        best = min(sum(cost[r, c] for r, c in zip(rs, cs, strict=True)) for rs in itertools.combinations(range(n), k) for cs in itertools.permutations(range(m), k))
        got = assign_min_cost(cost)
        assert len(got) == k and sum(cost[r, c] for r, c in got) == pytest.approx(best)
        assert len(assign_greedy(cost)) == k


def test_verification_job_scores_every_threshold_and_axis(spark):
    from fogline.plans.verification_job import VerificationSpec, verify

    t0 = datetime(2024, 1, 1)
    f = spark.createDataFrame([(i, t0 + timedelta(minutes=10 * i), 30, float(i % 3), "xy"[i % 2]) for i in range(12)], "forecast_id int, issue_time timestamp, lead_min int, value double, area string")
    t = spark.createDataFrame([(i, t0 + timedelta(minutes=10 * i + 5), t0 + timedelta(minutes=10 * i + 6), float(i % 3)) for i in range(12)], "truth_id int, obs_time timestamp, arrival_time timestamp, value double")
    rows = verify(f, t, VerificationSpec([1.0, 2.0], ["area"])).collect()
    assert {r.run_id for r in rows} and len({r.run_id for r in rows}) == 1
    assert {(r.metric, r.threshold) for r in rows if r.metric == "pod"} == {("pod", 1.0), ("pod", 2.0)}
    assert all(r.value == 1.0 for r in rows if r.metric in ("pod", "csi"))
    assert all(r.value == 0.0 for r in rows if r.metric == "mae")


@pytest.mark.parametrize("stretches", [1, 3, 4096])
@pytest.mark.parametrize("keys", [[], ["who"]])
def test_latest_frames_equal_brute_force(spark, stretches, keys):
    rng = np.random.default_rng(stretches)
    t0 = datetime(2024, 1, 1)
    frames, issues = [], []
    for i in range(300):
        obs = t0 + timedelta(minutes=int(rng.integers(0, 500)))
        frames.append((2**60 + i, "ab"[i % 2] if i % 17 else None, obs, obs + timedelta(minutes=int(rng.integers(0, 90)))))
    frames += [(1, "a", None, t0), (2, "a", t0, None), (None, "a", t0, t0)]
    for i in range(80):
        issues.append(("abc"[i % 3] if i % 11 else None, t0 + timedelta(minutes=int(rng.integers(-30, 700)))))
    issues += [issues[1], ("a", None)]
    got = pairing.latest_frames(
        spark.createDataFrame(issues, "who string, issue_time timestamp"), spark.createDataFrame(frames, "frame_id long, who string, obs_time timestamp, arrival_time timestamp"), 3, keys, stretches
    )
    assert got.columns == [*keys, "issue_time", "frame_id", "obs_time", "arrival_time", "nth"]
    want = set()
    for who, at in {((w if keys else None), t) for w, t in issues if t is not None and (w is not None or not keys)}:
        usable = sorted((f for f in frames if f[0] and f[2] and f[3] and f[3] <= at and (not keys or f[1] == who)), key=lambda f: (f[2], f[0]))[-3:]
        if len(usable) == 3:
            want |= {((who,) if keys else ()) + (at, f[0], f[2], f[3], n) for n, f in enumerate(usable, 1)}
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(want) and set(rows) == want


def test_a_frame_cannot_arrive_before_it_is_observed(spark):
    t = datetime(2024, 1, 1)
    issues, frames = spark.createDataFrame([(t,)], "issue_time timestamp"), spark.createDataFrame([(1, t, t - timedelta(minutes=1))], "frame_id int, obs_time timestamp, arrival_time timestamp")
    with pytest.raises(Exception, match="arrives before"):
        pairing.latest_frames(issues, frames, 1).collect()
    assert pairing.latest_frames(issues, frames.limit(0), 1).count() == 0
