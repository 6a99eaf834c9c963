"""Bootstrap intervals, verification records and the calibration ladder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.operators import bootstrap, calibrate
from fogline.plans import records

PAIRS = "product string, lead_min int, region string, season string, rung string, block string, forecast double, observed double, base double"


def pairs(spark, n=400):
    rng = np.random.default_rng(3)
    f, o = rng.random(n) * 10, rng.random(n) * 10
    rows = [("p", 30, "xy"[i % 2], None if i % 5 == 0 else "s", f"R{i % 3}", f"day{i % 23}", float(f[i]), float((f[i] + o[i]) / 2), 5.0) for i in range(n)]
    return spark.createDataFrame(rows, PAIRS)


def test_draws_are_poisson_and_depend_on_seed_and_block_alone(spark):
    blocks = spark.range(600).select(F.concat(F.lit("b"), "id").alias("block"))
    one = {r.block: r.w for r in blocks.select("block", bootstrap.block_weights(F.col("block"), 50, 1).alias("w")).collect()}
    two = {r.block: r.w for r in blocks.repartition(7).select("block", bootstrap.block_weights(F.col("block"), 50, 1).alias("w")).collect()}
    other = {r.block: r.w for r in blocks.select("block", bootstrap.block_weights(F.col("block"), 50, 2).alias("w")).collect()}
    assert one == two and one != other
    draws = np.array(list(one.values()))
    assert draws.shape == (600, 51) and (draws[:, 0] == 1).all()
    assert abs(draws[:, 1:].mean() - 1) < 0.03 and abs(draws[:, 1:].var() - 1) < 0.06
    assert abs((draws[:, 1:] == 0).mean() - np.exp(-1)) < 0.02


def test_records_hold_values_intervals_and_baselines(spark):
    spec = records.RecordSpec([4.0, 99.0], {"flat": "base"}, replicates=100)
    found = records.records(pairs(spark), spec).collect()
    again = records.records(pairs(spark).repartition(9), spec).collect()
    key = lambda r: (r.metric, r.threshold, r.region, r.season, r.rung)
    rows = {key(r): r for r in found}
    assert len(rows) == len(found)
    frame = pairs(spark).toPandas()
    hit = ((frame.forecast >= 4) & (frame.observed >= 4)).sum()
    whole = rows["pod", "4", "all", "all", "all"]
    assert whole.value == pytest.approx(hit / (frame.observed >= 4).sum()) and whole.n == 400 and whole.ci95[0] <= whole.value <= whole.ci95[1]
    assert rows["mae", "none", "x", "unknown", "all"].value == pytest.approx((frame.forecast - frame.observed).abs()[(frame.region == "x") & frame.season.isna()].mean())
    assert rows["mae", "none", "all", "all", "all"].baseline["flat"] == pytest.approx((5 - frame.observed).abs().mean())
    assert not [k for k in rows if k[1] == "99" and k[0] in ("pod", "csi")]  # undefined: nothing reaches the threshold
    assert whole.figure_id == "F-M0-POD-4-all-all" and whole.run_id.startswith("vr-")
    for r in again:
        assert rows[key(r)].ci95 == pytest.approx(r.ci95) and rows[key(r)].value == pytest.approx(r.value)


def test_interval_is_that_of_drawn_blocks(spark):
    spec = records.RecordSpec([4.0], replicates=60)
    frame = pairs(spark).toPandas()
    weights = {r.block: r.w for r in pairs(spark).select("block").distinct().select("block", bootstrap.block_weights(F.col("block"), 60, 0).alias("w")).collect()}
    w = np.array([weights[b] for b in frame.block])[:, 1:].T
    error = (frame.forecast - frame.observed).abs().to_numpy()
    means = (w * error).sum(axis=1) / w.sum(axis=1)
    row = records.records(pairs(spark), spec).where("metric = 'mae' and region = 'all' and season = 'all' and rung = 'all'").first()
    assert row.ci95 == pytest.approx(list(np.quantile(means, [0.025, 0.975])))


def test_records_of_no_pairs_and_of_null_values(spark):
    spec = records.RecordSpec([1.0], replicates=8)
    assert records.records(pairs(spark).limit(0), spec).count() == 0
    odd = spark.createDataFrame([("p", None, None, None, None, None, None, 2.0, None), ("p", None, None, None, None, None, 3.0, 2.0, None)], PAIRS)
    got = {r.metric: r for r in records.records(odd, spec).where("region = 'all' and season = 'all' and rung = 'all'").collect()}
    assert got["pod"].value == 0.5 and got["pod"].lead_min is None


def test_run_rows_identify_a_run(spark):
    one, two = records.RecordSpec([1.0], model_versions=("b", "a")), records.RecordSpec([1.0], model_versions=("a", "b"))
    assert one.run_id() == two.run_id() != records.RecordSpec([2.0], model_versions=("a", "b")).run_id()
    assert not records.run_row(spark, one).first().citable and records.run_row(spark, records.RecordSpec([1.0], frozen=True)).first().citable


CASES = "product string, lead_min int, rung string, season string, p double, outcome double, ordinal long, research boolean"


def test_thin_keys_fall_back_along_the_ladder(spark):
    rng = np.random.default_rng(1)
    rows = [("a", 30, f"R{i % 2}", "s" if i % 4 else "t", float(rng.random()), float(rng.random() < 0.5), i, False) for i in range(400)] + [("a", 60, "R0", "s", 0.5, 1.0, 999, False)]
    cases = spark.createDataFrame(rows, CASES)
    tables = calibrate.fit_ladder(cases, "m", "r", min_positive=60)
    keys = {(r["product"], r.lead_min, r.rung, r.season) for r in tables.collect()}
    assert keys == {("a", 30, "R1", "s"), ("a", 30, "R0", "all"), ("a", 30, "R1", "all"), ("a", 30, "all", "all")}
    wanted = spark.createDataFrame([("a", 30, "R1", "s"), ("a", 30, "R0", "t"), ("a", 30, "R9", "s"), ("a", 60, "R0", "s")], "product string, lead_min int, rung string, season string")
    found = {(r.rung, r.season, r.lead_min): r.fallback for r in calibrate.find_table(wanted, tables).collect()}
    assert found == {("R1", "s", 30): 0, ("R0", "t", 30): 1, ("R9", "s", 30): 2, ("R0", "s", 60): None}
    everything = tables.where("rung = 'all'").first()
    x, y = calibrate.pool_adjacent(np.array([r[4] for r in rows[:400]]), np.array([r[5] for r in rows[:400]]))
    assert np.allclose(everything.x, x) and np.allclose(everything.y, y)


def test_fit_does_not_depend_on_partitions_or_hot_probabilities(spark):
    rng = np.random.default_rng(2)
    rows = [("a", 30, "R0", "s", 0.5 if i % 3 else float(rng.integers(0, 64)) / 64, float(rng.random() < 0.4), i, False) for i in range(3000)]
    x, y = calibrate.pool_adjacent(np.array([r[4] for r in rows]), np.array([r[5] for r in rows]))
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            t = calibrate.fit_isotonic(spark.createDataFrame(rows, CASES).repartition(5), "m", "r", 1).first()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert t.x == list(x) and t.y == list(y)


@pytest.mark.parametrize("change, message", [(("p", 1.5), "probability"), (("outcome", 2.0), "outcome"), (("outcome", None), "outcome"), (("research", True), "research-only")])
def test_cases_that_cannot_be_calibrated_raise(spark, change, message):
    cases = spark.createDataFrame([("a", 30, "R0", "s", 0.5, 1.0, 1, False)], CASES)
    column, value = change
    with pytest.raises(Exception, match=message):
        calibrate.fit_ladder(cases.withColumn(column, F.lit(value).cast(cases.schema[column].dataType)), "m", "r", 1, research_only="research").collect()
