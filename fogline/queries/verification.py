"""Pairing, splits and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.identity import manifest_hash
from fogline.operators import calibrate, metrics, pairing, splits
from fogline.queries import _carriers as C
from fogline.queries._registry import query

THRESHOLD = 50.0
_RATIOS = """
round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses)::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS pod,
round(CASE WHEN hits + false_alarms > 0 THEN false_alarms / (hits + false_alarms)::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS far,
round(CASE WHEN hits + misses + false_alarms > 0 THEN hits / (hits + misses + false_alarms)::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS csi,
round(CASE WHEN hits + misses > 0 THEN (hits + false_alarms) / (hits + misses)::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS bias,
round(CASE WHEN hits + misses + false_alarms - (hits + false_alarms) * (hits + misses) / n::DOUBLE <> 0
      THEN (hits - (hits + false_alarms) * (hits + misses) / n::DOUBLE) / (hits + misses + false_alarms - (hits + false_alarms) * (hits + misses) / n::DOUBLE)
      ELSE 'nan'::DOUBLE END, 6) AS ets"""
_COUNTS = """count(*) FILTER (WHERE f AND o) AS hits, count(*) FILTER (WHERE NOT f AND o) AS misses,
count(*) FILTER (WHERE f AND NOT o) AS false_alarms, count(*) FILTER (WHERE NOT f AND NOT o) AS correct_negatives, count(*) AS n"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events(spark, sf_dir).select("event_type", (F.col("user_id") % 5).alias("user_group"), F.col("value").alias("forecast"), F.col("k").cast("double").alias("observed"))


_PAIRS = f"{C.EVENTS}, p AS (SELECT event_type, user_id % 5 AS user_group, value AS forecast, k::DOUBLE AS observed, value >= {THRESHOLD} AS f, k >= {THRESHOLD} AS o FROM ev)"


@query(f"WITH {_PAIRS}, c AS (SELECT event_type, {_COUNTS} FROM p GROUP BY ALL) SELECT *, {_RATIOS} FROM c")
def categorical_scores(spark, sf_dir):
    return C.rounded(metrics.categorical_scores(metrics.contingency(_pairs(spark, sf_dir), ["event_type"], threshold=THRESHOLD)))


@query(f"WITH {_PAIRS}, c AS (SELECT user_group, {_COUNTS} FROM (SELECT user_group, forecast - 50 <> 0 AS f, observed <> 0 AS o FROM p) GROUP BY ALL) SELECT * FROM c")
def contingency_truthy(spark, sf_dir):
    """Without a threshold a value counts if it is nonzero."""
    pairs = _pairs(spark, sf_dir).withColumn("forecast", F.col("forecast") - 50)
    return C.rounded(metrics.contingency(pairs, ["user_group"]))


@query(f"WITH {_PAIRS}, c AS (SELECT event_type, user_group, GROUPING(event_type, user_group)::BIGINT AS level, {_COUNTS} FROM p GROUP BY CUBE (event_type, user_group)) SELECT *, {_RATIOS} FROM c")
def verification_cube(spark, sf_dir):
    return C.rounded(metrics.verification_cube(_pairs(spark, sf_dir), ["event_type", "user_group"], THRESHOLD))


def _cases(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = C.table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    return labels.join(docs, "doc_id").select("lang", F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("p"), F.col("quality").cast("double").alias("outcome"))


_CASES = "c AS (SELECT lang, least(1.0::DOUBLE, n_chars / 10000.0::DOUBLE) AS p, quality::DOUBLE AS o FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"""WITH {_CASES}, s AS (SELECT lang, avg((p - o) ** 2) AS b, avg((0.5 - o) ** 2) AS r, count(*) AS n FROM c GROUP BY lang)
SELECT lang, round(b, 6) AS brier, round(r, 6) AS brier_reference, n, round(1 - b / r, 6) AS bss FROM s""")
def brier_skill(spark, sf_dir):
    return C.rounded(metrics.brier_skill(_cases(spark, sf_dir), ["lang"], reference=0.5))


@query(f"""WITH {_CASES}, b AS (SELECT least(floor(p * 10), 9)::BIGINT AS bin, avg(p) AS m, avg(o) AS f, count(*) AS n FROM c GROUP BY ALL)
SELECT g.bin, round(g.bin / 10.0, 6)::DOUBLE AS low, round((g.bin + 1) / 10.0, 6)::DOUBLE AS high, round(m, 6) AS mean_forecast, round(f, 6) AS observed_frequency, coalesce(n, 0)::BIGINT AS count
FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.bin = g.bin""")
def reliability_bins(spark, sf_dir):
    return C.rounded(metrics.reliability(_cases(spark, sf_dir), 10))


def _ensembles(spark, sf_dir):
    return C.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("members"), (F.col("label") / 10.0 - 0.5).alias("observed"))


_MEMBERS = "e AS (SELECT vec_id, label, label / 10.0::DOUBLE - 0.5 AS o, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_CRPS = f"""WITH {_MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x) AS i, count(*) OVER (PARTITION BY vec_id) AS m FROM e),
c AS (SELECT vec_id, label, avg(abs(x - o)) - sum((2 * i - m - 1) * x) / (max(m) * max(m))::DOUBLE AS crps, count(*) AS members FROM r GROUP BY ALL) """


@query(_CRPS + "SELECT label::BIGINT AS label, round(avg(crps), 6) AS crps, count(*) AS n FROM c GROUP BY label")
def crps_by_label(spark, sf_dir):
    return C.rounded(metrics.crps(_ensembles(spark, sf_dir), ["label"]))


@query(_CRPS + "SELECT vec_id, round(crps, 6) AS crps, members FROM c")
def crps_long(spark, sf_dir):
    rows = _ensembles(spark, sf_dir).select("vec_id", "observed", F.explode("members").alias("value"))
    return C.rounded(metrics.crps_long(rows, "vec_id"))


@query(f"""WITH {_MEMBERS}, c AS (SELECT vec_id, label, max(o) AS o, avg(x) AS mean, stddev_pop(x) AS s FROM e GROUP BY ALL),
g AS (SELECT label, avg(s) AS spread, sqrt(avg((mean - o) ** 2)) AS rmse, count(*) AS n FROM c GROUP BY label)
SELECT label::BIGINT AS label, round(spread, 6) AS spread, round(rmse, 6) AS rmse, n, round(spread / rmse, 6) AS spread_skill FROM g""")
def spread_skill(spark, sf_dir):
    return C.rounded(metrics.spread_skill(_ensembles(spark, sf_dir), ["label"]))


@query(f"""WITH {_MEMBERS}, t AS (SELECT unnest([-0.1, 0.0, 0.1])::DOUBLE AS threshold)
SELECT threshold, label::BIGINT AS label, round(avg((x >= threshold)::INT), 6) AS probability FROM e, t GROUP BY ALL""")
def exceedance(spark, sf_dir):
    rows = _ensembles(spark, sf_dir).select("label", F.explode(F.col("members").cast("array<double>")).alias("value"))
    return C.rounded(metrics.exceedance(rows, [-0.1, 0.0, 0.1], ["label"]))


@query("""SELECT l_returnflag, l_linestatus, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 6) AS mae, round(sqrt(avg((l_extendedprice - 1000 * l_quantity) ** 2)), 6) AS rmse,
round(avg(l_extendedprice - 1000 * l_quantity), 6) AS mean_bias, count(*) AS n FROM lineitem GROUP BY ALL""")
def continuous_errors(spark, sf_dir):
    rows = C.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("forecast"), (1000 * F.col("l_quantity")).alias("observed"))
    return C.rounded(metrics.continuous_errors(rows, ["l_returnflag", "l_linestatus"]))


@query(f"WITH {C.EVENTS} SELECT event_type, round(avg((k >= 90)::INT), 6) AS abstention_rate, count(*) AS n FROM ev GROUP BY event_type")
def abstention_rate(spark, sf_dir):
    return C.rounded(metrics.abstention_rate(C.events(spark, sf_dir).withColumn("abstained", F.col("k") >= 90), ["event_type"]))


_PAIR_ROWS = """SELECT forecast_id, lead_min, forecast, truth_id, epoch_us(obs) // 1000000 AS obs_s, observed FROM (
SELECT f.forecast_id, f.lead_min, f.value AS forecast, t.truth_id, t.obs, t.value AS observed, row_number() OVER (PARTITION BY f.forecast_id ORDER BY t.obs, t.arrival, t.truth_id) AS nth
FROM f JOIN t ON {on} t.obs > f.issue AND t.obs <= f.issue + to_minutes(f.lead_min) {and_}) WHERE nth = 1"""


def _paired(pairs: DataFrame) -> DataFrame:
    return pairs.select("forecast_id", "lead_min", "forecast", "truth_id", F.unix_seconds(F.col("obs_time").cast("timestamp")).alias("obs_s"), "observed")


@query(f"WITH {C.PAIRING} " + _PAIR_ROWS.format(on="", and_=""))
def pair_asof(spark, sf_dir):
    return _paired(pairing.pair_first_after(C.forecasts(spark, sf_dir), C.truths(spark, sf_dir)))


@query(f"WITH {C.PAIRING} " + _PAIR_ROWS.format(on="", and_="AND t.arrival <= TIMESTAMP '2024-01-15 00:00:00'"))
def pair_asof_cutoff(spark, sf_dir):
    return _paired(pairing.pair_first_after(C.forecasts(spark, sf_dir), C.truths(spark, sf_dir), as_of="2024-01-15 00:00:00"))


@query(f"WITH {C.PAIRING} " + _PAIR_ROWS.format(on="f.user_id = t.user_id AND", and_=""))
def pair_by_user(spark, sf_dir):
    return _paired(pairing.pair_first_after(C.forecasts(spark, sf_dir), C.truths(spark, sf_dir), ["user_id"]))


@query(f"""WITH {C.EVENTS}, i AS (SELECT DISTINCT user_id, ts AS issue FROM ev WHERE event_type = 'signup'),
v AS (SELECT event_id AS frame_id, user_id, ts AS obs, ts + to_minutes(k) AS arrival FROM ev WHERE event_type = 'view'),
r AS (SELECT i.user_id, issue, frame_id, row_number() OVER (PARTITION BY i.user_id, issue ORDER BY obs DESC, frame_id DESC) AS back FROM i JOIN v ON i.user_id = v.user_id AND arrival <= issue),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, issue) AS n FROM r WHERE back <= 3)
SELECT user_id, epoch_us(issue) // 1000000 AS issue_s, frame_id, 4 - back AS nth FROM k WHERE n = 3""")
def latest_frames(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    issues = rows.where("event_type = 'signup'").select("user_id", F.col("ts").alias("issue_time")).distinct()
    seen = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("frame_id"), F.col("ts").alias("obs_time"), (F.col("ts") + F.make_dt_interval(mins=F.col("k").cast("int"))).alias("arrival_time"))
    found = pairing.latest_frames(issues, seen, 3, ["user_id"])
    return found.select("user_id", F.unix_seconds(F.col("issue_time").cast("timestamp")).alias("issue_s"), "frame_id", F.col("nth").cast("long").alias("nth"))


WINDOWS = {"train": ["1995-01-01/1998-12-31"], "validation": ["1999-01-01/1999-12-31"], "test": ["2000-01-01/2001-12-31"]}
_WINDOWS = """w AS (SELECT * FROM (VALUES ('train', TIMESTAMP '1995-01-01', TIMESTAMP '1999-01-01'), ('validation', TIMESTAMP '1999-01-01', TIMESTAMP '2000-01-01'),
('test', TIMESTAMP '2000-01-01', TIMESTAMP '2002-01-01')) x(split, a, b))"""
_CHRONO = f"WITH {C.FRAMES}, {_WINDOWS}, s AS (SELECT frame_id, split, event_id FROM fr JOIN w ON tm >= a + INTERVAL 6 HOUR AND tm < b - INTERVAL 6 HOUR) "


@query(_CHRONO + "SELECT frame_id, split FROM s")
def split_chronological(spark, sf_dir):
    return splits.split(C.frames(spark, sf_dir), "chronological", allow_leaks=True, windows=WINDOWS, buffer_hours=6)


@query(_CHRONO + "SELECT event_id AS manifest_id, count(DISTINCT split) AS splits FROM s GROUP BY event_id HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf_dir):
    found = C.frames(spark, sf_dir)
    return splits.leaked_manifests(found, splits.chronological(found, WINDOWS, 6))


@query(f"""WITH {C.FRAMES}, g AS (SELECT event_id, row_number() OVER (ORDER BY min(tm), event_id) AS nth, count(*) OVER () AS n FROM fr GROUP BY event_id)
SELECT frame_id, CASE WHEN nth <= greatest(floor(n * 0.7::DOUBLE), 1) THEN 'train' WHEN nth <= greatest(floor(n * 0.7::DOUBLE), 1) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split
FROM fr JOIN g USING (event_id)""")
def split_event_grouped(spark, sf_dir):
    return splits.split(C.frames(spark, sf_dir), "event_grouped")


@query(f"""WITH {C.FRAMES}, d AS (SELECT frame_id, strftime(tm, '%Y-%m-%d') AS day, tm FROM fr),
g AS (SELECT DISTINCT day, CASE WHEN tm < TIMESTAMP '1999-01-01' THEN 'train' WHEN tm < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS split FROM d)
SELECT frame_id, split FROM d JOIN g USING (day)""")
def split_event_windows(spark, sf_dir):
    """Frames without an event are grouped by UTC date."""
    return splits.split(C.frames(spark, sf_dir).withColumn("event_id", F.lit(None).cast("string")), "event_grouped", allow_leaks=True, windows=WINDOWS)


REGIONS = {"train": ["AFRICA", "AMERICA", "ASIA"], "validation": ["EUROPE"], "test": ["MIDDLE EAST"]}


@query(f"WITH {C.FRAMES} SELECT frame_id, CASE domain WHEN 'EUROPE' THEN 'validation' WHEN 'MIDDLE EAST' THEN 'test' ELSE 'train' END AS split FROM fr")
def split_geographic(spark, sf_dir):
    return splits.split(C.frames(spark, sf_dir), "geographic_holdout", members=REGIONS)


@query(f"WITH {C.FRAMES} SELECT frame_id, CASE season WHEN 'monsoon' THEN 'train' ELSE 'test' END AS split FROM fr WHERE season IN ('monsoon', 'winter')")
def split_seasonal(spark, sf_dir):
    return splits.split(C.frames(spark, sf_dir), "seasonal_holdout", allow_leaks=True, members={"train": ["monsoon"], "test": ["winter"]})


@query(f"""WITH {C.FRAMES} SELECT domain, sha256('{{"manifest_ids":[' || string_agg(DISTINCT '"' || event_id || '"', ',' ORDER BY '"' || event_id || '"') || '],"versions":{{"grid":1}}}}') AS data_hash FROM fr GROUP BY domain""")
def data_hashes(spark, sf_dir):
    """Hash of the manifests that each domain's frames were read from."""
    rows = C.frames(spark, sf_dir).select("domain", F.explode("manifest_ids").alias("manifest_id"))
    return manifest_hash(rows, ["domain"], versions={"grid": 1})


def _calibration_cases(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    return rows.select(
        F.col("event_type").alias("product"), (30 * (1 + F.col("user_id") % 2)).cast("int").alias("lead_min"), F.lit("R1").alias("rung"), F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late").alias("season"),
        F.round(F.least(F.col("value") / 500, F.lit(1.0)), 2).alias("p"), (F.col("k") >= 50).cast("double").alias("outcome"), F.col("event_id").alias("ordinal"),
    )


@query()
def calibration_fit(spark, sf_dir):
    """Isotonic tables per product, lead, rung and season."""
    return calibrate.fit_isotonic(_calibration_cases(spark, sf_dir), "model-1", "run-1", min_positive=20).drop("calibration_id")


_TABLES = [("click", 30, "R1", "early", [0.2, 0.8], [0.1, 0.7]), ("view", 30, "R1", "all", [0.5], [0.4]), ("signup", 30, "all", "all", [0.0, 0.5, 1.0], [0.0, 0.2, 0.9])]


@query(f"""WITH {C.EVENTS}, c AS (SELECT event_id, event_type, (30 * (1 + user_id % 2))::BIGINT AS lead_min, day(ts) <= 15 AS early, round(least(value / 500, 1.0), 2) AS p FROM ev),
l AS (SELECT *, CASE WHEN lead_min <> 30 THEN NULL WHEN event_type = 'click' AND early THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type = 'signup' THEN 2 END AS fallback FROM c)
SELECT event_id, fallback::BIGINT AS fallback, round(CASE fallback WHEN 0 THEN 0.1 + least(greatest(p - 0.2, 0), 0.6) WHEN 1 THEN 0.4
  WHEN 2 THEN CASE WHEN p <= 0.5 THEN p * 0.4 ELSE 0.2 + (p - 0.5) * 1.4 END END, 6)::DOUBLE AS calibrated FROM l""")
def calibration_predict(spark, sf_dir):
    """Own table, else that of all seasons, else that of all rungs; null where none is left."""
    tables = spark.createDataFrame([(*t, f"cal-{i}", 3000) for i, t in enumerate(_TABLES)], "product string, lead_min int, rung string, season string, x array<double>, y array<double>, calibration_id string, positive_count long")
    found = calibrate.find_table(_calibration_cases(spark, sf_dir).withColumnRenamed("ordinal", "event_id"), tables)
    return C.rounded(found.select("event_id", "fallback", calibrate.predict(F.col("p"), F.col("x"), F.col("y")).alias("calibrated")))
