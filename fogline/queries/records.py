"""Verification records with intervals, and calibration on all levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.operators import bootstrap, calibrate
from fogline.plans import records
from fogline.queries import _carriers as C
from fogline.queries._registry import query

THRESHOLDS, REPLICATES = (50.0, 90.0), 40


def record_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pairs: the day is the block, two constant or damped forecasts are the baselines."""
    rows = C.events(spark, sf_dir)
    return rows.select(
        F.col("event_type").alias("product"), (30 * (1 + F.col("user_id") % 2)).alias("lead_min"), F.concat(F.lit("g"), F.col("user_id") % 3).alias("region"),
        F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late").alias("season"), F.concat(F.lit("R"), F.col("k") % 2).alias("rung"), F.date_format("ts", "yyyy-MM-dd").alias("block"),
        F.col("value").alias("forecast"), F.col("k").cast("double").alias("observed"), F.lit(60.0).alias("climatology"), (F.col("value") * 0.5 + 30).alias("damped"),
    )


SPEC = records.RecordSpec(THRESHOLDS, {"climatology": "climatology", "damped": "damped"}, period="2024", data_manifest_hash="abc", model_versions=("m1",), replicates=REPLICATES)
_DRAWN = " + ".join(f"(u >= {s})::INT" for s in bootstrap.poisson_steps())
_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(md5('0|' || block || '|' || (b // 8)), 4 * (b % 8) + {i + 1}, 1)) - 1) * {16 ** (3 - i)}" for i in range(4))
#: Draws of every block, replicate 0 with weight 1, for a relation of blocks.
WEIGHTS = f"""u AS (SELECT block, b, {_HEX} AS u FROM (SELECT DISTINCT block FROM base) x, (SELECT unnest(range({REPLICATES})) AS b) y),
wt AS (SELECT block, b + 1 AS replicate, {_DRAWN} AS w FROM u UNION ALL SELECT DISTINCT block, 0, 1 FROM base)"""
_NAN = "'nan'::DOUBLE"


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) <> 0 THEN ({num})::DOUBLE / ({den})::DOUBLE ELSE {_NAN} END"


_CHANCE = _ratio("(h + fa) * (h + mi)", "n")
_SCORES = {"pod": _ratio("h", "h + mi"), "far": _ratio("fa", "h + fa"), "csi": _ratio("h", "h + mi + fa"), "bias": _ratio("h + fa", "h + mi"), "ets": _ratio(f"h - ({_CHANCE})", f"h + mi + fa - ({_CHANCE})")}
_LONG = "\nUNION ALL ".join(
    [f"SELECT * EXCLUDE (h, mi, fa, e, ae, se), '{m}' AS metric, {x} AS value FROM r WHERE threshold IS NOT NULL" for m, x in _SCORES.items()]
    + [f"SELECT * EXCLUDE (h, mi, fa, e, ae, se), '{m}' AS metric, {x} AS value FROM r WHERE threshold IS NULL" for m, x in (("mae", "ae / n"), ("mean_bias", "e / n"), ("rmse", "sqrt(se / n)"))]
)


@query(f"""WITH {C.EVENTS},
p AS (SELECT event_type AS product, (30 * (1 + user_id % 2))::INTEGER AS lead_min, 'g' || (user_id % 3) AS region, CASE WHEN day(ts) <= 15 THEN 'early' ELSE 'late' END AS season, 'R' || (k % 2) AS rung,
  strftime(ts, '%Y-%m-%d') AS block, k::DOUBLE AS o, unnest([{{'name': '', 'f': value}}, {{'name': 'climatology', 'f': 60.0::DOUBLE}}, {{'name': 'damped', 'f': value * 0.5 + 30}}], recursive := true) FROM ev),
t AS (SELECT unnest([NULL, {', '.join(map(str, THRESHOLDS))}])::DOUBLE AS threshold),
g AS (SELECT unnest([true, false]) AS total),
base AS (SELECT product, lead_min, threshold, CASE WHEN a.total THEN 'all' ELSE region END AS region, CASE WHEN b.total THEN 'all' ELSE season END AS season, CASE WHEN c.total THEN 'all' ELSE rung END AS rung, name, block,
  count(*) FILTER (WHERE f >= threshold AND o >= threshold) AS h, count(*) FILTER (WHERE f < threshold AND o >= threshold) AS mi, count(*) FILTER (WHERE f >= threshold AND o < threshold) AS fa,
  sum(f - o) AS e, sum(abs(f - o)) AS ae, sum((f - o) ** 2) AS se, count(*) AS n FROM p, t, g a, g b, g c GROUP BY ALL),
{WEIGHTS},
r AS (SELECT product, lead_min, threshold, region, season, rung, name, replicate, sum(w * h) AS h, sum(w * mi) AS mi, sum(w * fa) AS fa, sum(w * e) AS e, sum(w * ae) AS ae, sum(w * se) AS se, sum(w * n) AS n
  FROM base JOIN wt USING (block) WHERE w > 0 GROUP BY ALL),
l AS ({_LONG}),
q AS (SELECT product, lead_min, threshold, region, season, rung, name, metric, max(value) FILTER (WHERE replicate = 0) AS value, max(n) FILTER (WHERE replicate = 0) AS n,
  quantile_cont(value, 0.025) FILTER (WHERE replicate > 0 AND NOT isnan(value)) AS low, quantile_cont(value, 0.975) FILTER (WHERE replicate > 0 AND NOT isnan(value)) AS high FROM l GROUP BY ALL)
SELECT '{SPEC.run_id()}' AS run_id, product, lead_min::BIGINT AS lead_min, coalesce(threshold::INTEGER::VARCHAR, 'none') AS threshold, region, season, rung, metric, round(max(value) FILTER (WHERE name = '') + 1e-9, 6) AS value, (max(n) FILTER (WHERE name = ''))::BIGINT AS n,
round(max(value) FILTER (WHERE name = 'climatology') + 1e-9, 6) AS climatology, round(max(value) FILTER (WHERE name = 'damped') + 1e-9, 6) AS damped, round(max(low) FILTER (WHERE name = '') + 1e-9, 6) AS ci_low, round(max(high) FILTER (WHERE name = '') + 1e-9, 6) AS ci_high,
'F-M0-' || upper(metric) || '-' || coalesce(threshold::INTEGER::VARCHAR, 'none') || '-' || region || '-2024' AS figure_id
FROM q WHERE NOT isnan(value) GROUP BY product, lead_min, q.threshold, region, season, rung, metric HAVING count(*) FILTER (WHERE name = '') > 0""")
def verification_records(spark, sf_dir):
    """Every score with its interval and baselines, by product and lead, with totals over region, season and rung."""
    found = records.records(record_pairs(spark, sf_dir), SPEC)
    shift = lambda c: c + 1e-9  # noqa: E731  off the ties of rounding
    return C.rounded(found.select(
        "run_id", "product", "lead_min", "threshold", "region", "season", "rung", "metric", shift(F.col("value")).alias("value"), "n",
        shift(F.col("baseline")["climatology"]).alias("climatology"), shift(F.col("baseline")["damped"]).alias("damped"), shift(F.col("ci95")[0]).alias("ci_low"), shift(F.col("ci95")[1]).alias("ci_high"), "figure_id",
    ))


#: Cases with probabilities in 64ths, whose sums are exact.
_CASES = f"""{C.EVENTS}, k AS (SELECT event_id, event_type AS product, (30 * (1 + user_id % 2))::INTEGER AS lead_min, 'R' || (k % 2) AS rung, CASE WHEN day(ts) <= 15 THEN 'early' ELSE 'late' END AS season,
  floor(64 * least(value / 500, 1.0)) / 64 AS p, ((value / 5 + k) > 60)::INT AS y FROM ev),
c AS (SELECT event_id, product, lead_min, p, y, CASE WHEN l < 2 THEN rung ELSE 'all' END AS rung, CASE WHEN l < 1 THEN season ELSE 'all' END AS season FROM k, (SELECT unnest([0, 1, 2]) AS l) x),
t AS (SELECT product, lead_min, rung, season, sum(y)::BIGINT AS positive_count FROM c GROUP BY ALL HAVING sum(y) >= {{least}})"""
LEAST_POSITIVE = 40


def _cases(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    return rows.select(
        F.col("event_type").alias("product"), (30 * (1 + F.col("user_id") % 2)).cast("int").alias("lead_min"), F.concat(F.lit("R"), F.col("k") % 2).alias("rung"), F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late").alias("season"),
        (F.floor(64 * F.least(F.col("value") / 500, F.lit(1.0))) / 64).alias("p"), (F.col("value") / 5 + F.col("k") > 60).cast("double").alias("outcome"), F.col("event_id").alias("ordinal"),
    )


@query(f"""WITH {_CASES.format(least=LEAST_POSITIVE)},
s AS (SELECT product, lead_min, rung, season, p, y, row_number() OVER w AS i, sum(y) OVER w AS sy FROM c JOIN t USING (product, lead_min, rung, season) WINDOW w AS (PARTITION BY product, lead_min, rung, season ORDER BY p, event_id)),
g AS (SELECT a.product, a.lead_min, a.rung, a.season, a.i, any_value(a.p) AS p, any_value(a.y) AS y, min((b.sy - a.sy + a.y)::DOUBLE / (b.i - a.i + 1)) AS low
  FROM s a JOIN s b ON a.product = b.product AND a.lead_min = b.lead_min AND a.rung = b.rung AND a.season = b.season AND b.i >= a.i GROUP BY ALL),
h AS (SELECT *, coalesce(low >= max(low) OVER (PARTITION BY product, lead_min, rung, season ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS starts FROM g),
b AS (SELECT *, sum(starts::INT) OVER (PARTITION BY product, lead_min, rung, season ORDER BY i) AS block FROM h),
x AS (SELECT product, lead_min, rung, season, block, sum(p) / count(*) AS x, sum(y)::DOUBLE / count(*) AS y FROM b GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY product, lead_min, rung, season, x ORDER BY block) AS copy FROM x)
SELECT product, lead_min::BIGINT AS lead_min, rung, season, positive_count, row_number() OVER (PARTITION BY product, lead_min, rung, season ORDER BY block) - 1 AS knot, round(x, 6) AS x, round(y, 6) AS y
FROM f JOIN t USING (product, lead_min, rung, season) WHERE copy = 1""")
def calibration_ladder(spark, sf_dir):
    """Knots of the isotonic fits of all keys, all seasons and all rungs; in SQL by the min-max formula."""
    tables = calibrate.fit_ladder(_cases(spark, sf_dir), "model-1", "run-1", LEAST_POSITIVE)
    knots = tables.select("product", "lead_min", "rung", "season", "positive_count", F.posexplode(F.arrays_zip("x", "y")).alias("knot", "at"))
    return C.rounded(knots.select("product", "lead_min", "rung", "season", "positive_count", "knot", "at.x", "at.y"))


@query(f"""WITH {_CASES.format(least=LEAST_POSITIVE)}, w AS (SELECT DISTINCT product, lead_min, rung, season FROM k)
SELECT w.product, w.lead_min::BIGINT AS lead_min, w.rung, w.season, CASE WHEN a.positive_count IS NOT NULL THEN 0 WHEN b.positive_count IS NOT NULL THEN 1 WHEN d.positive_count IS NOT NULL THEN 2 END::BIGINT AS fallback,
coalesce(a.positive_count, b.positive_count, d.positive_count) AS positive_count
FROM w LEFT JOIN t a ON a.product = w.product AND a.lead_min = w.lead_min AND a.rung = w.rung AND a.season = w.season LEFT JOIN t b ON b.product = w.product AND b.lead_min = w.lead_min AND b.rung = w.rung AND b.season = 'all'
LEFT JOIN t d ON d.product = w.product AND d.lead_min = w.lead_min AND d.rung = 'all' AND d.season = 'all'""")
def calibration_fallback(spark, sf_dir):
    """Which step of the ladder serves each key."""
    cases = _cases(spark, sf_dir)
    found = calibrate.find_table(cases.select("product", "lead_min", "rung", "season").distinct(), calibrate.fit_ladder(cases, "model-1", "run-1", LEAST_POSITIVE))
    return C.rounded(found.select("product", "lead_min", "rung", "season", "fallback", "positive_count"))
