"""Operational metrics by window and alert intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from fogline.operators import operations
from fogline.queries import _carriers as C
from fogline.queries._registry import query


@query(f"""WITH {C.EVENTS} SELECT event_type AS domain, epoch_us(date_trunc('day', ts)) // 1000000 AS day_s, count(*) AS cycles, count(*) FILTER (WHERE k % 4 = 1) AS abstained,
round(quantile_disc(value, 0.95), 6) AS latency_s, (arg_max(k % 5, struct_pack(t := ts, k := k % 5)))::BIGINT AS rung, round(count(*) FILTER (WHERE k % 4 = 1) / count(*)::DOUBLE, 6) AS abstention_rate FROM ev GROUP BY ALL""")
def operations_by_day(spark, sf_dir):
    """Latency p95, rung and abstentions a day, from windows of six hours whose counts are merged."""
    k = F.col("k")
    cycles = C.events(spark, sf_dir).select(F.col("event_type").alias("domain"), F.col("ts").alias("at"), F.col("value").alias("latency_s"), (k % 5).alias("rung"), (k % 4 == 1).alias("abstained"))
    found = operations.window_report(operations.merge_windows(operations.cycle_windows(cycles, 360), 1440))
    return C.rounded(found.select("domain", F.unix_seconds("window_start").alias("day_s"), "cycles", "abstained", "latency_s", "rung", "abstention_rate"))


@query(f"""WITH {C.EVENTS} SELECT event_type AS domain, CASE k % 3 WHEN 0 THEN 'no_radar' WHEN 1 THEN 'ood' ELSE 'unknown' END AS reason, epoch_us(ts) // 900000000 * 900 AS window_s, count(*) AS n, round(count(*) / 15.0::DOUBLE, 6) AS per_min FROM ev WHERE k < 50 GROUP BY ALL""")
def abstentions_by_reason(spark, sf_dir):
    rows = C.events(spark, sf_dir).where("k < 50").select(F.col("event_type").alias("domain"), F.col("ts").alias("at"), F.element_at(F.array(F.lit("no_radar"), F.lit("ood"), F.lit(" ")), (F.col("k") % 3 + 1).cast("int")).alias("reason"))
    found = operations.abstention_windows(rows, 15)
    return C.rounded(found.select("domain", "reason", F.unix_seconds("window_start").alias("window_s"), "n", "per_min"))


_HOURS = 6 * 60


@query(f"""WITH {C.EVENTS}, r AS (SELECT * FROM (VALUES ('source_stale', 'warning', 'click', 900.0, 10, false), ('cycle_overrun', 'warning', 'view', 240.0, 10, false), ('rung_degraded', 'warning', 'purchase', 3.0, 30, true)) x(alert, severity, event_type, lim, hold, inc)),
s AS (SELECT alert, severity, user_id % 3 AS series, ts, hold, bool_or(CASE event_type WHEN 'click' THEN value * 10 WHEN 'view' THEN value * 3 ELSE k % 7 END > lim OR inc AND k % 7 = 3) AS o FROM ev JOIN r USING (event_type) GROUP BY ALL),
g AS (SELECT *, lag(o) OVER w IS DISTINCT FROM o OR ts - lag(ts) OVER w > INTERVAL {_HOURS} MINUTE AS b, lead(ts) OVER w AS later FROM s WINDOW w AS (PARTITION BY alert, series ORDER BY ts)),
n AS (SELECT *, sum(b::INT) OVER (PARTITION BY alert, series ORDER BY ts) AS run FROM g),
f AS (SELECT alert, severity, series, any_value(hold) AS hold, min(ts) AS a, max(ts) AS z, list(later ORDER BY ts DESC)[1] AS later, count(*) AS samples FROM n WHERE o GROUP BY alert, severity, series, run)
SELECT alert, severity, series, epoch_us(a) // 1000000 AS started_s, epoch_us(a) // 1000000 + hold * 60 AS fired_s, epoch_us(CASE WHEN later - z <= INTERVAL {_HOURS} MINUTE THEN later ELSE z + INTERVAL {_HOURS} MINUTE END) // 1000000 AS ended_s, samples
FROM f WHERE z - a >= to_minutes(hold)""")
def operation_alerts(spark, sf_dir):
    """Intervals in which three of the rules fire on series that are sampled every few hours."""
    k, kind = F.col("k"), F.col("event_type")
    metric = F.create_map(*[F.lit(x) for kv in (("click", "source_age_seconds"), ("view", "cycle_latency_p95_seconds"), ("purchase", "current_rung")) for x in kv])[kind]
    value = F.when(kind == "click", F.col("value") * 10).when(kind == "view", F.col("value") * 3).otherwise(k % 7)
    samples = C.events(spark, sf_dir).select(metric.alias("metric"), (F.col("user_id") % 3).alias("series"), F.col("ts").alias("at"), value.alias("value"))
    found = operations.alert_intervals(samples, stale_min=_HOURS)
    s = lambda c: F.unix_seconds(c).alias(f"{c}_s")
    return C.rounded(found.select("alert", "severity", "series", s("started"), s("fired"), s("ended"), "samples"))
