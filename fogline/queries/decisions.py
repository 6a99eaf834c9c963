"""Quality control, features, tiers and decision rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from fogline.operators import decide, features, qc
from fogline.queries import _carriers as C
from fogline.queries._registry import query

#: Event types stand for channels of the rule tables.
_RADAR = {"click": "zmax", "view": "vil", "purchase": "mesh", "signup": "vr_lowest", "error": "marc"}
_SAT = {"click": "ir1", "view": "wv", "purchase": "vis", "signup": "wv_minus_ir1", "error": "ot_score"}
_NWP = {"click": "cape", "view": "cin", "purchase": "shear06", "signup": "pwat", "error": "precip_rate"}


def _cells(spark, sf_dir, names: dict[str, str]):
    rows = C.events(spark, sf_dir)
    channel = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return rows.select("event_id", F.dayofmonth("ts").alias("day"), channel.alias("channel"), "value", (F.col("k") >= 5).alias("mask"), (F.col("k") % 7 == 0).alias("blocked"))


def _cells_sql(names: dict[str, str], ranges: dict[str, tuple[float, float]]) -> str:
    rows = ", ".join(f"('{t}', '{c}', {ranges[c][0]}::FLOAT, {ranges[c][1]}::FLOAT)" for t, c in names.items())
    return f"""{C.EVENTS}, b AS (SELECT * FROM (VALUES {rows}) x(event_type, channel, lo, hi)),
q AS (SELECT event_id, day(ts) AS day, channel, value, k, k >= 5 AS mask, k % 7 = 0 AS blocked, value::FLOAT BETWEEN lo AND hi AS inside FROM ev JOIN b USING (event_type))"""


def _summary(summary):
    cols = [c for c in ("missing_reason",) if c in summary.columns]
    return C.rounded(summary.withColumn("flags", F.array_join("flags", ","))).select("day", "channel", "coverage", "missing", "flags", *cols)


_COVER = "round(avg((ok)::INT), 6) AS coverage, NOT bool_or(ok) AS missing"
_BASE_FLAGS = "CASE WHEN NOT bool_or(ok) THEN 'no_valid_pixels' END, CASE WHEN bool_or(NOT inside) THEN 'physical_range_rejected' END"


def _flags_sql(*more: str) -> str:
    return f"array_to_string(list_sort(list_filter([{', '.join([_BASE_FLAGS, *more])}], lambda x: x IS NOT NULL)), ',') AS flags"


@query(f"WITH {C.EVENTS} SELECT event_id, (k >= 5 AND value::FLOAT BETWEEN 100.0::FLOAT AND 400.0::FLOAT) AS valid, NOT (value::FLOAT BETWEEN 100.0::FLOAT AND 400.0::FLOAT) AS rejected, false AS non_finite, round(CASE WHEN k >= 5 AND value::FLOAT BETWEEN 100.0::FLOAT AND 400.0::FLOAT THEN value::FLOAT::DOUBLE ELSE 0.0 END, 4) AS value_qc FROM ev")
def bounded_qc(spark, sf_dir):
    out = qc.bounded(_cells(spark, sf_dir, _RADAR), 100.0, 400.0)
    return out.select("event_id", "valid", "rejected", "non_finite", F.round(F.col("value_qc").cast("double"), 4).alias("value_qc"))


@query(f"WITH {_cells_sql(_SAT, qc.SATELLITE_RANGES)}, s AS (SELECT *, mask AND inside AS ok FROM q) SELECT day, channel, {_COVER}, {_flags_sql(chr(39) + 'uncalibrated' + chr(39))} FROM s GROUP BY ALL")
def qc_satellite(spark, sf_dir):
    return _summary(qc.satellite(_cells(spark, sf_dir, _SAT), ["day"])[1])


@query(f"""WITH {_cells_sql(_RADAR, qc.RADAR_RANGES)}, s AS (SELECT *, mask AND NOT blocked AND inside AND channel NOT IN ('vr_lowest', 'marc') AS ok FROM q)
SELECT day, channel, {_COVER}, {_flags_sql("CASE WHEN bool_or(blocked) THEN 'blocked_pixels' END", "CASE WHEN channel IN ('vr_lowest', 'marc') THEN 'no_velocity' END")} FROM s GROUP BY day, channel""")
def qc_radar(spark, sf_dir):
    return _summary(qc.radar(_cells(spark, sf_dir, _RADAR), ["day"], has_velocity=False)[1])


@query(f"""WITH {_cells_sql(_NWP, qc.NWP_RANGES)}, t AS (SELECT *, CASE WHEN day % 3 = 0 THEN 'nwp_cycle_unknown' WHEN day % 3 = 1 THEN 'nwp_not_arrived' END AS why FROM q),
s AS (SELECT *, mask AND inside AND why IS NULL AS ok FROM t)
SELECT day, channel, {_COVER}, CASE WHEN min(why) IS NOT NULL THEN min(why) ELSE {_flags_sql()[:-9]} END AS flags, min(why) AS missing_reason FROM s GROUP BY ALL""")
def qc_nwp(spark, sf_dir):
    at = lambda text: F.lit(text).cast("timestamp")
    cycle = F.when(F.col("day") % 3 != 0, at("2024-01-01 00:00:00"))
    arrival = F.when(F.col("day") % 3 == 1, at("2024-01-01 06:00:01")).otherwise(at("2024-01-01 05:00:00"))
    return _summary(qc.nwp(_cells(spark, sf_dir, _NWP), ["day"], cycle, arrival, at("2024-01-01 06:00:00"))[1])


@query(f"""WITH {C.EVENTS}, s AS (SELECT day(ts) AS day, event_type AS channel, value >= 0 AS inside, k >= 5 AND value >= 0 AS ok FROM ev)
SELECT day, channel, {_COVER}, {_flags_sql("'ltg_bad_health'")}, 'ltg_bad_health' AS missing_reason FROM s GROUP BY ALL""")
def qc_lightning(spark, sf_dir):
    """Bad health is flagged and masks nothing."""
    cells = _cells(spark, sf_dir, {t: t for t in _RADAR})
    return _summary(qc.lightning(cells, ["day"], access_verified=True, health=0.0)[1])


@query(f"""WITH {C.EVENTS} SELECT event_id, CASE WHEN (k - 10) * 60 < -300 THEN 'future' WHEN (k - 10) * 60 > 3600 THEN 'stale' END AS freshness,
round(greatest(0.0, (k - 10)::DOUBLE), 6) AS age_min, (k - 10) <= 30 AS available FROM ev""")
def freshness(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    arrival = F.col("ts") + F.make_dt_interval(mins=(F.col("k") - 10).cast("int"))
    limit = F.col("ts") + F.make_dt_interval(mins=F.lit(30))
    return C.rounded(rows.select("event_id", qc.freshness(F.col("ts"), arrival, 3600).alias("freshness"), qc.age_minutes(F.col("ts"), arrival).alias("age_min"), qc.available(arrival, limit).alias("available")))


_VALID = "value BETWEEN 50 AND 450 AND k >= 10"
_CONTRACT = features.FeatureContract(("click", "view", "purchase", "signup", "error"), (200.0, 150.0, 100.0, 50.0, 250.0), (80.0, 60.0, 40.0, 20.0, 100.0), (50.0,) * 5, (450.0,) * 5)


@query(f"""WITH {C.EVENTS}, s AS (SELECT * FROM (VALUES ('click', 0, 200.0::DOUBLE, 80.0::DOUBLE), ('view', 1, 150.0, 60.0), ('purchase', 2, 100.0, 40.0), ('signup', 3, 50.0, 20.0), ('error', 4, 250.0, 100.0)) x(event_type, pos, mean, std))
SELECT event_id, event_type AS channel, pos::BIGINT AS pos, ({_VALID}) AS valid, round(CASE WHEN {_VALID} THEN (value - mean) / std ELSE 0.0 END, 6) AS normal FROM ev JOIN s USING (event_type)""")
def normalize(spark, sf_dir):
    rows = C.events(spark, sf_dir).select("event_id", F.col("event_type").alias("channel"), "value", (F.col("k") >= 10).alias("mask"))
    return C.rounded(features.normalize(rows, _CONTRACT)).select("event_id", "channel", "pos", "valid", "normal")


@query(f"""WITH {C.EVENTS}, n AS (SELECT event_id, list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type) - 1 AS pos, ({_VALID}) AS ok,
CASE event_type WHEN 'click' THEN (value - 200) / 80 WHEN 'view' THEN (value - 150) / 60 WHEN 'purchase' THEN (value - 100) / 40 WHEN 'signup' THEN (value - 50) / 20 ELSE (value - 250) / 100 END AS z, k FROM ev)
SELECT event_id, pos::BIGINT AS plane, round(CASE WHEN ok THEN z ELSE 0.0 END, 6)::DOUBLE AS value FROM n UNION ALL SELECT event_id, pos + 5, ok::INT::DOUBLE FROM n UNION ALL SELECT event_id, pos + 10, round(least(k / 60.0, 2.0), 6)::DOUBLE FROM n""")
def model_tensor(spark, sf_dir):
    rows = C.events(spark, sf_dir).select("event_id", F.col("event_type").alias("channel"), "value", (F.col("k") >= 10).alias("mask"), F.col("k").alias("age_min"))
    return C.rounded(features.model_tensor(features.normalize(rows, _CONTRACT), _CONTRACT).select("event_id", "plane", "value"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), w AS (SELECT user_id, channel FROM u, (SELECT unnest(['click', 'view', 'never']) AS channel))
SELECT * FROM w WHERE (user_id, channel) NOT IN (SELECT user_id, event_type FROM events)""")
def missing_channels(spark, sf_dir):
    contract = features.FeatureContract(("click", "view", "never"), (0.0,) * 3, (1.0,) * 3, (0.0,) * 3, (1.0,) * 3)
    live = C.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("channel"))
    return features.missing_channels(live, contract, ["user_id"])


@query(f"""WITH {C.EVENTS}, v AS (SELECT event_id, sqrt((value - 200) ** 2 / (6400 + 1e-6) + (k - 50) ** 2 / (900 + 1e-6)) AS d,
sqrt((2.000001::DOUBLE * (value - 200) ** 2 - 2 * (value - 200) * (k - 50) + 2.000001::DOUBLE * (k - 50) ** 2) / (2.000001::DOUBLE ** 2 - 1)) AS full_d FROM ev)
SELECT event_id, round(d, 6) AS score, d > 1.5 AS ood, round(full_d, 5) AS full_score FROM v""")
def ood(spark, sf_dir):
    """Distance by variances, and by a full covariance."""
    rows = C.events(spark, sf_dir).select("event_id", F.array(F.col("value"), F.col("k").cast("double")).alias("vector"))
    diagonal = features.mahalanobis(rows, [200.0, 50.0], [6400.0, 900.0], 1.5)
    full = features.mahalanobis(diagonal.withColumnsRenamed({"score": "d", "ood": "far"}), [200.0, 50.0], [[2.0, 1.0], [1.0, 2.0]])
    return full.select("event_id", C.r6(F.col("d")).alias("score"), F.col("far").alias("ood"), F.round("score", 5).alias("full_score"))


_STATUS = f"""{C.EVENTS}, s AS (SELECT user_id, day(ts) AS day, min(k) AS age, count(*) AS n, max(k) AS top, avg(value) / 500 AS cover,
bool_or(event_type = 'view') AS sat, bool_or(event_type = 'purchase') AS radar, bool_or(event_type = 'click') AS ltg, bool_or(event_type IN ('signup', 'error')) AS nwp FROM ev GROUP BY ALL)"""


def _status(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    has = lambda *t: F.bool_or(F.col("event_type").isin(*t))
    return rows.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(
        F.min("k").alias("age"), F.count(F.lit(1)).alias("n"), F.max("k").alias("top"), (F.avg("value") / 500).alias("cover"),
        has("view").alias("satellite_valid"), has("purchase").alias("radar_valid"), has("click").alias("lightning_valid"), has("signup", "error").alias("nwp_valid"),
    )


@query(f"""WITH {_STATUS}, t AS (SELECT *, n > 6 AS ood, top < 99 AS ok, sat AND age <= 45 AS s1, radar AND age <= 20 AND cover >= 0.3 AS r1, ltg AND age <= 10 AS l1 FROM s)
SELECT user_id, day, CASE WHEN ood OR NOT ok THEN 'R4' WHEN r1 AND s1 AND l1 AND nwp THEN 'R0' WHEN s1 AND l1 AND nwp THEN 'R1' WHEN s1 AND nwp THEN 'R2' WHEN nwp THEN 'R3' ELSE 'R4' END AS rung,
CASE WHEN ood THEN 'ood' WHEN NOT ok THEN 'contract_violation' WHEN r1 AND s1 AND l1 AND nwp THEN '' WHEN s1 AND nwp THEN 'no_radar,no_velocity' WHEN nwp THEN 'sat_missing' ELSE 'nwp_missing' END AS reasons FROM t""")
def rung(spark, sf_dir):
    s = _status(spark, sf_dir).withColumns({
        "satellite_age_min": F.col("age"), "radar_age_min": F.col("age"), "lightning_age_min": F.col("age"), "radar_coverage": F.col("cover"),
        "lightning_health": F.lit(1.0), "ood": F.col("n") > 6, "contract_ok": F.col("top") < 99,
    })
    return C.rounded(decide.choose_rung(s).select("user_id", "day", "rung", F.array_join("abstentions.reason", ",").alias("reasons")))


@query(f"""WITH {_STATUS}, t AS (SELECT *, sat AND age <= 45 AND cover >= 0.7 AS s1, radar AND age <= 20 AND cover >= 0.3 AS r1, ltg AND age <= 10 AND cover >= 0.01 AS l1, nwp AND cover >= 0.01 AS n1 FROM s)
SELECT user_id, day, CASE WHEN r1 AND s1 AND l1 AND n1 THEN 'R0' WHEN s1 AND l1 AND n1 THEN 'R1' WHEN s1 AND n1 THEN 'R2' WHEN n1 THEN 'R3' ELSE 'R4' END AS rung FROM t""")
def input_ladder(spark, sf_dir):
    groups = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), (~F.col(c)).alias("missing")) for g, c in (("sat", "satellite_valid"), ("radar", "radar_valid"), ("ltg", "lightning_valid"), ("nwp", "nwp_valid"))]))
    rows = _status(spark, sf_dir).select("user_id", "day", F.col("age").cast("double").alias("age_min"), F.col("cover").alias("coverage"), groups.alias("g")).select("*", "g.*")
    return C.rounded(features.input_ladder(rows, ["user_id", "day"]))


@query(f"""WITH {C.EVENTS}, h AS (SELECT event_id, event_type <> 'error' AS seen, value / 10 AS mesh, k AS z, CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN 4000 END AS frz, CASE WHEN user_id % 2 = 0 THEN k / 5.0 END AS shear, value / 8 AS tti FROM ev)
SELECT event_id, CASE WHEN seen THEN (mesh >= 20 OR (z >= 55 AND coalesce(nullif(frz, 0) <= 4500, false))) AND (coalesce(shear, 0) >= 10 OR tti >= 46) END AS signature, CASE WHEN NOT seen THEN 'no_radar' END AS abstained FROM h""")
def hail(spark, sf_dir):
    rows = C.events(spark, sf_dir).select(
        "event_id", (F.col("event_type") != "error").alias("radar_valid"), (F.col("value") / 10).alias("mesh_mm"), F.col("k").alias("z_m20c_dbz"),
        F.when(F.col("user_id") % 3 == 0, 0).when(F.col("user_id") % 3 == 1, 4000).alias("freezing_level_m"), F.when(F.col("user_id") % 2 == 0, F.col("k") / 5.0).alias("shear06_ms"), (F.col("value") / 8).alias("tti"),
    )
    return decide.hail_signature(rows).select("event_id", "signature", "abstained")


@query(f"""WITH {C.EVENTS}, d AS (SELECT event_id, event_type <> 'error' AS seen, least(1.0, 0.35 * value / 500 + 0.25 * k / 100 + 0.15 * 0.5 + 0.15 * (user_id % 10) / 10 + 0.10 * 0.2) AS s FROM ev)
SELECT event_id, CASE WHEN seen THEN round(s, 6) END::DOUBLE AS score, CASE WHEN NOT seen THEN NULL WHEN s >= 0.66 THEN 'High' WHEN s >= 0.33 THEN 'Moderate' ELSE 'Low' END AS risk_class, CASE WHEN NOT seen THEN 'no_velocity' END AS abstained FROM d""")
def downburst(spark, sf_dir):
    rows = C.events(spark, sf_dir).select(
        "event_id", (F.col("event_type") != "error").alias("has_velocity"), F.col("value").alias("divergence_norm"), F.col("k").alias("descending_core"), F.lit(Decimal("0.5")).alias("marc_norm"),
        (F.col("user_id") % 10).alias("dcape_norm"), F.lit(Decimal("0.2")).alias("dry_midlevel"),
    )
    return C.rounded(decide.downburst_score(rows, {"divergence_norm": 500, "descending_core": 100, "dcape_norm": 10}).select("event_id", "score", "risk_class", "abstained"))


@query("SELECT event_id, round(least(greatest(value / 250 - 0.2, 0.0), 1.0), 6) AS cloudburst_prior, NULL::DOUBLE AS probability, true AS prior_only FROM events")
def cloudburst(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 250 - 0.2).alias("prior"))
    return C.rounded(decide.cloudburst_prior(rows).select("event_id", "cloudburst_prior", "probability", "prior_only"))


@query(f"""WITH {C.EVENTS} SELECT event_id, concat_ws(',', CASE WHEN k < 10 THEN 'no_data_hash' END, CASE WHEN event_type = 'error' THEN 'synthetic_data' END, CASE WHEN user_id % 2 = 0 THEN 'missing_channels' END,
CASE WHEN value < 100 THEN 'no_eligible_label' END) AS reasons FROM ev""")
def training_gate(spark, sf_dir):
    rows = C.events(spark, sf_dir).select(
        "event_id", F.when(F.col("k") >= 10, "abc").alias("data_hash"), (F.col("event_type") == "error").alias("synthetic"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit("ir1"))).otherwise(F.array(F.lit("ir1"), F.lit("wv"))).alias("channels"), F.array(F.lit("wv")).alias("required"), F.array(F.col("value") < 100).alias("labels"),
    )
    return decide.training_gate(rows).select("event_id", F.array_join("reasons", ",").alias("reasons"))


_DRAW = "('0x' || substr(md5('7|{g}|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""WITH {C.EVENTS}, d AS (SELECT event_id, value, k, {_DRAW.format(g="a")} AS a, {_DRAW.format(g="b")} AS b FROM ev),
s AS (SELECT *, a < 0.3 AND (b >= 0.3 OR a < b) AS ga, b < 0.3 AND (a >= 0.3 OR b < a) AS gb FROM d)
SELECT event_id, concat_ws(',', CASE WHEN ga THEN 'a' END, CASE WHEN gb THEN 'b' END) AS dropped, CASE WHEN ga THEN 0.0 ELSE value END::DOUBLE AS value, CASE WHEN gb THEN 0.0 ELSE k END::DOUBLE AS k FROM s""")
def modality_dropout(spark, sf_dir):
    """How often each group of inputs was dropped; never all of them."""
    rows = C.events(spark, sf_dir).select("event_id", "value", F.col("k").cast("double").alias("k"))
    return decide.modality_dropout(rows, {"a": ["value"], "b": ["k"]}, 0.3, 7, "event_id").select("event_id", F.array_join("dropped", ",").alias("dropped"), "value", "k")


@query(f"""WITH {C.EVENTS}, g AS (SELECT event_type AS channel, user_id, avg(k) AS age, list_sort(list(DISTINCT event_type || k)) AS ids FROM ev GROUP BY ALL)
SELECT user_id, channel, round(CASE WHEN age > 60 THEN 120.0 ELSE greatest(age - 10, 0.0) END, 6)::DOUBLE AS age_min, array_to_string(ids, ',') AS manifest_ids FROM g""")
def mask_bundle(spark, sf_dir):
    rows = C.events(spark, sf_dir)
    per = rows.groupBy("user_id", F.col("event_type").alias("channel")).agg(F.avg("k").alias("age"), F.array_sort(F.collect_set(F.concat("event_type", "k"))).alias("manifest_ids"))
    per = per.select("user_id", "channel", F.when(F.col("age") <= 60, F.col("age") - 10).alias("age_min"), F.lit(False).alias("missing"), F.lit(None).cast("string").alias("missing_reason"), "manifest_ids")
    return C.rounded(qc.mask_bundle(per, ["user_id"]).select("user_id", "channel", "age_min", F.array_join("manifest_ids", ",").alias("manifest_ids")))


@query(f"""WITH {C.EVENTS} SELECT event_id, CASE WHEN k < 5 THEN 'empty_payload' WHEN k % 7 = 0 THEN 'issue_after_valid' WHEN event_type <> 'view' AND k % 5 = 0 THEN 'arrival_before_issue' END AS problem FROM ev""")
def observation_rules(spark, sf_dir):
    k, ts = F.col("k"), F.col("ts").cast("timestamp")
    shifted = lambda minutes: F.timestamp_micros(F.unix_micros(ts) + minutes * 60_000_000)
    problem = qc.observation_problem(F.when(k >= 5, k), ts, shifted(F.when(k % 7 == 0, -1).otherwise(1)), shifted(F.when(k % 5 == 0, -1).otherwise(1)), F.col("event_type") == "view")
    return C.events(spark, sf_dir).select("event_id", problem.alias("problem"))


@query(f"""WITH {C.EVENTS} SELECT event_id, CASE WHEN k % 11 = 0 THEN 'missing_field' WHEN k - 5 > 90 OR value > 180 THEN 'outside_wgs84' WHEN event_type = 'error' THEN 'unknown_type' END AS problem FROM ev""")
def flash_rules(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "XX").when(F.col("event_type") == "view", "CG").otherwise("IC")
    lat = F.when(F.col("k") % 11 != 0, F.col("k") - 5.0)
    return C.events(spark, sf_dir).select("event_id", qc.lightning_row_problem(lat, F.col("value"), kind, F.col("ts")).alias("problem"))


@query("""WITH d AS (SELECT user_id, day(ts) AS day FROM events), m AS (SELECT user_id, day FROM (SELECT DISTINCT user_id FROM d) a, (SELECT DISTINCT day FROM d) b WHERE (user_id, day) NOT IN (SELECT user_id, day FROM d))
SELECT user_id, day, (i // 3)::BIGINT AS row, (i % 3)::BIGINT AS col, 0.0::DOUBLE AS value_qc, false AS valid, NULL::DOUBLE AS age_min, 'sat_missing' AS flags FROM m, (SELECT unnest(range(6)) AS i)""")
def missing_frame(spark, sf_dir):
    """Frames that never came, of every user and day without an event: every cell filled and invalid."""
    rows = C.table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day")).distinct()
    absent = rows.select("user_id").distinct().crossJoin(F.broadcast(rows.select("day").distinct())).join(rows, ["user_id", "day"], "left_anti")  # users x days
    cells = qc.missing_frame(spark, 2, 3, "sat_missing").withColumn("flags", F.array_join("flags", ","))
    return C.rounded(absent.crossJoin(F.broadcast(cells)).select("user_id", "day", "row", "col", "value_qc", "valid", "age_min", "flags"))
