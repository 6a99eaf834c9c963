"""Labels from observations, areas by tile, and derived channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.operators import bundle, derived, features, labelling, tiles
from fogline.queries import _carriers as C
from fogline.queries._registry import query

#: Centres around which events are placed: equator at the date line, high latitudes, next to both poles.
_CENTRES = [(0.0, 179.98), (60.0, -179.99), (-89.95, 10.0), (89.98, 90.0), (22.5, 88.3)]


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the globe, some kilometres around a few centres, some across the date line or around a pole."""
    rows = C.events(spark, sf_dir)
    at = F.element_at(F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in _CENTRES]), (F.col("user_id") % 5 + 1).cast("int"))
    lat = F.least(F.greatest(at["lat"] + (F.col("k") % 13 - 6) * 0.02, F.lit(-90.0)), F.lit(90.0))
    lon = at["lon"] + (F.col("event_id") % 11 - 5) * 0.03 * F.when(F.abs(at["lat"]) > 80, 40).otherwise(1)
    wrapped = F.when(lon >= 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
    return rows.select("event_id", "event_type", "k", "value", "ts", lat.alias("lat"), wrapped.alias("lon"), F.col("ts").alias("at"))


_PLACED = f"""{C.EVENTS}, ctr AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(_CENTRES))}) x(c, clat, clon)),
pl0 AS (SELECT event_id, event_type, k, value, ts, least(greatest(clat + (k % 13 - 6) * 0.02::DOUBLE, -90.0), 90.0) AS lat, clon + (event_id % 11 - 5) * 0.03::DOUBLE * CASE WHEN abs(clat) > 80 THEN 40 ELSE 1 END AS l0 FROM ev JOIN ctr ON c = user_id % 5),
pl AS (SELECT * EXCLUDE (l0), CASE WHEN l0 >= 180 THEN l0 - 360 WHEN l0 < -180 THEN l0 + 360 ELSE l0 END AS lon FROM pl0)"""
_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, sin(radians(e.lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(e.lat)) * sin(radians(e.lon - p.lon) / 2) ** 2)))"


def _exists(events: str, km: float, after: int, before: int = 0) -> str:
    return f"EXISTS (SELECT 1 FROM pl e WHERE {events} AND e.ts BETWEEN p.ts - INTERVAL {before} MINUTE AND p.ts + INTERVAL {after} MINUTE AND {_KM} <= {km})"


@query(f"""WITH {_PLACED} SELECT p.event_id AS point_id, {_exists("e.event_type = 'view'", 8.0, 30)} AS lightning_30, {_exists("e.event_type = 'view'", 8.0, 60)} AS lightning_60,
{_exists("e.event_type = 'purchase' AND e.k % 3 < 2", 25.0, 45, 45)} AS hail, {_exists("e.event_type = 'signup' AND (e.value / 5 >= 17 OR e.k % 10 = 0)", 25.0, 30, 30)} AS gust
FROM pl p WHERE p.event_type IN ('click', 'error')""")
def hazard_labels(spark, sf_dir):
    """Lightning, hail and gust labels of points, all over the globe."""
    rows = _placed(spark, sf_dir)
    points = rows.where("event_type in ('click', 'error')").select(F.col("event_id").alias("point_id"), "lat", "lon", "at")
    flashes = rows.where("event_type = 'view'")
    reports = rows.where("event_type = 'purchase'").withColumn("grade", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("k") % 3 + 1).cast("int")))
    gusts = rows.where("event_type = 'signup'").select("lat", "lon", "at", (F.col("value") / 5).alias("gust"), (F.col("k") % 10 == 0).alias("squall"))
    out = labelling.lightning_labels(points, flashes, 30).withColumnRenamed("positive", "lightning_30")
    out = labelling.lightning_labels(out, flashes, 60).withColumnRenamed("positive", "lightning_60")
    out = labelling.hail_labels(out, reports).withColumnRenamed("positive", "hail")
    return labelling.gust_labels(out, gusts).withColumnRenamed("positive", "gust").drop("lat", "lon", "at")


@query(f"""WITH RECURSIVE {C.EVENTS}, t AS (SELECT user_id AS track, min(ts) AS started, min(ts) FILTER (WHERE value / 4 >= 35 OR event_type = 'purchase') AS own FROM ev GROUP BY user_id),
up AS (SELECT track, track AS node, NULL::TIMESTAMP AS bound FROM t
  UNION ALL SELECT up.track, up.node // 2, least(up.bound, t.started) FROM up JOIN t ON t.track = up.node WHERE up.node > 0 AND up.node // 2 IN (SELECT track FROM t)),
i AS (SELECT up.track, min(t.own) AS initiated FROM up JOIN t ON t.track = up.node WHERE up.bound IS NULL OR t.own <= up.bound GROUP BY up.track),
s AS (SELECT e.event_id, e.user_id AS track_id, (epoch_us(i.initiated) - epoch_us(e.ts)) / 60e6 AS gap, i.initiated IS DISTINCT FROM t.own AS inherited FROM ev e JOIN i ON i.track = e.user_id JOIN t ON t.track = e.user_id)
SELECT event_id, track_id, inherited, coalesce(gap > 0 AND gap <= 720, false) AS positive, coalesce(gap <= 0, false) AS already, round(CASE WHEN gap > 0 AND gap <= 720 THEN gap END, 6) AS lead_min FROM s""")
def initiation_labels(spark, sf_dir):
    """Convective initiation of tracks, with what they inherit from the tracks that they came from."""
    rows = C.events(spark, sf_dir).select("event_id", F.col("user_id").alias("track_id"), F.col("ts").alias("at"), (F.col("value") / 4).alias("peak"), "event_type")
    edges = rows.select(F.floor(F.col("track_id") / 2).alias("parent"), F.col("track_id").alias("child")).distinct()
    found = labelling.initiations(rows, edges, rows.where("event_type = 'purchase'"))
    labels = labelling.initiation_labels(rows.select("event_id", "track_id", "at"), found, 720)
    joined = labels.join(found.select("track_id", "inherited"), "track_id")
    return C.rounded(joined.select("event_id", "track_id", "inherited", "positive", "already", "lead_min"))


@query("""WITH s AS (SELECT event_id, user_id % 5 AS station, ts, sum(value / 4) OVER (PARTITION BY user_id % 5 ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS mm FROM events)
SELECT event_id, station, round(mm, 6) AS hour_mm FROM s WHERE mm >= 100""")
def cloudburst_points(spark, sf_dir):
    """Gauge rows whose last hour reaches 100 mm."""
    gauges = C.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("station"), F.col("ts").alias("at"), (F.col("value") / 4).alias("mm"))
    return C.rounded(labelling.cloudburst_points(gauges).select("event_id", "station", "hour_mm"))


@query(f"""WITH RECURSIVE cells AS (SELECT event_type AS domain, (day(ts) - 1) * {C.NX} + hour(ts) AS cell, sum(value) AS v FROM events GROUP BY ALL),
a AS (SELECT domain, cell, cell // {C.NX} AS r, cell % {C.NX} AS c FROM cells WHERE v >= 100),
reach AS (SELECT domain, cell AS start, cell, r, c FROM a
  UNION SELECT reach.domain, least(reach.start, a.cell), a.cell, a.r, a.c FROM reach JOIN a ON a.domain = reach.domain AND abs(a.r - reach.r) <= 1 AND abs(a.c - reach.c) <= 1),
l AS (SELECT domain, cell, min(start) AS label FROM reach GROUP BY ALL)
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY label) - 1 AS object, count(*) AS area_cells, round(avg(cell % {C.NX}), 6) AS centroid_x, array_to_string(list(cell ORDER BY cell), ',') AS cells FROM l GROUP BY domain, label HAVING count(*) >= 5""")
def cloudburst_areas(spark, sf_dir):
    """Areas of five or more hours and days that touch, found in tiles of seven cells."""
    rows = C.table(spark, sf_dir, "events")
    rates = rows.groupBy(F.col("event_type").alias("domain"), (F.dayofmonth("ts") - 1).alias("row"), F.hour("ts").alias("col")).agg(F.sum("value").alias("value"))
    found = tiles.cloudburst_areas(rates, C.NX, ["domain"], tile=7)
    return C.rounded(found.select("domain", "object", "area_cells", "centroid_x", F.array_join("cells", ",").alias("cells")))


#: A rate over about two hours, a difference of two channels and a shear of two vectors.
DERIVED = {"d_click_dt": derived.Rate("click", 120.0, 60.0, 60.0), "click_minus_view": derived.Difference("click", "view"), "shear": derived.Shear(("purchase", "signup"), ("view", "error"))}
CONTRACT = features.FeatureContract(("click", "d_click_dt", "click_minus_view", "shear"), (200.0, 0.0, 0.0, 100.0), (80.0, 50.0, 100.0, 50.0), (0.0, -200.0, -400.0, 0.0), (450.0, 200.0, 400.0, 600.0))


@query("""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT event_type AS channel, user_id % 2 AS r, date_trunc('hour', ts) AS t, max(value) AS v, max(k) >= 30 AS ok FROM e GROUP BY ALL),
p AS (SELECT a.r, a.t, a.v, a.ok, arg_min(struct_pack(v := b.v, gap := date_diff('minute', b.t, a.t)), abs(date_diff('minute', b.t, a.t) - 120) * 1000 - date_diff('minute', b.t, a.t)) AS then_
  FROM c a LEFT JOIN c b ON b.channel = 'click' AND b.r = a.r AND b.ok AND date_diff('minute', b.t, a.t) BETWEEN 60 AND 180 WHERE a.channel = 'click' GROUP BY ALL),
w AS (SELECT r, t, max(v) FILTER (WHERE channel = 'click' AND ok) AS a, max(v) FILTER (WHERE channel = 'view' AND ok) AS b, max(v) FILTER (WHERE channel = 'purchase' AND ok) AS pu, max(v) FILTER (WHERE channel = 'signup' AND ok) AS si,
  max(v) FILTER (WHERE channel = 'error' AND ok) AS er, count(*) FILTER (WHERE channel IN ('click', 'view')) AS n2 FROM c GROUP BY r, t),
d AS (SELECT 'click' AS channel, r, t, v, ok FROM c WHERE channel = 'click' UNION ALL SELECT 'd_click_dt', r, t, CASE WHEN ok THEN (v - then_.v) / then_.gap * 60 END, ok AND then_ IS NOT NULL FROM p
  UNION ALL SELECT 'click_minus_view', r, t, a - b, a - b IS NOT NULL FROM w UNION ALL SELECT 'shear', r, t, sqrt((pu - b) ** 2 + (si - er) ** 2), pu - b + si - er IS NOT NULL FROM w),
s AS (SELECT * FROM (VALUES ('click', 200.0, 80.0, 0.0, 450.0), ('d_click_dt', 0.0, 50.0, -200.0, 200.0), ('click_minus_view', 0.0, 100.0, -400.0, 400.0), ('shear', 100.0, 50.0, 0.0, 600.0)) x(channel, mean, std, low, high))
SELECT d.channel, r AS row, epoch_us(t) // 1000000 AS at_s, coalesce(ok AND v BETWEEN low AND high, false) AS valid, round(CASE WHEN ok AND v BETWEEN low AND high THEN (v - mean::DOUBLE) / std::DOUBLE ELSE 0.0 END, 6)::DOUBLE AS normal FROM d JOIN s USING (channel)""")
def derived_channels(spark, sf_dir):
    """A rate, a difference and a shear beside the channel they come from, through normalisation."""
    rows = C.events(spark, sf_dir)
    cells = rows.groupBy(F.col("event_type").alias("channel"), (F.col("user_id") % 2).alias("row"), F.lit(0).alias("col"), F.date_trunc("hour", "ts").alias("at")).agg(F.max("value").alias("value"), (F.max("k") >= 30).alias("mask"))
    found = features.normalize(derived.with_derived(cells, DERIVED), CONTRACT)
    return C.rounded(found.select("channel", "row", F.unix_seconds(F.col("at").cast("timestamp")).alias("at_s"), "valid", "normal"))


_CHANNELS = {"click": "sat/ir1", "view": "radar/zmax", "purchase": "ltg/density", "signup": "nwp/cape", "error": "nwp/pwat"}
BUNDLE = features.FeatureContract(("sat/ir1", "radar/zmax", "nwp/cape", "ltg/density", "nwp/pwat", "nwp/never"), (200.0,) * 6, (80.0,) * 6, (0.0,) * 6, (450.0,) * 6)


@query(f"""WITH {C.EVENTS}, m AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{c}')" for t, c in _CHANNELS.items())}) x(event_type, channel)),
c AS (SELECT day(ts) AS day, channel, user_id % 3 AS r, k % 4 AS c, max(value) AS v, max(k) >= 20 AS ok, min(k) AS age FROM ev JOIN m USING (event_type) GROUP BY ALL),
f AS (SELECT day, channel, count(*) FILTER (WHERE ok) = 0 OR bool_or(day % 7 = 3 AND channel = 'sat/ir1') AS gone, min(age)::DOUBLE AS age, count(*) FILTER (WHERE ok) / 12.0::DOUBLE AS cover FROM c GROUP BY ALL),
n AS (SELECT unnest({list(BUNDLE.names)}) AS channel, unnest(range(6)) AS pos), d AS (SELECT DISTINCT day FROM f),
z AS (SELECT d.day, n.channel, n.pos, coalesce(f.gone, true) AS gone, CASE WHEN coalesce(f.gone, true) OR f.age IS NULL THEN 120.0 ELSE least(greatest(f.age, 0.0), 120.0) END AS age FROM d CROSS JOIN n LEFT JOIN f ON f.day = d.day AND f.channel = n.channel),
x AS (SELECT z.*, CASE WHEN NOT z.gone AND c.ok AND c.v BETWEEN 0 AND 450 THEN (c.v - 200) / 80 ELSE 0.0 END AS normal, NOT z.gone AND coalesce(c.ok AND c.v BETWEEN 0 AND 450, false) AS valid
  FROM z CROSS JOIN (SELECT unnest(range(3)) AS r) a CROSS JOIN (SELECT unnest(range(4)) AS c) b LEFT JOIN c ON c.day = z.day AND c.channel = z.channel AND c.r = a.r AND c.c = b.c),
p AS (SELECT day, channel, avg(normal) AS m FROM x GROUP BY ALL), o AS (SELECT day, sqrt(sum((m - 0.1) ** 2)) AS score FROM p GROUP BY day),
g AS (SELECT day, bool_or(channel LIKE 'sat/%' AND NOT gone AND age <= 45 AND cover >= 0.7) AS sat, bool_or(channel LIKE 'radar/%' AND NOT gone AND age <= 20 AND cover >= 0.3) AS radar,
  bool_or(channel LIKE 'ltg/%' AND NOT gone AND age <= 10 AND cover >= 0.01) AS ltg, bool_or(channel LIKE 'nwp/%' AND NOT gone AND cover >= 0.01) AS nwp FROM f GROUP BY day),
t AS (SELECT day, count(*) FILTER (WHERE valid) AS valid_cells, round(sum(normal), 6) AS normal, round(sum(age / 60), 6) AS age_h FROM x GROUP BY day)
SELECT t.day::BIGINT AS day, CASE WHEN radar AND sat AND ltg AND nwp THEN 'R0' WHEN sat AND ltg AND nwp THEN 'R1' WHEN sat AND nwp THEN 'R2' WHEN nwp THEN 'R3' ELSE 'R4' END AS rung,
(SELECT string_agg(channel, ',' ORDER BY pos) FROM z WHERE z.day = t.day AND gone) AS missing, round(score, 6) AS score, score > 1.0 AS ood, valid_cells, normal, age_h FROM t JOIN o USING (day) JOIN g USING (day)""")
def feature_bundle(spark, sf_dir):
    """Bundles of all days in one call: rung, missing channels and support from the header, sums of the tensor's three parts."""
    rows = C.events(spark, sf_dir)
    channel = F.create_map(*[F.lit(x) for kv in _CHANNELS.items() for x in kv])[F.col("event_type")]
    cells = rows.groupBy(F.dayofmonth("ts").alias("day"), channel.alias("channel"), (F.col("user_id") % 3).alias("row"), (F.col("k") % 4).alias("col")).agg(F.max("value").alias("value"), (F.max("k") >= 20).alias("mask"), F.min("k").alias("age"))
    ok = F.count_if("mask")
    frames = cells.groupBy("day", "channel").agg(((ok == 0) | ((F.col("day") % 7 == 3) & (F.col("channel") == "sat/ir1"))).alias("missing"), F.min("age").alias("age_min"), (ok / 12.0).alias("coverage"), F.array(F.lit("m")).alias("manifest_ids"))
    made = bundle.feature_bundle(cells.drop("age"), frames, BUNDLE, ["day"], (3, 4), mean=[0.1] * 6, threshold=1.0)
    part = lambda n: F.floor(F.col("plane") / len(BUNDLE.names)) == n
    sums = made.tensor().groupBy("day").agg(F.sum(F.when(part(1), F.col("value"))).cast("long").alias("valid_cells"), F.sum(F.when(part(0), F.col("value"))).alias("normal"), F.sum(F.when(part(2), F.col("value"))).alias("age_h"))
    header = made.header.select("day", "rung", F.array_join("missing", ",").alias("missing"), "score", "ood")
    return C.rounded(header.join(sums, "day"))
