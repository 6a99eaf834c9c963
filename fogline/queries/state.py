"""Catalogues and tables that keep state: label files, manifests, assignments, approvals, registered products."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fogline.functions.tables import shared_dir
from fogline.operators import features, objects, products, splits
from fogline.queries import _carriers as C
from fogline.queries._registry import query
from fogline.queries.ingest import _labels
from fogline.queries.products import _products
from fogline.sources import labels, manifests


@query(f"WITH {C.FRAMES} SELECT frame_id, CASE WHEN event_id::BIGINT % 10 < 7 THEN 'train' WHEN event_id::BIGINT % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM fr")
def split_assigned(spark, sf_dir):
    """Frames by a table that assigns their events."""
    frames = C.frames(spark, sf_dir)
    nth = F.col("c_custkey") % 10
    assignment = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("group"), F.when(nth < 7, "train").when(nth < 9, "validation").otherwise("test").alias("split"))
    return splits.split(frames, "event_grouped", assignment=assignment)


@query("""WITH c AS (SELECT DISTINCT event_type, user_id, day(ts) * 24 + hour(ts) AS cell FROM events)
SELECT DISTINCT a.user_id AS a_id, b.user_id AS b_id FROM c a JOIN c b ON a.event_type = 'click' AND b.event_type = 'purchase' AND a.cell = b.cell""")
def footprint_overlap(spark, sf_dir):
    """Users whose clicks and purchases share an hour, as objects that share a cell."""
    rows = C.table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("id"), (F.dayofmonth("ts") * 24 + F.hour("ts")).alias("cell"))
    of = lambda kind: rows.where(F.col("event_type") == kind).groupBy("id").agg(F.collect_set("cell").alias("cells"))
    return objects.overlapping(of("click"), of("purchase"))


@query("SELECT user_id % 5 AS frame, event_type AS channel, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def channel_means(spark, sf_dir):
    cells = C.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("frame"), F.col("event_type").alias("channel"), "value")
    return C.rounded(features.channel_means(cells, ["frame"]))


@query(f"""WITH {C.EVENTS} SELECT event_id::VARCHAR AS event_id, CASE WHEN k < 90 THEN 'hail' WHEN k < 95 THEN 'cloudburst_area_proxy' ELSE 'snow' END AS hazard, ['A', 'B', 'C', 'D'][user_id % 4 + 1] AS grade,
epoch_us(ts) // 1000000 AS obs_s, round(value / 4, 6) AS latitude, event_type = 'error' AS synthetic, k % 2 = 0 AS instrument, 1.0::DOUBLE AS mm FROM ev""")
def label_file(spark, sf_dir):
    """Labels after a round trip through JSON lines."""
    path = f"{shared_dir(spark)}/labels-{uuid.uuid4().hex[:12]}"
    labels.write_labels(_labels(spark, sf_dir), path)
    proof = F.col("evidence")[0]
    found = labels.read_labels(spark, path)
    return C.rounded(found.select("event_id", "hazard", "grade", F.unix_seconds("obs_time").alias("obs_s"), "latitude", "synthetic", proof["instrument_confirmed"].alias("instrument"), proof["observed_values"]["mm"].alias("mm")))


def _manifest(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").cast("string").alias("observation_id"), F.col("event_type").alias("source"), (F.col("user_id") % 7).cast("string").alias("station"), F.col("ts").cast("timestamp").alias("obs_time"))


@query("""WITH m AS (SELECT event_id, event_type, user_id % 7 AS station, ts FROM events WHERE event_type = 'click'), t AS (SELECT *, row_number() OVER (ORDER BY ts, event_type, station, event_id) AS nth FROM m)
SELECT event_id::VARCHAR AS observation_id, station::VARCHAR AS station FROM t WHERE nth <= 40""")
def manifest_list(spark, sf_dir):
    """The first rows of a source by time of observation; the limit is the query's own."""
    return manifests.list_manifest(_manifest(spark, sf_dir), source="click", limit=40).select("observation_id", "station")


@query(f"""WITH {C.EVENTS}, p AS (SELECT event_id, k, CASE k % 4 WHEN 0 THEN 'GIF89a' WHEN 1 THEN 'GRIB' WHEN 2 THEN '' ELSE 'plain' END || CASE WHEN k % 4 = 2 THEN '' ELSE event_id::VARCHAR END AS body,
CASE WHEN k % 5 = 0 THEN 500 ELSE 200 END AS status, ts, 'st ' || event_type AS station FROM ev)
SELECT event_id, CASE WHEN k % 5 = 0 THEN 'http_status' WHEN body = '' THEN 'empty_payload' WHEN k % 4 <> 0 THEN 'not_image' END AS reason, k % 4 = 1 AS grib,
CASE WHEN k % 5 <> 0 AND k % 4 = 0 THEN 'net/' || replace(station, ' ', '_') || '/' || strftime(ts, '%Y/%m/%d') || '/' || sha256(body) || '.gif' END AS path FROM p""")
def payload_archive(spark, sf_dir):
    """Landed payloads: why they are refused, and the place of those that are kept."""
    k = F.col("k")
    body = F.concat(F.when(k % 4 == 0, "GIF89a").when(k % 4 == 1, "GRIB").when(k % 4 == 2, "").otherwise("plain"), F.when(k % 4 == 2, "").otherwise(F.col("event_id").cast("string")))
    ts = F.col("ts").cast("timestamp")
    landed = C.events(spark, sf_dir).select(
        "event_id", F.lit("net").alias("source"), F.concat(F.lit("st "), "event_type").alias("station"), F.concat(F.lit("http://x/a_"), F.date_format(ts, "yyyyMMddHHmm"), F.lit(".gif")).alias("url"), body.cast("binary").alias("payload"),
        F.lit(None).cast("string").alias("content_type"), F.when(k % 5 == 0, 500).otherwise(200).alias("status"), ts.alias("arrival_time"),
    )
    checked = manifests.check_payloads(landed)
    place = manifests.archive_path(F.col("source"), F.col("station"), F.col("obs_time"), F.col("payload_sha256"), F.lit(".gif"))
    return checked.select("event_id", "reason", manifests.grib_payload(F.col("payload")).alias("grib"), F.when(F.col("reason").isNull(), place).alias("path"))


@query(f"""WITH {C.EVENTS}, d AS (SELECT DISTINCT user_id FROM ev), a AS (SELECT user_id, ts, event_id::VARCHAR AS actor, CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'approve' END AS action FROM ev WHERE event_type IN ('click', 'error')),
f AS (SELECT user_id, arg_min(struct_pack(action, actor, ts), struct_pack(ts, actor)) AS x, count(*) AS n FROM a GROUP BY user_id)
SELECT d.user_id::VARCHAR AS alert_id, CASE x.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'draft' END AS state, x.actor AS decided_by, coalesce(n, 0)::BIGINT AS actions FROM d LEFT JOIN f USING (user_id)""")
def alert_approvals(spark, sf_dir):
    """State of alerts after their actions: the first decides, later ones are only counted."""
    rows = C.events(spark, sf_dir).withColumn("alert_id", F.col("user_id").cast("string"))
    actions = rows.where("event_type in ('click', 'error')").select("alert_id", F.col("ts").alias("at"), F.col("event_id").cast("string").alias("actor"), F.when(F.col("k") % 3 == 0, "reject").otherwise("approve").alias("action"))
    return C.rounded(products.approvals(rows.select("alert_id").distinct(), actions).select("alert_id", "state", "decided_by", "actions"))


@query(f"""WITH {C.EVENTS}, r AS (SELECT event_id, event_type AS domain, ts::DATE AS issue, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] ELSE ['o' || k, 'p' || user_id] END AS objs FROM ev),
l AS (SELECT domain, issue, arg_max(objs, event_id) AS objs FROM r WHERE objs IS NOT NULL GROUP BY ALL)
SELECT domain, strftime(issue, '%Y-%m-%d') AS issue, unnest(objs) AS object FROM l""")
def registered_objects(spark, sf_dir):
    """Objects of every domain and issue after products were registered: the last that brought any replace those before."""
    k = F.col("k")
    brought = F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array(F.concat(F.lit("o"), k), F.concat(F.lit("p"), F.col("user_id"))))
    rows = C.events(spark, sf_dir).select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("domain"), F.to_date("ts").alias("issue_time"), brought.alias("object"))
    return products.latest_entries(rows, "object").select("domain", F.date_format("issue_time", "yyyy-MM-dd").alias("issue"), "object")


@query(f"""WITH {C.EVENTS} SELECT event_id AS ordinal, '{{"type":"products.issued","domain":"' || event_type || '","issue_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","product":"rain","lead_min":' || (30 * (1 + event_id % 8)) || ',"rung":"R' || (k % 6) || '","abstentions":['
|| CASE k % 10 WHEN 0 THEN '{{"module":"M4","reason":"no_radar","detail":"why"}}' WHEN 1 THEN '{{"module":"M4","reason":"made_up","detail":"why"}}' ELSE '' END || ']}}' AS event FROM ev""")
def issued_events(spark, sf_dir):
    """The event that each registered product gives out."""
    return products.issued_events(_products(spark, sf_dir))
