"""Catalogue, addresses, targets, records and point reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fogline.operators import serving
from fogline.queries import _carriers as C
from fogline.queries._registry import query
from fogline.sources import adapters, catalogue
from fogline.streaming import replay

#: Each event type as a channel with a policy of its own.
_POLICIES = {"view": "nearest-min", "click": "max", "purchase": "area-mean", "error": "sum", "signup": "signed-max-abs"}
_CATALOGUE = {"channel_version": 1, "channels": {"ev": {n: {"dtype": "float", "scale": 1, "source": n, "resampling": p, "fill_value": 0} for n, p in _POLICIES.items()}}}
_REDUCED = {"view": "min(v)", "click": "max(v)", "purchase": "avg(v)", "error": "sum(v)", "signup": "arg_max(v, struct_pack(a := abs(v), p := -(r * 24 + c)))"}
_REGRID = ", ".join(C.field_sql(f"f_{n}", n) for n in _POLICIES)


@query(f"WITH {_REGRID} " + " UNION ALL ".join(f"SELECT 'ev/{n}' AS channel, r // 3 AS row, c // 3 AS col, round({x}, 6) AS value FROM f_{n} GROUP BY r // 3, c // 3" for n, x in _REDUCED.items()))
def channel_regrid(spark, sf_dir):
    """Fields of all event types on a coarser grid, each by the policy that the catalogue names."""
    fields = [C.field(spark, sf_dir, n).withColumn("channel", F.lit(f"ev/{n}")) for n in _POLICIES]
    found = catalogue.regrid_channels(reduce(lambda a, b: a.unionByName(b), fields), (C.NY, C.NX), (C.NY // 3, C.NX // 3), catalogue.channels_of(_CATALOGUE))
    return C.rounded(found)


@query("""WITH u AS (SELECT event_id, 'https://x/' || CASE event_id % 4 WHEN 0 THEN '3Rimg' WHEN 1 THEN '3SIMG' WHEN 2 THEN '3dimg' ELSE 'other' END AS head, event_type FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'INSAT-3DR' WHEN 1 THEN 'INSAT-3DS' WHEN 2 THEN 'INSAT-3D' ELSE 'INSAT-UNKNOWN' END AS satellite,
CASE WHEN event_id % 4 = 3 THEN 'UNKNOWN' ELSE upper(event_type) END AS product FROM u""")
def satellite_addresses(spark, sf_dir):
    head = F.get(F.array(*[F.lit(x) for x in ("3Rimg", "3SIMG", "3dimg", "other")]), (F.col("event_id") % 4).cast("int"))
    url = F.concat(F.lit("https://x/"), head, F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.col("event_type"), F.lit(".jpg"))
    return C.table(spark, sf_dir, "events").select("event_id", adapters.satellite_of(url).alias("satellite"), adapters.product_of(url).alias("product"))


@query("""SELECT n_name AS station, product, 'https://r/' || n_name || '?p=' || product AS url, channel, product = 'ppv' AS has_velocity FROM nation,
(VALUES ('caz', 'zmax'), ('ppz', 'z_cappi1_proxy'), ('ppv', 'vr_lowest'), ('sri', 'sri'), ('pac', 'pac'), ('vp2', 'vp2')) p(product, channel)""")
def radar_requests(spark, sf_dir):
    return adapters.radar_requests(C.table(spark, sf_dir, "nation").select(F.col("n_name").alias("station")), "https://r/{station}?p={product}")


@query("""SELECT event_id, 'props=' || replace(url_encode(props), '%20', '+') || '&type=' || replace(url_encode(event_type || ' ~*é'), '%20', '+') || '&user=' || user_id AS q FROM events""")
def encoded_queries(spark, sf_dir):
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.concat("event_type", F.lit(" ~*é")), F.lit("props"), F.col("props"))
    return C.table(spark, sf_dir, "events").select("event_id", adapters.encode_query(params).alias("q"))


@query(f"""WITH {C.EVENTS} SELECT event_id, '{{"user":' || user_id || CASE WHEN k % 2 = 0 THEN ',"type":"' || event_type || '"' ELSE '' END || '}}' AS record,
'{{"user":' || user_id || ',"type":' || CASE WHEN k % 2 = 0 THEN '"' || event_type || '"' ELSE 'null' END || '}}' AS product_record FROM ev""")
def record_texts(spark, sf_dir):
    fields = [F.col("user_id").alias("user"), F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("type")]
    return C.events(spark, sf_dir).select("event_id", serving.record_json(*fields, keep_nulls=False).alias("record"), serving.record_json(*fields, keep_nulls=True).alias("product_record"))


def _targets(spark, sf_dir):
    rows = C.table(spark, sf_dir, "supplier")
    return serving.read_targets(rows.select(
        F.col("s_suppkey").cast("string").alias("target_id"), F.lit("site").alias("kind"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 90).cast("double").alias("latitude"),
        (F.col("s_suppkey") % 180).cast("double").alias("longitude"), (F.col("s_nationkey") % 5 == 0).alias("is_default"),
    ))


@query("""SELECT s_suppkey::VARCHAR AS target_id, CASE WHEN s_suppkey % 3 = 1 THEN 'renamed' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 1 THEN 20.0 ELSE 15.0 END::DOUBLE AS radius_km
FROM supplier WHERE s_nationkey % 5 = 0 OR s_suppkey % 3 <> 0 UNION ALL SELECT 'n' || n_nationkey, n_name, 15.0::DOUBLE FROM nation""")
def target_table(spark, sf_dir):
    """Suppliers as targets: nations are added, a third is renamed, and of another third those that are no defaults go."""
    targets = _targets(spark, sf_dir)
    nations = C.table(spark, sf_dir, "nation")
    new = nations.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("target_id"), F.lit("area").alias("kind"), F.col("n_name").alias("name"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    number = F.col("target_id").cast("long") % 3
    changed = targets.where(number == 1).withColumns({"name": F.lit("renamed"), "radius_km": F.lit(20.0)})
    gone = targets.where((number == 0) & ~F.col("is_default")).select("target_id")
    found = serving.delete_targets(serving.replace_targets(serving.add_targets(targets, new), changed), gone)
    return found.select("target_id", "name", "radius_km")


@query("SELECT ps.o_orderkey AS order_id, (ps.o_orderkey % 5 + 1)::VARCHAR AS target_id, s_name AS name FROM orders ps JOIN supplier ON s_suppkey = ps.o_orderkey % 5 + 1")
def resolved_targets(spark, sf_dir):
    wanted = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 5 + 1).cast("string").alias("target_id"))
    return serving.resolve_targets(wanted, _targets(spark, sf_dir)).select("order_id", "target_id", F.col("target.name").alias("name"))


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND date_trunc('day', ts) = TIMESTAMP '2024-01-03' AND user_id % 7 = 3""")
def issue_arrivals(spark, sf_dir):
    """Arrivals of one domain and issue for one target."""
    rows = C.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("domain"), F.date_trunc("day", "ts").alias("issue_time"), F.struct((F.col("user_id") % 7).cast("string").alias("target_id")).alias("target"))
    return serving.of_issue(rows, "click", "2024-01-03 00:00:00", "3").select("event_id")


@query("""SELECT replay_id, count(*) AS n FROM (SELECT 'r' || (event_id % 3) AS replay_id FROM events) WHERE replay_id <> 'r1' GROUP BY replay_id
UNION ALL SELECT 'only ' || replay_id, count(*) FROM (SELECT 'r' || (event_id % 3) AS replay_id FROM events) WHERE replay_id = 'r1' GROUP BY replay_id""")
def replay_runs(spark, sf_dir):
    """Rows of the replays without one of them, and of that one."""
    runs = C.table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("replay_id"))
    count = lambda rows: rows.groupBy("replay_id").agg(F.count(F.lit(1)).alias("n"))
    one = count(replay.replay_run(runs, "r1")).withColumn("replay_id", F.concat(F.lit("only "), F.col("replay_id")))
    return count(replay.without_replay(runs, "r1")).unionByName(one)
