"""Products: rule sets, point queries, abstentions, alerts and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fogline.operators import decide, products
from fogline.queries import _carriers as C
from fogline.queries._registry import query


def _products(spark, sf_dir):
    """Events as products of a domain per event type."""
    rows = C.events(spark, sf_dir)
    k, ts = F.col("k"), F.col("ts").cast("timestamp")
    lead = (30 * (1 + F.col("event_id") % 8)).cast("int")
    inputs = F.array(F.struct(F.when(k % 11 != 0, "sat").alias("source"), F.when(k % 2 == 0, ts).alias("obs_time"), F.when(k % 3 == 0, k - 3.0).alias("age_min"), (k % 4 == 0).alias("missing")))
    reason = F.when(k % 10 == 0, "no_radar").when(k % 10 == 1, "made_up")
    stops = F.when(reason.isNotNull(), F.array(F.struct(F.lit("M4").alias("module"), reason.alias("reason"), F.lit("why").alias("detail")))).otherwise(F.array().cast(decide.ABSTENTION))
    return rows.select(
        F.col("event_id").alias("ordinal"), F.lit("rain").alias("product"), F.when(k != 13, "mean").alias("variant"), F.col("event_type").alias("domain"), (F.col("user_id") % 5).alias("domain_version"), ts.alias("issue_time"),
        F.timestamp_micros(F.unix_micros(ts) + F.when(k % 5 == 0, lead + 1).otherwise(lead).cast("long") * 60_000_000).alias("valid_time"), lead.alias("lead_min"), decide.lead_tier(lead).alias("tier"), F.concat(F.lit("R"), (k % 6).cast("string")).alias("rung"),
        F.when(k % 2 == 0, "live").otherwise("replay").alias("mode"), F.when(k % 7 != 0, "r1").alias("replay_id"), F.lit("m1").alias("model_version"), F.when(k % 3 == 0, "F-1").alias("skill_ref"), (k % 4 == 1).alias("research"), F.lit("w").alias("watermark"),
        inputs.alias("inputs"), stops.alias("abstentions"), F.create_map(F.lit("max"), F.col("value")).alias("stats"), F.lit(2.0).alias("effective_resolution_km"), F.array(F.lit(0.0), k.cast("double"), F.lit(50.0)).alias("legend_bins"), "k",
    )


_SHARED = """CASE WHEN user_id % 5 < 1 THEN 'domain_version' END, CASE WHEN k % 6 = 5 THEN 'rung' END, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'live_replay_id' END, CASE WHEN k % 2 = 1 AND k % 7 = 0 THEN 'replay_without_id' END,
CASE WHEN k % 3 <> 0 AND k % 4 <> 1 THEN 'skill_ref' END, CASE WHEN k % 11 = 0 THEN 'input_source' END, CASE WHEN k % 3 = 0 AND k < 3 THEN 'input_age' END"""


@query(f"""WITH {C.EVENTS} SELECT event_id AS ordinal, concat_ws(',', {_SHARED}, CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 'missing_with_age' END, CASE WHEN k = 13 THEN 'product' END, CASE WHEN k > 50 THEN 'legend' END) AS violations FROM ev""")
def product_violations(spark, sf_dir):
    return products.published_violations(_products(spark, sf_dir)).select("ordinal", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {C.EVENTS} SELECT event_id AS ordinal, concat_ws(',', {_SHARED}, CASE WHEN k % 5 = 0 THEN 'valid_time' END, CASE WHEN k % 4 = 1 AND k % 3 = 0 THEN 'research_skill' END, CASE WHEN k % 10 = 1 THEN 'reason_code' END,
CASE WHEN k % 4 <> 0 AND k % 2 = 1 AND k % 3 = 0 THEN 'age_without_time' END) AS violations FROM ev""")
def common_violations(spark, sf_dir):
    return products.common_violations(_products(spark, sf_dir)).select("ordinal", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {C.EVENTS} SELECT event_id AS ordinal, concat_ws(',', CASE WHEN k < 5 THEN 'identity' END, CASE WHEN k % 6 = 5 THEN 'rung' END, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 'unfrozen_skill' END, CASE WHEN k % 3 = 0 AND k % 9 <> 0 THEN 'figure_id' END,
CASE WHEN k % 3 = 0 AND event_type = 'error' THEN 'synthetic_skill' END, CASE WHEN k % 8 = 0 THEN 'research_figures' END, CASE WHEN k % 10 = 1 THEN 'reason_code' END) AS violations FROM ev""")
def model_violations(spark, sf_dir):
    k = F.col("k")
    rows = _products(spark, sf_dir).withColumns({
        "data_manifest_hash": F.when(k >= 5, "h"), "synthetic": F.col("domain") == "error", "frozen": k % 2 == 0, "research_only": F.lit(True),
        "skill_ref": F.when(k % 9 == 0, "F-a-b-c-d-e").when(k % 3 == 0, "F-a-b-c"), "figure_ids": F.when(k % 8 == 0, F.array(F.lit("F-a-b-c-d-e"))),
    })
    return products.model_violations(rows).select("ordinal", F.array_join("violations", ",").alias("violations"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'identity' END, CASE WHEN c_nationkey > 20 THEN 'coordinates' END, CASE WHEN c_acctbal <= 0 THEN 'radius' END) AS violations FROM customer")
def target_violations(spark, sf_dir):
    rows = C.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("target_id"), F.lit("town").alias("kind"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_nationkey") > 20, 91.0).otherwise(10.0).alias("latitude"), F.lit(80.0).alias("longitude"), F.col("c_acctbal").alias("radius_km"),
    )
    return products.target_violations(rows).select("c_custkey", F.array_join("violations", ",").alias("violations"))


@query("SELECT event_id AS ordinal FROM events WHERE event_type = 'view' AND 30 * (1 + event_id % 8) BETWEEN 61 AND 180 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20'")
def product_list(spark, sf_dir):
    return products.list_products(_products(spark, sf_dir), domain="view", product="rain", tier="B", since="2024-01-03", until="2024-01-20").select("ordinal")


@query("SELECT event_type AS domain, 30 * (1 + event_id % 8) AS lead_min, min(event_id) AS first_ordinal, max(event_id) AS last_ordinal FROM events GROUP BY ALL")
def product_point(spark, sf_dir):
    """First and last product of each domain and lead: what a point query and an upsert keep."""
    rows = _products(spark, sf_dir).select("domain", "lead_min", "ordinal")
    first = products.keep_first(rows, ["domain", "lead_min"]).withColumnRenamed("ordinal", "first_ordinal")
    last = products.upsert_products(rows, ["domain", "lead_min"]).withColumnRenamed("ordinal", "last_ordinal")
    return C.rounded(first.join(last, ["domain", "lead_min"]))


@query(f"WITH {C.EVENTS} SELECT event_type AS domain, count(*) AS products, arg_max('R' || (k % 6), event_id) AS rung, epoch_us(arg_max(ts, event_id)) // 1000000 AS issue_s, arg_max(CASE WHEN k % 2 = 0 THEN 'live' ELSE 'replay' END, event_id) AS mode, arg_max(k % 4 = 1, event_id) AS research FROM ev GROUP BY event_type")
def domain_status(spark, sf_dir):
    found = products.domain_status(_products(spark, sf_dir))
    return found.select("domain", "products", "rung", F.unix_seconds("issue_time").alias("issue_s"), "mode", "research")


@query(f"WITH {C.EVENTS} SELECT event_type AS domain, CASE k % 10 WHEN 0 THEN 'no_radar' ELSE 'made_up' END AS reason, count(*) AS n FROM ev WHERE k % 10 < 2 GROUP BY ALL")
def abstentions_unnest(spark, sf_dir):
    return products.abstentions(_products(spark, sf_dir)).groupBy("domain", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT event_type, 30 * (1 + event_id % 8) AS lead_min FROM events), w AS (SELECT DISTINCT event_type, 10 * (user_id % 30) AS lead FROM events)
SELECT event_type AS domain, lead, arg_min(lead_min, struct_pack(d := abs(lead_min - lead), l := lead_min)) AS nearest_lead FROM w JOIN p USING (event_type) GROUP BY ALL""")
def nearest_lead(spark, sf_dir):
    wanted = C.table(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), (10 * (F.col("user_id") % 30)).alias("lead")).distinct()
    return C.rounded(products.nearest_lead(_products(spark, sf_dir), wanted, ["domain"]))


@query(f"""WITH {C.EVENTS}, a AS (SELECT event_id, ts, k / 100.0 AS p, CASE WHEN k % 4 <> 0 THEN k END AS t10, CASE WHEN k % 5 <> 0 THEN k * 6 END AS t90 FROM ev)
SELECT event_id, CASE WHEN t10 <= 30 THEN 'Immediate' ELSE 'Expected' END AS urgency, CASE WHEN p >= 0.7 THEN 'Severe' WHEN p >= 0.4 THEN 'Moderate' ELSE 'Minor' END AS severity,
CASE WHEN p >= 0.6 THEN 'Likely' WHEN p >= 0.3 THEN 'Possible' ELSE 'Unlikely' END AS certainty, epoch_us(ts) // 1000000 + coalesce(t10, 0) * 60 AS onset_s, epoch_us(ts) // 1000000 + least(coalesce(t90, 360), 360) * 60 AS expires_s FROM a""")
def alert_fields(spark, sf_dir):
    k = F.col("k")
    rows = C.events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("issue_time"), (k / 100).alias("probability"), F.when(k % 4 != 0, k).alias("t10_min"), F.when(k % 5 != 0, k * 6).alias("t90_min"))
    return products.alert_fields(rows).select("event_id", "urgency", "severity", "certainty", F.unix_seconds("onset").alias("onset_s"), F.unix_seconds("expires").alias("expires_s"))


@query(f"""WITH {C.EVENTS} SELECT event_id, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'number:' || (k + 200) END, CASE WHEN k % 5 = 0 THEN 'watermark' END, CASE WHEN k % 7 = 0 THEN 'target' END, CASE WHEN k % 2 = 0 THEN 'unexpected-hazard:hail' END) AS problems FROM ev""")
def explanation_guard(spark, sf_dir):
    k = F.col("k")
    text = F.concat(
        F.lit("rain near "), F.when(k % 7 != 0, F.lit("Town")).otherwise("?"), F.lit(" P=0.50 at "), F.when(k % 3 == 0, "soon").otherwise((k + 200).cast("string")),
        F.when(k % 2 == 0, F.lit(" with hail")).otherwise(""), F.lit(". "), F.when(k % 5 == 0, "").otherwise(products.WATERMARK),
    )
    rows = C.events(spark, sf_dir).select("event_id", text.alias("text"), F.array(F.lit("0.5"), (k + 200).cast("string")).alias("numbers"), F.lit(products.WATERMARK).alias("watermark"), F.lit("Town").alias("target_name"), F.array(F.lit("Rain")).alias("hazards"), F.lit("public").alias("audience"))
    return products.explanation_problems(rows).select("event_id", F.array_join("problems", ",").alias("problems"))


@query(f"""WITH {C.EVENTS} SELECT event_id, 'rain, hail expected at ' || CASE WHEN k % 3 = 0 THEN 'the target' ELSE event_type END
|| CASE WHEN k % 4 = 0 THEN '' ELSE ', chance 0.5, arriving 10 to ' || (k + 20) || ' min from issue (middle 15)' END || '. w' AS explanation FROM ev""")
def explanation_texts(spark, sf_dir):
    k = F.col("k")
    text = products.explanation_text(F.array(F.lit("rain"), F.lit("hail")), F.when(k % 3 != 0, F.col("event_type")), F.when(k % 4 != 0, F.lit("0.50")), F.lit(10), F.lit("15.0"), k + 20, F.lit("w"))
    return C.events(spark, sf_dir).select("event_id", text.alias("explanation"))


@query(f"""WITH {C.EVENTS} SELECT event_id, '<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>a' || event_id || '</identifier><sender>s</sender><sent>2024-01-01T00:00:00+00:00</sent><status>Exercise</status><msgType>Alert</msgType><scope>Public</scope><info>'
|| '<language>en</language><category>Met</category><event>rain</event><urgency>Expected</urgency><severity>Minor</severity><certainty>Unlikely</certainty><onset>2024-01-01T00:00:00+00:00</onset><expires>2024-01-01T06:00:00+00:00</expires>'
|| '<senderName>d</senderName><headline>rain expected at A &amp; B</headline><description>rain, 0.' || lpad(k::VARCHAR, 2, '0').rtrim('0') || '</description><parameter><valueName>domain</valueName><value>' || event_type || '</value></parameter><area><areaDesc>A &amp; B</areaDesc>'
|| CASE WHEN k % 2 = 0 THEN '<circle>10.0,80.5 5</circle>' ELSE '' END || '</area></info></alert>' AS xml FROM ev WHERE k BETWEEN 1 AND 29""")
def alert_documents(spark, sf_dir):
    """Alerts with given texts; only columns named as parameters are passed on."""
    k, at = F.col("k"), F.lit("2024-01-01").cast("timestamp")
    rows = C.events(spark, sf_dir).where(k.between(1, 29)).select(
        "event_id", F.concat(F.lit("a"), F.col("event_id")).alias("alert_id"), F.lit("Exercise").alias("status"), at.alias("sent"), at.alias("issue_time"), F.col("event_type").alias("domain"), F.array(F.lit("rain")).alias("hazards"),
        F.lit("A & B").alias("target_name"), F.when(k % 2 == 0, 10.0).alias("latitude"), F.lit(80.5).alias("longitude"), F.lit(5).alias("radius_km"), (k / 100).alias("probability"), F.lit(None).cast("int").alias("t10_min"), F.lit(None).cast("int").alias("t90_min"),
    )
    texts = {"sender": "s", "sender_name": "d", "description": "{hazards}, {probability}"}
    return products.alert_xml(products.alert_fields(rows), texts, ["domain"]).select("event_id", "xml")
