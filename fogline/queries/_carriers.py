"""Record types of the engine as views of the carrier tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.operators.grid import dense

#: Rows (day of month) and columns (hour) of the event field.
NY, NX = 30, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Sums of doubles depend on their order; results are compared to six places."""
    return F.round(x, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns to six places, all integers as long."""
    cols = []
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            cols.append(r6(F.col(c).cast("double")).alias(c))
        elif kind in ("int", "smallint", "tinyint"):
            cols.append(F.col(c).cast("long").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k`` of their props."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def field(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    """Dense field (row, col, value): what the events of a day and hour add up to."""
    rows = table(spark, sf_dir, "events")
    rows = rows if event_type is None else rows.where(F.col("event_type") == event_type)
    cells = rows.groupBy((F.dayofmonth("ts") - 1).alias("row"), F.hour("ts").alias("col")).agg(F.round(F.sum("value"), 2).alias("value"))
    return dense(cells, NY, NX)


def field_sql(name: str, event_type: str | None = None) -> str:
    where = "" if event_type is None else f"WHERE event_type = '{event_type}' "
    return f"""{name}_cells AS (SELECT day(ts) - 1 AS r, hour(ts) AS c, round(sum(value), 2) AS v FROM events {where}GROUP BY ALL),
{name} AS (SELECT a.r, b.c, coalesce(x.v, 0.0)::DOUBLE AS v FROM (SELECT unnest(range({NY})) AS r) a CROSS JOIN (SELECT unnest(range({NX})) AS c) b
  LEFT JOIN {name}_cells x ON x.r = a.r AND x.c = b.c)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'click'")
    return rows.select(F.col("event_id").alias("forecast_id"), "user_id", F.col("ts").alias("issue_time"), (30 * (1 + F.col("event_id") % 4)).alias("lead_min"), "value")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("event_type = 'purchase'")
    return rows.select(F.col("event_id").alias("truth_id"), "user_id", F.col("ts").alias("obs_time"), (F.col("ts") + F.make_dt_interval(mins=F.col("k").cast("int"))).alias("arrival_time"), "value")


PAIRING = f"""{EVENTS},
f AS (SELECT event_id AS forecast_id, user_id, ts AS issue, 30 * (1 + event_id % 4) AS lead_min, value FROM ev WHERE event_type = 'click'),
t AS (SELECT event_id AS truth_id, user_id, ts AS obs, ts + to_minutes(k) AS arrival, value FROM ev WHERE event_type = 'purchase')"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification frames: orders with the customer as event and the region as domain."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    placed = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    month = F.month("o_orderdate")
    season = F.when(month.isin(12, 1, 2), "winter").when(month.between(3, 5), "pre_monsoon").when(month.between(6, 9), "monsoon").otherwise("post_monsoon")
    rows = table(spark, sf_dir, "orders").join(placed, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("frame_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_custkey").cast("string").alias("event_id"),
        F.col("r_name").alias("domain"), season.alias("season"), F.array(F.col("o_custkey").cast("string")).alias("manifest_ids"),
    )


FRAMES = """fr AS (
  SELECT o_orderkey AS frame_id, o_orderdate AS tm, o_custkey::VARCHAR AS event_id, r_name AS domain,
         CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'pre_monsoon'
              WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
