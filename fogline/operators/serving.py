"""Tables behind the products: targets that users keep, objects and arrivals of an issue, records as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_COLUMNS = ("target_id", "kind", "name", "latitude", "longitude", "radius_km", "admin_code", "is_default")


def _guard(value: Column, bad: Column, text: str, about: Column) -> Column:
    """``value``, unless the row is bad: then the query fails with ``text`` and what it is about."""
    message = F.concat(F.lit(f"{text}: "), F.coalesce(about.cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(message).cast("string")).otherwise(value)


def _ids(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("target_id").alias("_known")).distinct()


def read_targets(raw: DataFrame) -> DataFrame:
    """Targets from raw rows: missing radius is 15 km, missing is_default false; without id, kind, name or place it raises."""
    have = set(raw.columns)
    take = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    lacks = F.greatest(*[F.col(c).isNull() for c in ("target_id", "kind", "name", "latitude", "longitude")])
    return raw.select(
        _guard(F.col("target_id").cast("string"), lacks, "target fields are missing", F.col("target_id")).alias("target_id"), F.col("kind").cast("string").alias("kind"), F.col("name").cast("string").alias("name"),
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), take("radius_km", F.lit(15.0)).cast("double").alias("radius_km"),
        take("admin_code", F.lit(None)).cast("string").alias("admin_code"), take("is_default", F.lit(False)).cast("boolean").alias("is_default"),
    )


def add_targets(targets: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables; an id that exists, or comes twice in ``new``, raises."""
    new = read_targets(new)
    twice = new.groupBy(F.col("target_id").alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = new.join(_ids(targets), F.col("target_id") == F.col("_known"), "left").join(twice, F.col("target_id") == F.col("_twice"), "left")
    checked = rows.withColumn("target_id", _guard(F.col("target_id"), F.col("_known").isNotNull() | F.col("_twice").isNotNull(), "target exists", F.col("target_id")))
    return targets.select(*TARGET_COLUMNS).unionByName(checked.select(*TARGET_COLUMNS))


def replace_targets(targets: DataFrame, changed: DataFrame) -> DataFrame:
    """``targets`` with the rows of ``changed`` in place of those with their ids; an id that is unknown, or comes twice in ``changed``, raises."""
    changed = read_targets(changed)
    twice = changed.groupBy(F.col("target_id").alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    changed = changed.join(_ids(targets), F.col("target_id") == F.col("_known"), "left").join(twice, F.col("target_id") == F.col("_twice"), "left")
    checked = changed.withColumn("target_id", _guard(F.col("target_id"), F.col("_known").isNull(), "no such target", F.col("target_id")))
    checked = checked.withColumn("target_id", _guard(F.col("target_id"), F.col("_twice").isNotNull(), "target changed twice", F.col("target_id")))
    kept = targets.join(checked.select(F.col("target_id").alias("_new")), F.col("target_id") == F.col("_new"), "left_anti")
    return kept.select(*TARGET_COLUMNS).unionByName(checked.select(*TARGET_COLUMNS))


def delete_targets(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """``targets`` without the ids of (target_id); an unknown id or a default target raises."""
    wanted = ids.select(F.col("target_id").cast("string").alias("_gone")).distinct()
    rows = targets.join(wanted, F.col("target_id") == F.col("_gone"), "full")
    rows = rows.withColumn("target_id", _guard(F.col("target_id"), F.col("target_id").isNull(), "no such target", F.col("_gone")))
    rows = rows.withColumn("target_id", _guard(F.col("target_id"), F.col("_gone").isNotNull() & F.col("is_default"), "default targets stay", F.col("_gone")))
    return rows.where(F.col("_gone").isNull() | (F.col("target_id") != F.col("_gone"))).select(*TARGET_COLUMNS)


def resolve_targets(wanted: DataFrame, targets: DataFrame, column: str = "target_id") -> DataFrame:
    """The rows of ``wanted`` with their target as a struct; an unknown or null id raises."""
    known = targets.select(F.col("target_id").alias("_id"), F.struct(*TARGET_COLUMNS).alias("target"))
    rows = wanted.join(known, F.col(column) == F.col("_id"), "left")
    return rows.withColumn(column, _guard(F.col(column).cast("string"), F.col("_id").isNull(), "unknown target", F.col(column))).drop("_id")


def of_issue(rows: DataFrame, domain: str, issue_time: str, target: str | None = None) -> DataFrame:
    """Objects, or arrivals with a nested ``target``, of one domain and issue; both are required."""
    if not domain or not issue_time:
        raise ValueError("domain and issue_time are required")
    found = rows.where((F.col("domain") == domain) & (F.col("issue_time").cast("timestamp") == F.lit(issue_time).cast("timestamp")))
    return found if target is None else found.where(F.col("target.target_id") == target)


def record_json(*fields: Column, keep_nulls: bool) -> Column:
    """A record as JSON text in the order of its fields; nulls are kept for products and dropped for all other records."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": str(not keep_nulls).lower()})
