"""Ingestion: landed payloads to accepted observations, quarantine, and an idempotent manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogline.functions.identity import observation_key, payload_sha256
from fogline.functions.times import source_time
from fogline.operators.qc import freshness
from fogline.sources.catalogue import parse_config

MANIFEST_KEY = "observation_id"


#: Fields of a source: type, and default where the file may leave it out.
SPEC_FIELDS = {
    "name": (str,), "access_class": (str, ""), "cadence_s": (int,), "expected_latency_s": (int,), "endpoint": (str,), "auth": (str, "none"), "parser": (str,),
    "obs_time_rule": (str,), "retention_days": (int, None), "attribution": (str, ""), "terms_url": (str, ""), "status": (str, "not-started"),
}


@dataclass(frozen=True)
class SourceSpec:
    """What is known of a source; keys that are not known go to ``settings``."""

    name: str
    access_class: str
    cadence_s: int
    expected_latency_s: int
    endpoint: str
    auth: str
    parser: str
    obs_time_rule: str
    retention_days: int | None
    attribution: str
    terms_url: str
    status: str
    settings: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: Mapping, where: str = "source") -> SourceSpec:
        """A spec from a mapping, in which ``class`` stands for access_class; all fields that are lacking or of no use are named together."""
        raw = {("access_class" if k == "class" else str(k)): v for k, v in raw.items()}
        faults, known = [], {}
        for name, (kind, *default) in SPEC_FIELDS.items():
            if raw.get(name) is None and default:
                known[name] = default[0]
                continue
            try:
                known[name] = kind(raw[name])
            except (KeyError, TypeError, ValueError):
                faults.append(name)
        if faults:
            raise ValueError(f"{where}: {', '.join(faults)}")
        return cls(**known, settings={k: v for k, v in raw.items() if k not in SPEC_FIELDS})


def load_specs(spark: SparkSession, path: str) -> dict[str, SourceSpec]:
    """Specs by name from the JSON and YAML files of a folder, in order of their names; a repeated name raises. Configuration, so
    read on the driver."""
    found: dict[str, SourceSpec] = {}
    files = spark.read.option("pathGlobFilter", "*.{json,yaml,yml}").text(path, wholetext=True).select("value", "_metadata.file_name").collect()
    for r in sorted(files, key=lambda r: r["file_name"]):
        spec = SourceSpec.of(parse_config(r["value"], r["file_name"]) or {}, r["file_name"])
        if spec.name in found:
            raise ValueError(f"duplicate source: {spec.name}")
        found[spec.name] = spec
    return found


def specs_table(spark: SparkSession, specs: dict[str, SourceSpec]) -> DataFrame:
    rows = [(s.name, s.access_class, s.parser, s.cadence_s, s.expected_latency_s, s.retention_days, s.status) for s in specs.values()]
    return F.broadcast(spark.createDataFrame(rows, "source string, access_class string, parser string, cadence_s int, expected_latency_s int, retention_days int, status string"))


def image_payload(payload: Column, content_type: Column) -> Column:
    """An image by its declared type or its first bytes."""
    head = F.hex(F.substring(payload, 1, 6))
    magic = head.startswith("474946383761") | head.startswith("474946383961") | head.startswith("89504E47") | head.startswith("FFD8FF")
    return F.coalesce(content_type, F.lit("")).startswith("image/") | magic


def grib_payload(payload: Column) -> Column:
    return F.hex(F.substring(payload, 1, 4)) == "47524942"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed files as payload rows: url (the path), payload, arrival_time."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.col("content").alias("payload"), F.col("modificationTime").alias("arrival_time"))


def check_payloads(landed: DataFrame, kind: str = "image", fallback_lag_s: int | None = None, max_age_s: int | None = None) -> DataFrame:
    """Adds obs_time, time_from, payload_sha256, observation_id and reason (null if accepted) to landed payloads.

    ``landed`` has source, station, url, payload, content_type, status and arrival_time. Without a timestamp the payload is
    quarantined, or with ``fallback_lag_s`` taken as observed that long before arrival and marked ``estimated``.
    """
    found, where = source_time(F.col("payload"), F.col("url"))
    rows = landed.withColumn("_found", found).withColumn("_where", where)
    guess = F.timestamp_micros(F.unix_micros(F.col("arrival_time").cast("timestamp")) - (fallback_lag_s or 0) * 1_000_000)
    obs = F.coalesce("_found", guess) if fallback_lag_s is not None else F.col("_found")
    rows = rows.withColumn("obs_time", obs).withColumn("time_from", F.coalesce("_where", F.lit("estimated" if fallback_lag_s is not None else None).cast("string")))
    status = F.coalesce(F.col("status"), F.lit(200))
    is_kind = {"image": image_payload(F.col("payload"), F.col("content_type")), "grib": grib_payload(F.col("payload")), "any": F.lit(True)}[kind]
    late = freshness(F.col("obs_time"), F.col("arrival_time"), max_age_s if max_age_s is not None else 2**31)
    reason = (
        F.when((status < 200) | (status >= 300), "http_status")
        .when(F.coalesce(F.length("payload"), F.lit(0)) == 0, "empty_payload")
        .when(~is_kind, F.lit(f"not_{kind}"))
        .when(F.col("obs_time").isNull(), "missing_source_timestamp")
        .when(late == "future", "future_observation")
        .when(late == "stale", "stale_observation")
    )
    rows = rows.withColumn("payload_sha256", payload_sha256(F.col("payload"))).withColumn("reason", reason)
    key = observation_key(F.col("source"), F.col("station"), F.col("obs_time"), F.col("payload_sha256"))
    return rows.withColumn(MANIFEST_KEY, F.when(F.col("reason").isNull(), key)).drop("_found", "_where")


def archive_path(source: Column, station: Column, obs: Column, sha: Column, suffix: Column) -> Column:
    """Content-addressed place of a payload: the same bytes always have the same place."""
    safe = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")
    return F.concat_ws("/", safe(source), safe(station), F.date_format(obs, "yyyy/MM/dd"), F.concat(sha, suffix))


def split_accepted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) of checked payloads."""
    quarantine = checked.where("reason is not null").select("source", "reason", F.col("arrival_time").alias("recorded_at"), "payload_sha256", "url")
    return checked.where("reason is null"), quarantine


def merge_manifest(known: DataFrame | None, arrivals: DataFrame) -> DataFrame:
    """Manifest after arrivals: one row per observation_id.

    The first arrival and first_seen stay; status and metadata are those of the last arrival, the path the last that was
    given; last_seen and seen_count move on. Commutes with splitting the arrivals into batches in time order.
    """
    new = arrivals.select(MANIFEST_KEY, "source", "station", "obs_time", "arrival_time", "path", "status", "metadata", F.col("arrival_time").alias("first_seen"), F.col("arrival_time").alias("last_seen"), F.lit(1).cast("long").alias("seen_count"))
    rows = new if known is None else known.select(*new.columns).unionByName(new)
    by_last = lambda c: F.max_by(c, F.struct("last_seen", F.col("seen_count") * -1))
    with_path = F.when(F.col("path").isNotNull(), F.struct("last_seen", "path"))
    return rows.groupBy(MANIFEST_KEY).agg(
        F.min_by("source", "first_seen").alias("source"),
        F.min_by("station", "first_seen").alias("station"),
        F.min_by("obs_time", "first_seen").alias("obs_time"),
        F.min("arrival_time").alias("arrival_time"),
        F.max(with_path)["path"].alias("path"),
        by_last("status").alias("status"),
        by_last("metadata").alias("metadata"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("seen_count").alias("seen_count"),
    )


def list_manifest(manifest: DataFrame, source: str | None = None, station: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a source or station in order of observation, source and station; ``limit`` is a top-k."""
    rows = manifest
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if station is not None:
        rows = rows.where(F.col("station") == station)
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    ordered = rows.orderBy("obs_time", "source", "station", MANIFEST_KEY)
    return ordered if limit is None else ordered.limit(limit)


def count_manifest(manifest: DataFrame, source: str | None = None) -> DataFrame:
    """(n): rows of the manifest, or of one source."""
    rows = manifest if source is None else manifest.where(F.col("source") == source)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def find_manifest(manifest: DataFrame, observation_id: str) -> DataFrame:
    """The row of an observation with all its columns, or none; on files sorted by id the filter reaches the scan."""
    return manifest.where(F.col(MANIFEST_KEY) == observation_id)


def health(attempts: DataFrame, specs: DataFrame, now: Column) -> DataFrame:
    """Health per source from attempts (source, at, outcome: accepted, quarantined or failed) and specs.

    Consecutive failures are those after the last accepted attempt; quarantine leaves them as they are. A source is healthy
    within latency plus cadence of its last success and without consecutive failures, degraded within the grace period, then
    stale; without any success it has failed or is unknown.
    """
    ok = attempts.where("outcome = 'accepted'").groupBy(F.col("source").alias("_source")).agg(F.max("at").alias("_ok"))
    rows = attempts.join(F.broadcast(ok), F.col("source") == F.col("_source"), "left")  # a row per configured source
    failed = F.col("outcome") == "failed"
    agg = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.count_if(F.col("outcome") == "quarantined").alias("quarantined"),
        F.count_if(failed).alias("failures"),
        F.count_if(failed & (F.col("_ok").isNull() | (F.col("at") > F.col("_ok")))).alias("consecutive_failures"),
        F.max("_ok").alias("last_success"),
        F.max(F.when(failed, F.col("at"))).alias("last_failure"),
    )
    joined = specs.select("source", "cadence_s", "expected_latency_s").join(agg, "source", "left")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_success").cast("timestamp"))) / F.lit(1e6)
    grace = F.greatest(F.col("cadence_s") * 3, F.col("expected_latency_s") * 2)
    status = (
        F.when(F.col("last_success").isNull(), F.when(F.col("last_failure").isNotNull(), "failed").otherwise("unknown"))
        .when((age <= F.col("expected_latency_s") + F.col("cadence_s")) & (F.col("consecutive_failures") == 0), "healthy")
        .when(age <= grace, "degraded")
        .otherwise("stale")
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("attempts", "accepted", "quarantined", "failures", "consecutive_failures")]
    return joined.select("source", status.alias("status"), F.coalesce(age <= grace, F.lit(False)).alias("publishing"), *counts, "last_success", "last_failure")


def request_grid(stations: DataFrame, products: Sequence[str]) -> DataFrame:
    """Every station with every product: the requests of one poll."""
    return stations.select("station", F.explode(F.array(*[F.lit(p) for p in products])).alias("product"))


def forecast_steps(cycles: DataFrame, steps: Sequence[int]) -> DataFrame:
    """One row per cycle and step (hours), valid at cycle plus step."""
    rows = cycles.select("*", F.explode(F.array(*[F.lit(int(s)) for s in steps])).alias("step_h"))
    return rows.withColumn("valid_time", F.timestamp_seconds(F.unix_seconds("cycle") + F.col("step_h") * 3600))


def palette_histogram(pixels: DataFrame, palette: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels (keys, pixel) counted by the value a palette (pixel, value) gives them; unknown pixels have a null value."""
    joined = pixels.join(F.broadcast(palette.select("pixel", "value")), "pixel", "left")  # a palette has 256 entries at most
    total = Window.partitionBy(*keys)
    counted = joined.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    unknown = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))).over(total), F.lit(0)) / F.sum("n").over(total)
    return counted.withColumn("unknown_fraction", unknown)


#: Keys, in small letters and digits only, whose values are times of issue or of validity.
ISSUE_KEYS = ("issuetime", "issuedat", "issuedon", "updatedat", "obstime", "observationtime", "observationdate", "timestamp", "datetime", "date")
VALID_KEYS = ("validtime", "validfrom", "validuntil", "validto", "validity")
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'


def json_leaves(text: Column) -> Column:
    """Keys and values of all members with a plain value, at any depth and in the order of the text: array of (key, value).
    Null and invalid texts have none. Only built-in functions: the text is cut into tokens, and a member is a string, a colon
    and a token that opens nothing."""
    from fogline.functions.times import once

    valid = F.when(F.try_parse_json(text).isNotNull(), text)
    plain = lambda t: F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")
    held = lambda tokens, t, i: once(F.get(tokens, i + 2), lambda v: F.when((F.get(tokens, i + 1) == ":") & ~v.isin("{", "["), F.struct(plain(t).alias("key"), plain(v).alias("value"))))
    found = once(F.regexp_extract_all(valid, F.lit(_TOKEN), F.lit(0)), lambda tokens: F.array_compact(F.transform(tokens, lambda t, i: held(tokens, t, i))))
    return F.coalesce(F.filter(found, lambda m: m["value"].isNotNull()), F.array().cast("array<struct<key: string, value: string>>"))


def json_times(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Adds issue_time, valid_time and any_time (first time-like value) found at any depth of a JSON text."""
    from fogline.functions.times import once, parse_timestamp

    name = lambda m: F.regexp_replace(F.lower(m["key"]), "[^a-z0-9]", "")
    time = lambda v: F.when(v.rlike("[0-9]"), parse_timestamp(v, once))
    timed = F.transform(json_leaves(F.col(column).cast("string")), lambda m: F.struct(name(m).alias("name"), time(m["value"]).alias("at")))
    rows = documents.withColumn("_times", F.filter(timed, lambda x: x["at"].isNotNull()))
    first = lambda cond: F.get(F.filter("_times", cond), F.lit(0))["at"]
    return rows.withColumns({
        "issue_time": first(lambda x: x["name"].isin(*ISSUE_KEYS)), "valid_time": first(lambda x: x["name"].isin(*VALID_KEYS)), "any_time": first(lambda x: F.lit(True)),
    }).drop("_times")


#: Keys under which an object of a nowcast says its category and the rest, the first that is given counts.
NOWCAST_KEYS = {
    "category": ("category", "warning", "colour", "color", "severity", "nowcast"),
    "district": ("district", "district_name"),
    "station": ("station", "station_name"),
    "valid_from": ("valid_from", "validFrom"),
    "valid_to": ("valid_to", "validTo"),
}


def _children(node: Column) -> Column:
    """Members of an object or items of an array, as an array of variants; of a plain value none."""
    members = F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))
    return F.coalesce(members, F.try_variant_get(node, "$", "array<variant>"), F.array().cast("array<variant>"))


def json_depth(text: Column) -> Column:
    """How deep objects and arrays lie inside each other in a JSON text; brackets inside strings do not count."""
    tokens = F.coalesce(F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[{}\[\]]'), F.lit(0)), F.array().cast("array<string>"))
    turn = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda acc, t: F.struct((acc["now"] + turn(t)).alias("now"), F.greatest(acc["most"], acc["now"] + turn(t)).alias("most"))
    return F.aggregate(tokens, start, step, lambda acc: acc["most"])


def json_nodes(text: Column) -> Column:
    """Every object and array of a JSON text, and every plain item, at any depth: an array of variants, level by level.

    A fold over the levels of the text itself, so a plan is as large for deep texts as for flat ones. Null and invalid texts,
    and objects that repeat a key, have none.
    """
    root = F.try_parse_json(text)
    none = F.array().cast("array<variant>")
    start = F.struct(F.array_compact(F.array(root)).alias("level"), none.alias("above"))
    below = lambda level: F.flatten(F.transform(level, _children))
    step = lambda acc, _: F.struct(below(acc["level"]).alias("level"), F.concat(acc["above"], acc["level"]).alias("above"))
    levels = F.sequence(F.lit(1), F.greatest(json_depth(text), F.lit(1)))
    return F.when(root.isNotNull(), F.aggregate(levels, start, step, lambda acc: F.concat(acc["above"], acc["level"])))


def _said(value: Column) -> Column:
    """A variant as text: strings as they are, truth values as True and False, other values as JSON; null of JSON null."""
    plain = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(plain)).otherwise(plain)


def _empty(value: Column) -> Column:
    """Whether a variant is null, an empty text, zero, false, or an object or array without content."""
    plain = F.try_variant_get(value, "$", "string")
    return plain.isNull() | F.when(F.schema_of_variant(value) == "STRING", plain == "").otherwise(plain.isin("0", "false", "{}", "[]"))


def nowcast_categories(documents: DataFrame, column: str = "payload") -> DataFrame:
    """One row per category found at any depth of a JSON text: category, district, station, valid_from, valid_to.

    The first category key that is not null counts, even if its value is empty; of the other fields an empty value gives way
    to the next key. Only built-in functions on variants: no Python worker reads the texts.
    """

    def row(members: Column) -> Column:
        first = lambda keys, skip: F.coalesce(*[F.when(~skip(members[k]), _said(members[k])) for k in keys])
        absent = lambda v: F.try_variant_get(v, "$", "string").isNull()
        return F.struct(*[first(keys, absent if field == "category" else _empty).alias(field) for field, keys in NOWCAST_KEYS.items()])

    keep = [c for c in documents.columns if c != column]
    objects = F.filter(F.transform(json_nodes(F.col(column).cast("string")), lambda n: F.try_variant_get(n, "$", "map<string,variant>")), lambda m: m.isNotNull())
    found = documents.select(*keep, F.explode(objects).alias("_members")).select(*keep, row(F.col("_members")).alias("_c"))
    return found.where(F.col("_c.category").isNotNull()).select(*keep, "_c.*")
