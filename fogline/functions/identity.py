"""Stable identities: payload hashes, observation keys, manifest hashes, figure and run ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.functions.times import iso_seconds


def payload_sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)


def observation_key(source: Column, station: Column, obs_time: Column, sha: Column) -> Column:
    """Identity of an observation to the second."""
    return F.sha2(F.concat_ws("|", source, station, iso_seconds(obs_time), sha), 256)


def precise_observation_key(source: Column, station: Column, obs_time: Column, sha: Column) -> Column:
    """The same with microseconds where there are any: both agree for whole seconds up to the zone's spelling."""
    t = obs_time.cast("timestamp")
    text = F.when(F.unix_micros(t) % 1_000_000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    return F.sha2(F.concat_ws("|", source, station, text, sha), 256)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII: for small metadata on the driver."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=lambda x: x.isoformat().replace("+00:00", "Z"))


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_hash(rows: DataFrame, by: list[str], manifest_id: str = "manifest_id", versions: dict[str, int] | None = None) -> DataFrame:
    """(by, data_hash): hash of the sorted distinct manifest ids of a group and the versions they were read under.

    Equal to hashing canonical JSON of ids and versions; ids must not need escaping.
    """
    tail = ",".join(f'"{k}":{v}' for k, v in sorted((versions or {}).items()))
    ids = F.array_sort(F.collect_set(F.col(manifest_id).cast("string")))
    quoted = F.array_join(F.transform("ids", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    text = F.concat(F.lit('{"manifest_ids":['), quoted, F.lit("]" + (f',"versions":{{{tail}}}' if tail else "") + "}"))
    return rows.groupBy(*by).agg(ids.alias("ids")).select(*by, F.sha2(text, 256).alias("data_hash"))


def figure_id(module: str, metric: str, axis: str, domain: str, period: str) -> str:
    return "F-" + "-".join((module, metric, axis, domain, period))


def run_id(data_hash: str, models: Iterable[str], spec: dict) -> str:
    return "vr-" + sha256_text(canonical_json({"data": data_hash, "models": sorted(models), "spec": spec}))[:16]


_CITABLE = re.compile(r"^F-[^-]+-[^-]+-[^-]+-[^-]+-[^-]+$")


def citable(figure: str, frozen: bool) -> bool:
    """A figure can be cited if its id has exactly five parts without hyphens and its run is frozen."""
    return bool(frozen and _CITABLE.match(figure))


def citable_column(figure: Column, frozen: Column) -> Column:
    return frozen & figure.rlike(_CITABLE.pattern)


def replay_path(kind: str, replay_id: str) -> str:
    """Namespace of a replay's outputs."""
    if kind not in ("grids", "products", "events"):
        raise ValueError(f"unknown namespace: {kind}")
    return f"{kind}/replay/{replay_id}"
