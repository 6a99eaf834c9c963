"""Channel catalogue and domains from configuration, and resampling that follows the catalogue."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.functions.projection import Domain
from fogline.operators.grid import POLICIES, bilinear, regrid_by


@dataclass(frozen=True)
class Channel:
    """One entry of the catalogue; ``resampling`` names a policy of ``grid.POLICIES``."""

    group: str
    name: str
    dtype: str
    scale: float
    source: str
    resampling: str
    fill_value: float
    units: str | None = None

    @property
    def qualified(self) -> str:
        return f"{self.group}/{self.name}"


def parse_config(text: str, name: str) -> dict:
    """A configuration text as a mapping: JSON, or YAML by the file's name where PyYAML is installed."""
    if not name.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError(f"{name}: PyYAML is not installed; give the file as JSON") from missing
    return yaml.safe_load(text)


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration file as a mapping. Small, so read on the driver."""
    return parse_config(spark.read.text(path, wholetext=True).first()["value"], path)


def channels_of(raw: Mapping) -> dict[str, Channel]:
    """Channels by ``group/name`` from {channel_version, channels: {group: {name: entry}}}; all faults are reported together."""
    faults, found = [], {}
    if not isinstance(raw.get("channel_version"), int) or raw["channel_version"] < 1:
        faults.append("channel_version must be a positive integer")
    groups = raw.get("channels")
    if not isinstance(groups, Mapping) or not groups:
        faults.append("channels must be a mapping with entries")
    for group, entries in (groups.items() if isinstance(groups, Mapping) else ()):
        if not isinstance(entries, Mapping):
            faults.append(f"{group}: not a mapping")
            continue
        for name, entry in entries.items():
            lacks = [k for k in ("dtype", "scale", "source", "resampling", "fill_value") if k not in entry]
            if lacks:
                faults.append(f"{group}/{name}: lacks {', '.join(lacks)}")
                continue
            channel = Channel(str(group), str(name), str(entry["dtype"]), float(entry["scale"]), str(entry["source"]), str(entry["resampling"]), entry["fill_value"], entry.get("units"))
            if channel.qualified in found:
                faults.append(f"{channel.qualified}: given twice")
            found[channel.qualified] = channel
    if faults:
        raise ValueError("; ".join(faults))
    return found


def channel(channels: Mapping[str, Channel], name: str) -> Channel:
    """A channel by ``group/name``, or by name alone: then that of the first group that has it."""
    if name in channels:
        return channels[name]
    for found in channels.values():
        if found.name == name:
            return found
    raise KeyError(f"unknown channel: {name}")


def domains_of(raw: Mapping) -> dict[str, Domain]:
    """Domains by name from {domains: {name: entry}}: spacing as dx_m or dx_deg, the corner as upper_left_xy_m or upper_left_lonlat."""
    entries = raw.get("domains")
    if not isinstance(entries, Mapping) or not entries:
        raise ValueError("domains must be a mapping with entries")

    def one(name: str, entry: Mapping, *options: str):
        given = [k for k in options if k in entry]
        if len(given) != 1:
            raise ValueError(f"domain {name}: exactly one of {', '.join(options)}")
        return entry[given[0]]

    found = {}
    for name, entry in entries.items():
        corner = one(name, entry, "upper_left_xy_m", "upper_left_lonlat")
        if len(corner) != 2 or not str(entry.get("crs", "")).strip():
            raise ValueError(f"domain {name}: a corner of two values and a crs are required")
        whole = {k: entry.get(k) for k in ("version", "nx", "ny", "cycle_s", "sat_cadence_s")}
        if any(not isinstance(v, int) for v in whole.values()):
            raise ValueError(f"domain {name}: {', '.join(whole)} must be integers")
        found[str(name)] = Domain(name=str(name), crs=str(entry["crs"]).strip(), spacing=float(one(name, entry, "dx_m", "dx_deg")), west=float(corner[0]), north=float(corner[1]), **whole)
    return found


def regrid_channels(cells: DataFrame, shape: tuple[int, int], target: tuple[int, int], channels: Mapping[str, Channel], keys: Sequence[str] = (), fill: float = float("nan")) -> DataFrame:
    """Cells (keys, channel, row, col, value, perhaps valid) on the target grid, each channel by its own policy.

    Cells are read once: the channel says which of the reducers its windows go through. Only channels that are interpolated, and
    have no mask, take a second path. A channel that the catalogue lacks raises.
    """
    names = {n: POLICIES.get(c.resampling.lower().replace("_", "-")) for n, c in channels.items()}
    if unsupported := sorted(channels[n].resampling for n, p in names.items() if p is None):
        raise ValueError(f"unsupported resampling policy: {', '.join(unsupported)}")
    smooth = [n for n, p in names.items() if p == "bilinear"] if "valid" not in cells.columns else []
    reducers = {n: "mean" if p == "bilinear" else p for n, p in names.items() if n not in smooth}
    known = F.when(F.col("channel").isin(*channels), F.col("channel")).otherwise(F.raise_error(F.concat(F.lit("unknown channel: "), F.coalesce("channel", F.lit("null")))).cast("string"))
    rows, by = cells.withColumn("channel", known), [*keys, "channel"]
    out = regrid_by(rows.where(F.col("channel").isin(*reducers)), shape, target, reducers, by, fill) if reducers else None
    if smooth:
        part = bilinear(rows.where(F.col("channel").isin(*smooth)), shape, target, by, fill)
        out = part if out is None else out.unionByName(part)
    return out
