"""Catalogue, addresses and the target table: what must raise, and small cases by hand."""

import json
from urllib.parse import urlencode

import pytest
from pyspark.sql import functions as F

from fogline.operators import serving
from fogline.sources import adapters, catalogue, manifests

ENTRY = {"dtype": "int16", "scale": 100, "source": "s", "resampling": "max", "fill_value": -1}


def test_catalogue_reads_files_and_reports_all_faults(spark, tmp_path):
    path = tmp_path / "channels.json"
    path.write_text(json.dumps({"channel_version": 1, "channels": {"a": {"x": ENTRY}, "b": {"x": ENTRY, "y": ENTRY}}}))
    found = catalogue.channels_of(catalogue.read_config(spark, str(path)))
    assert list(found) == ["a/x", "b/x", "b/y"] and catalogue.channel(found, "x").group == "a" and catalogue.channel(found, "b/x").group == "b"
    with pytest.raises(KeyError, match="unknown channel"):
        catalogue.channel(found, "z")
    with pytest.raises(ValueError, match=r"channel_version.*a/x: lacks scale, fill_value"):
        catalogue.channels_of({"channel_version": 0, "channels": {"a": {"x": {"dtype": "f", "source": "s", "resampling": "max"}}}})


def test_domains_need_one_spacing_and_one_corner():
    entry = {"version": 1, "crs": "EPSG:4326", "nx": 2, "ny": 3, "cycle_s": 600, "sat_cadence_s": 900, "dx_deg": 0.5, "upper_left_lonlat": [70, 30]}
    d = catalogue.domains_of({"domains": {"d": entry}})["d"]
    assert (d.nx, d.ny, d.spacing, d.west, d.north) == (2, 3, 0.5, 70.0, 30.0)
    for bad in ({**entry, "dx_m": 1}, {k: v for k, v in entry.items() if k != "dx_deg"}, {**entry, "upper_left_lonlat": [1]}, {**entry, "nx": "2"}, {**entry, "ny": 0}, {**entry, "crs": " "}):
        with pytest.raises(ValueError, match="domain d"):
            catalogue.domains_of({"domains": {"d": bad}})


def test_a_channel_outside_the_catalogue_raises(spark):
    cells = spark.createDataFrame([("a/x", 0, 0, 1.0), ("other", 0, 0, 2.0)], "channel string, row int, col int, value double")
    found = catalogue.channels_of({"channel_version": 1, "channels": {"a": {"x": ENTRY}}})
    with pytest.raises(Exception, match="unknown channel: other"):
        catalogue.regrid_channels(cells, (1, 1), (1, 1), found).collect()


def test_queries_are_encoded_as_forms(spark):
    cases = [{"b": "1 2", "a": "x/y?&=+"}, {"k": "~-_.*é\n", "K": ""}, {}]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p map<string, string>").select("i", adapters.encode_query(F.col("p")).alias("q")).orderBy("i").collect()
    assert [r.q for r in rows] == [urlencode(sorted(c.items())) for c in cases]


def test_radar_requests_refuse_unknown_products(spark):
    stations = spark.createDataFrame([("s1",)], "station string")
    row = adapters.radar_requests(stations, "u/{station}/{product}", ["ppv"]).first()
    assert (row.url, row.channel, row.has_velocity) == ("u/s1/ppv", "vr_lowest", True)
    with pytest.raises(ValueError, match="zzz"):
        adapters.radar_requests(stations, "u", ["zzz"])


def _table(spark, *ids, default=False):
    return serving.read_targets(spark.createDataFrame([(i, "site", i, 1.0, 2.0, default) for i in ids], "target_id string, kind string, name string, latitude double, longitude double, is_default boolean"))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda s: serving.add_targets(_table(s, "a"), _table(s, "a")), "target exists: a"),
        (lambda s: serving.add_targets(_table(s, "a"), _table(s, "b", "b")), "target exists: b"),
        (lambda s: serving.replace_targets(_table(s, "a"), _table(s, "b")), "no such target: b"),
        (lambda s: serving.replace_targets(_table(s, "a"), _table(s, "a", "a")), "target changed twice: a"),
        (lambda s: serving.delete_targets(_table(s, "a"), s.createDataFrame([("b",)], "target_id string")), "no such target: b"),
        (lambda s: serving.delete_targets(_table(s, "a", default=True), s.createDataFrame([("a",)], "target_id string")), "default targets stay: a"),
        (lambda s: serving.resolve_targets(s.createDataFrame([("b",), (None,)], "target_id string"), _table(s, "a")), "unknown target"),
        (lambda s: _table(s, None), "target fields are missing"),
    ],
)
def test_targets_refuse(spark, change, message):
    with pytest.raises(Exception, match=message):
        change(spark).collect()


def test_an_issue_needs_domain_and_time(spark):
    with pytest.raises(ValueError, match="required"):
        serving.of_issue(_table(spark, "a"), "", "2024-01-01")


SPEC = {"name": "sat", "class": "open", "cadence_s": "900", "expected_latency_s": 300, "endpoint": "https://x", "parser": "p", "obs_time_rule": "url", "products": ["a"], "retention_days": None}


def test_specs_come_from_yaml_and_json_with_unknown_keys_as_settings(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(SPEC))
    (tmp_path / "a.json").write_text(json.dumps(SPEC | {"name": "radar", "auth": "key", "status": "live"}))
    (tmp_path / "notes.txt").write_text("not a spec")
    found = manifests.load_specs(spark, str(tmp_path))
    assert list(found) == ["radar", "sat"]
    assert (found["sat"].access_class, found["sat"].cadence_s, found["sat"].auth, found["sat"].retention_days, found["sat"].status) == ("open", 900, "none", None, "not-started")
    assert found["sat"].settings == {"products": ["a"]} and found["radar"].auth == "key"
    assert manifests.specs_table(spark, found).count() == 2
    (tmp_path / "c.yml").write_text(yaml.safe_dump(SPEC))
    with pytest.raises(ValueError, match="duplicate source: sat"):
        manifests.load_specs(spark, str(tmp_path))
    with pytest.raises(ValueError, match="x.yaml: cadence_s, parser"):
        manifests.SourceSpec.of({k: v for k, v in (SPEC | {"cadence_s": "often"}).items() if k != "parser"}, "x.yaml")


def test_products_in_addresses(spark):
    want = {
        "http://x/3RIMG_20240101_IR1.jpg": "IR1", "3dimg20240101ab": "AB", "3SIMG_20240101": "20240101", "3simg__": "UNKNOWN", "prod/x": "X", "a/products/3rimg_1": "UCTS",
        "no mark": "UNKNOWN", "": "UNKNOWN", "3RIMG-1234567-ab": "1234567", "3RIMG20240101__WV": "WV", None: "UNKNOWN",
    }
    got = {r.url: r.p for r in spark.createDataFrame([(u,) for u in want], "url string").select("url", adapters.product_of(F.col("url")).alias("p")).collect()}
    assert got == want


def test_channels_are_regridded_in_one_scan_each_by_its_policy(spark):
    channels = catalogue.channels_of({"channel_version": 1, "channels": {"g": {n: ENTRY | {"resampling": p} for n, p in (("a", "max"), ("b", "sum"), ("c", "nearest"), ("d", "bilinear"))}}})
    rows = [(f"g/{n}", r, c, float(r * 4 + c)) for n in "abcd" for r in range(4) for c in range(4)]
    cells = spark.createDataFrame(rows, "channel string, row int, col int, value double")
    got = {(r.channel, r.row, r.col): r.value for r in catalogue.regrid_channels(cells, (4, 4), (2, 2), channels).collect()}
    assert [got[f"g/{n}", 1, 1] for n in "abcd"] == [15.0, 50.0, 10.0, 15.0] and len(got) == 16
    masked = {(r.channel, r.row, r.col): r.value for r in catalogue.regrid_channels(cells.withColumn("valid", F.col("col") > 0), (4, 4), (2, 2), channels, fill=-1.0).collect()}
    assert [masked[f"g/{n}", 0, 0] for n in "abcd"] == [5.0, 6.0, 1.0, 3.0]
    with pytest.raises(Exception, match="unknown channel: x"):
        catalogue.regrid_channels(cells.withColumn("channel", F.lit("x")), (4, 4), (2, 2), channels).collect()
