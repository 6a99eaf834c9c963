"""What a source's address says about its payload, and requests as addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File marks of the satellites, and the channel that each radar product fills.
SATELLITES = {"3RIMG": "INSAT-3DR", "3SIMG": "INSAT-3DS", "3DIMG": "INSAT-3D"}
RADAR_CHANNELS = {"caz": "zmax", "ppz": "z_cappi1_proxy", "ppv": "vr_lowest", "sri": "sri", "pac": "pac", "vp2": "vp2"}
VELOCITY_PRODUCT = "ppv"
#: Fixed value: besides the satellites' marks, what a product's name may follow.
PRODUCT_MARK = "PROD"


def satellite_of(url: Column) -> Column:
    """Satellite by its file mark anywhere in the address, INSAT-UNKNOWN without one; a null address gives that as well."""
    upper = F.upper(url)
    marks = [F.when(upper.contains(mark), name) for mark, name in SATELLITES.items()]
    return F.coalesce(*marks, F.lit("INSAT-UNKNOWN"))


def product_of(url: Column) -> Column:
    """Product after the first file mark and its date, UNKNOWN without one.

    What follows the mark is read from its first letter or digit on; eight digits there are a date and are passed over, unless
    nothing comes after them. The product is the run of letters and digits that begins there.
    """
    upper = F.upper(url)
    places = [F.struct(F.nullif(F.instr(upper, m), F.lit(0)).alias("at"), F.lit(len(m)).alias("size")) for m in (*SATELLITES, PRODUCT_MARK)]
    first = F.array_min(F.filter(F.array(*places), lambda p: p["at"].isNotNull()))
    bare = lambda text: F.regexp_replace(text, "^[^A-Z0-9]+", "")
    tail = bare(F.substr(upper, first["at"] + first["size"]))
    beyond = bare(F.substr(tail, F.lit(9)))
    dated = F.substr(tail, F.lit(1), F.lit(8)).rlike("^[0-9]{8}$") & beyond.rlike("^[A-Z0-9]")
    found = F.regexp_extract(F.when(dated, beyond).otherwise(tail), "^[A-Z0-9]+", 0)
    return F.when(F.coalesce(found, F.lit("")) == "", "UNKNOWN").otherwise(found)


def radar_requests(stations: DataFrame, endpoint: str, products: Sequence[str] = tuple(RADAR_CHANNELS)) -> DataFrame:
    """(station, product, url, channel, has_velocity): every station with every product; ``endpoint`` names {station} and
    {product}. A product without a channel raises before anything runs."""
    unknown = sorted(set(products) - set(RADAR_CHANNELS))
    if unknown:
        raise ValueError(f"products without a channel: {', '.join(unknown)}")
    rows = stations.select("station", F.explode(F.array(*[F.struct(F.lit(p).alias("product"), F.lit(RADAR_CHANNELS[p]).alias("channel")) for p in products])).alias("x"))
    url = F.replace(F.replace(F.lit(endpoint), F.lit("{station}"), F.col("station")), F.lit("{product}"), F.col("x.product"))
    return rows.select("station", "x.product", url.alias("url"), "x.channel", (F.col("x.product") == VELOCITY_PRODUCT).alias("has_velocity"))


def encode_query(params: Column) -> Column:
    """A map of names to texts as a form-encoded query, sorted by name."""
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pair = lambda e: F.concat(coded(e["key"]), F.lit("="), coded(F.coalesce(e["value"].cast("string"), F.lit("None"))))
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), pair), "&")
