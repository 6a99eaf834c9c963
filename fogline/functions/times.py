"""Timestamps in the forms that public sources use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts tried after ISO 8601, in this order.
LAYOUTS = ("ddMMMyyyy HHmm", "ddMMMyyyyHHmm", "yyyyMMddHHmm", "yyyyMMdd_HHmm", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda every mention of an expression is computed anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _as_is(value: Column, use: Callable[[Column], Column]) -> Column:
    return use(value)


def _zoned(text: Column, bind: Callable = _as_is) -> Column:
    """Zone names and Z as offsets."""
    named = lambda t: F.when(F.upper(t).endswith(" IST"), F.concat(F.trim(F.substring(t, F.lit(1), F.length(t) - 4)), F.lit("+05:30"))).when(
        F.upper(t).endswith(" UTC"), F.concat(F.trim(F.substring(t, F.lit(1), F.length(t) - 4)), F.lit("+00:00"))
    ).otherwise(t)
    signed = lambda t: F.when(t.endswith("Z"), F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("+00:00"))).otherwise(t)
    return F.regexp_replace(bind(bind(F.trim(text), named), signed), r"[+-]0000$", "+00:00")


def parse_timestamp(text: Column, bind: Callable = _as_is) -> Column:
    """Timestamp in UTC of a text, null if no form fits. Texts without a zone are UTC; plain numbers are epoch seconds.

    Month names are matched in any case. A zone may follow a layout as ``IST``, ``UTC``, ``Z`` or an offset. Inside a lambda,
    ``bind`` should be ``once``.
    """

    def by_layout(title: Column, bare: Column, zone: Column) -> Column:
        sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        digits = F.regexp_replace(zone, r"[^0-9]", "")
        shift = F.when(zone == "", 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
        found = F.coalesce(*[F.try_to_timestamp(F.when(F.length(title) == len(f.replace("'", "")), title), F.lit(f)) for f in LAYOUTS], *[F.try_to_timestamp(F.when((zone != "") & (F.length(bare) == len(f)), bare), F.lit(f)) for f in LAYOUTS])
        return bind(found, lambda x: F.timestamp_micros(F.unix_micros(x) - shift.cast("long") * 60_000_000))

    def of(t: Column) -> Column:
        iso = F.when(t.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")))
        title = F.regexp_replace(F.initcap(F.lower(F.regexp_replace(t, r"([A-Za-z]{3})", " $1 "))), r" ?([A-Z][a-z]{2}) ?", "$1")
        zone = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 0)
        moved = bind(title, lambda x: bind(F.regexp_replace(x, r"[+-]\d{2}:?\d{2}$", ""), lambda bare: bind(zone, lambda z: by_layout(x, bare, z))))
        epoch = F.when(t.rlike(r"^-?\d+\.\d+$|^-?\d{1,11}$"), F.timestamp_micros((t.try_cast("double") * 1_000_000).cast("long")))
        return F.coalesce(iso, moved, epoch)

    return bind(_zoned(text, bind), of)


_FOUND = (
    r"(?i)(20\d{2})[-/](\d{2})[-/](\d{2})[T _-](\d{2}):?(\d{2})(?::?(\d{2}))?(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})?",
    r"(?i)(20\d{2})(\d{2})(\d{2})[T _-]?(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{4})?",
)
_MONTH = r"(?i)(\d{2})([A-Z]{3})(20\d{2})[ T_-]?(\d{2})[:_-]?(\d{2})(?!:?\d{2})"


def find_timestamp(text: Column) -> Column:
    """First timestamp inside a text: ISO forms, then compact ones, then day-month-year; null if there is none."""
    tries = []
    for pattern in _FOUND:
        part = lambda i, p=pattern: F.regexp_extract(text, p, i)
        second = F.when(part(6) == "", F.lit("00")).otherwise(part(6))
        zone = F.when((part(7) == "") | (F.upper(part(7)) == "Z"), F.lit("+00:00")).otherwise(F.regexp_replace(part(7), r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
        iso = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), second, zone)
        tries.append(F.try_to_timestamp(F.when(part(1) != "", iso)))
    part = lambda i: F.regexp_extract(text, _MONTH, i)
    month = F.concat(part(1), F.initcap(F.lower(part(2))), part(3), F.lit(" "), part(4), part(5))
    tries.append(F.try_to_timestamp(F.when(part(1) != "", month), F.lit("ddMMMyyyy HHmm")))
    return F.coalesce(*tries)


def source_time(payload: Column, url: Column) -> tuple[Column, Column]:
    """Observation time and where it was found: the payload's text before the URL."""
    header, link = find_timestamp(F.decode(payload, "ISO-8859-1")), find_timestamp(url)
    return F.coalesce(header, link), F.when(header.isNotNull(), "header").when(link.isNotNull(), "url")


def iso_seconds(ts: Column) -> Column:
    """UTC text to the second, ending in Z."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def latest_cycle(now: Column, latency_s: int, every_hours: int = 6) -> Column:
    """Start of the newest model cycle that can have arrived."""
    known = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - latency_s * 1_000_000)
    return F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", known)) + F.floor(F.hour(known) / every_hours) * every_hours * 3600)
