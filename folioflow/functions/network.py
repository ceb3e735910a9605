"""Column functions over outbound-call records: redaction, loopback, allowlist hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let, strip

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4_LOOP = rf"127(?:\.{_OCTET}){{3}}"
_ZERO_GROUPS = "(?:0{1,4}:)"
_SCOPE = r"(?:%[^%]+)?"
_IPV6_ONE_FULL = rf"{_ZERO_GROUPS}{{7}}0{{0,3}}1"
_IPV6_ONE_SHORT = rf"(?:0{{1,4}}(?::0{{1,4}}){{0,5}})?::{_ZERO_GROUPS}{{0,6}}0{{0,3}}1"
_MAPPED_PREFIX = rf"(?:(?:0{{1,4}}(?::0{{1,4}}){{0,3}})?::{_ZERO_GROUPS}{{0,4}}|{_ZERO_GROUPS}{{5}})ffff:"
_IPV6_MAPPED = rf"{_MAPPED_PREFIX}(?:{_IPV4_LOOP}|7f[0-9a-f]{{2}}:[0-9a-f]{{1,4}})"
_ADDRESS = rf"(?:{_IPV4_LOOP}|(?:{_IPV6_ONE_FULL}|{_IPV6_ONE_SHORT}|{_IPV6_MAPPED}){_SCOPE})"
_LOOPBACK = rf"\A(?:localhost|{_ADDRESS}|\[{_ADDRESS}\])\z"


def redact_path(path: Column) -> Column:
    """First path segment only; query and fragment never survive."""
    return F.concat(
        F.lit("/"), F.regexp_extract(F.coalesce(path, F.lit("")), r"\A/*([^/?#]*)", 1)
    )


def is_loopback(host: Column) -> Column:
    """Loopback by name or address literal; names are never resolved."""
    return F.coalesce(strip(F.lower(host)).rlike(_LOOPBACK), F.lit(False))


def allowlist_host(host: Column) -> Column:
    """``struct(host, reason)``: normalised host, or why the entry is refused."""

    def fields(h: Column) -> Column:
        reason = (
            F.when(h == "", "empty_host")
            .when(h.rlike("[ \t]"), "has_whitespace")
            .when(h.contains("://"), "has_scheme")
            .when(h.contains("/"), "has_path")
        )
        return F.struct(F.when(reason.isNull(), F.lower(h)).alias("host"), reason.alias("reason"))

    return let(strip(F.coalesce(host, F.lit(""))), fields)


def iso_seconds(ts: Column) -> Column:
    """UTC text with second precision, whatever the session time zone is."""
    utc = F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
