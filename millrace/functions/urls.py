"""URLs, links and schedules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.html import anchors

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
SKIPPED = ("#", "javascript:", "mailto:", "tel:", "data:")


def canonical(url: Column) -> Column:
    """Without the fragment; scheme and host in lower case; path and query as they are."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def origin(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, _ORIGIN, 1), F.lit("://"), F.regexp_extract(url, _ORIGIN, 2))


def resolve(base: Column, href: Column) -> Column:
    """An href against the page it stands on; dot segments are left in place."""
    directory = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "[^/]*$", "")
    directory = F.when(F.regexp_replace(base, "[?#].*$", "").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(F.regexp_replace(base, "[?#].*$", ""), F.lit("/"))).otherwise(directory)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, _ORIGIN, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
        .otherwise(F.concat(directory, href))
    )


def links(html: Column, base: Column) -> Column:
    """Absolute http and https targets of a page, in order, repeated ones too."""
    real = F.filter(anchors(html), lambda h: (h != "") & ~_starts(h))
    return F.filter(F.transform(real, lambda h: resolve(base, h)), lambda u: F.lower(u).rlike("^https?:"))


def _starts(href: Column) -> Column:
    out = F.lit(False)
    for s in SKIPPED:
        out = out | href.startswith(s)
    return out


def poll_seconds(cron: Column) -> Column:
    """A coarse interval for a cron line: the minute step, else the hour step, else hourly, else daily. A step that is no number gives five minutes or an hour."""
    parts = F.split(F.trim(F.regexp_replace(cron, r"\s+", " ")), " ")
    minute, hour = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    every_minutes = F.substring(minute, 3, 99).try_cast("double")
    every_hours = F.substring(hour, 3, 99).try_cast("double")
    return (
        F.when(F.size(parts) < 2, 86400.0)
        .when(minute.startswith("*/"), F.when(every_minutes.isNull(), 300.0).otherwise(F.greatest(every_minutes, F.lit(1.0)) * 60))
        .when(hour.startswith("*/"), F.when(every_hours.isNull(), 3600.0).otherwise(F.greatest(every_hours, F.lit(1.0)) * 3600))
        .when((hour == "*") & minute.rlike("^[0-9]+$"), 3600.0)
        .otherwise(86400.0)
    )


def request_spacing(limit: str) -> float:
    """Seconds between requests for `<n>/<s|min>`."""
    m = re.fullmatch(r"([^/]*)/([^/]*)", limit if isinstance(limit, str) else "")
    per = {"s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "m": 60.0, "min": 60.0, "minute": 60.0, "minutes": 60.0}
    try:
        n = float(m[1]) if m else float("nan")
    except ValueError:
        n = float("nan")
    if n != n:
        raise ValueError(f"rate limit must look like '<n>/<s|min>', not {limit!r}")
    if n <= 0:
        raise ValueError("a rate limit must be positive")
    if m[2] not in per:
        raise ValueError(f"the unit of a rate limit must be 's' or 'min', not {m[2]!r}")
    return per[m[2]] / n


def http_time(header: Column) -> Column:
    """An HTTP date as a timestamp; malformed ones are null."""
    return F.try_to_timestamp(F.regexp_extract(header, r"(\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("dd MMM yyyy HH:mm:ss"))


def bare_etag(etag: Column) -> Column:
    return F.regexp_replace(etag, '^"+|"+$', "")


def repository(url: Column) -> Column:
    """The last part of a clone URL without `.git`."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1), r"\.git$", "")


def with_token(url: str, token: str | None) -> str:
    """For the driver only: such a URL must never be stored."""
    return re.sub(r"^(https?://)", rf"\1oauth2:{token}@", url) if token and re.match("https?://(?![^/]*@)", url) else url


def object_key(prefix: str, relative: Column) -> Column:
    head = prefix if not prefix or prefix.endswith("/") else prefix + "/"
    return F.concat(F.lit(head), relative)


def relative_key(prefix: str, key: Column) -> Column:
    """The key below the prefix; the prefix itself is the empty key; keys elsewhere stay."""
    if not prefix:
        return key
    head = prefix if prefix.endswith("/") else prefix + "/"
    return F.when(key.startswith(head), F.substring(key, len(head) + 1, 4096)).when(key == prefix, "").otherwise(key)
