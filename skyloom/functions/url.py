"""Canonical URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.text import trimmed
from skyloom.lexicon import TRACKING_PARAMS


def _decoded(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), F.replace(s, F.lit("+"), F.lit(" ")))


def _encoded(s: Column) -> Column:
    """Java's encoding, with the two characters that form encoding elsewhere treats the other way."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_normalize(url: Column, tracking: tuple[str, ...] = TRACKING_PARAMS) -> Column:
    """https, lower-case host without user and port, path without slashes at its end, sorted parameters without tracking
    ones and those without a value, no fragment."""
    rest = F.regexp_replace(trimmed(F.coalesce(url, F.lit(""))), r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    body = F.regexp_extract(rest, r"^([^#]*)", 1)
    place, query = F.regexp_extract(body, r"^([^?]*)", 1), F.regexp_extract(body, r"^[^?]*\?(.*)$", 1)
    netloc = F.regexp_extract(F.regexp_extract(place, r"^//([^/]*)", 1), r"([^@]*)$", 1)
    host = F.lower(F.when(netloc.startswith("["), F.regexp_extract(netloc, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(netloc, r"^([^:]*)", 1)))
    path = F.regexp_replace(place, r"^//[^/]*", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when(F.char_length(path) > 1, F.regexp_replace(path, r"/+$", "")).otherwise(path)
    path = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.")),
        lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*tracking)) if tracking else pairs)
    tail = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(F.lit("https://"), host, path, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("?"), tail)))


def url_hash(url: Column) -> Column:
    return F.sha2(url_normalize(url), 256)
