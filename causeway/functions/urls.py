"""View state in addresses: reading parameters and writing shareable ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parameter(url: Column, key: str) -> Column:
    """The first value of a query key, null if it isn't there."""
    found = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{key}=([^&#]*)", 1)
    return F.when(url.rlike(rf"^[^?#]*\?(?:[^#]*&)?{key}="), found)


def number(url: Column, key: str) -> Column:
    return parameter(url, key).try_cast("bigint")


def id_list(url: Column, key: str) -> Column:
    """The integers of a comma-separated value, each once, in order; empty if there are none."""
    parts = F.transform(F.split(F.coalesce(parameter(url, key), F.lit("")), ","), lambda p: F.trim(p).try_cast("bigint"))
    return F.array_distinct(F.filter(parts, lambda p: p.isNotNull()))


def is_http(url: Column) -> Column:
    """Whether an address is http or https and names a host."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))


def share(base: Column, state: dict[str, Column]) -> Column:
    """base with the state's keys as its query, those with null left out; an older query and fragment go."""
    pairs = F.concat_ws("&", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in state.items()])
    bare = F.regexp_replace(base, r"[?#].*$", "")
    return F.when(pairs == "", bare).otherwise(F.concat(bare, F.lit("?"), pairs))
