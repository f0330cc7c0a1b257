"""Saved settings laid over defaults, and the ranges that requests must keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The settings of the graph's view and what they are unless saved otherwise.
DEFAULTS = {
    "clusterSizeMode": "no",
    "linkSizeMode": "size",
    "showEdgeLabels": "false",
    "showMemberCount": "false",
    "dimOnSelection": "true",
    "highlightOnHover": "false",
    "nodeSpacing": "normal",
    "layoutAlgorithm": "fcose",
    "animationSpeed": "normal",
    "showArrows": "true",
    "showLegend": "true",
    "showHighlightSpans": "true",
}


def overlay(saved: Column, defaults: dict[str, str] | None = None) -> Column:
    """A map of all settings by name: those of a saved JSON object, a null too, and the defaults of all others. What is no JSON object, or isn't there, leaves the defaults."""
    base = F.create_map(*[F.lit(x) for pair in (defaults or DEFAULTS).items() for x in pair])
    own = F.coalesce(F.from_json(saved, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def checked(level: int | None = None, min_post_count: int = 1, limit: int = 50, offset: int = 0, sort: str = "score") -> None:
    """ValueError where a request's parameter is out of its range: level 0 to 10, min_post_count 1 or more, limit 1 to 200, offset 0 or more, sort one of score, date and comments."""
    for name, value, low, high in (("level", level, 0, 10), ("min_post_count", min_post_count, 1, None), ("limit", limit, 1, 200), ("offset", offset, 0, None)):
        if value is not None and (value < low or high is not None and value > high):
            raise ValueError(f"{name} is {low} {f'to {high}' if high is not None else 'or more'}, not {value}")
    if sort not in ("score", "date", "comments"):
        raise ValueError(f"no sort {sort}")
