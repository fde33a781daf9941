"""Scalar functions of other dialects as column expressions of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.dialects import json_changed


def similar_to_pattern(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as an anchored regular expression: % and _ become .* and . and dots are plain."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif c == "[":
            end = pattern.index("]", k)
            out.append(pattern[k : end + 1])
            k = end
        else:
            out.append({"%": "(?s:.*)", "_": "(?s:.)"}.get(c, c if c in "|*+?{}(),0123456789" else re.escape(c)))
        k += 1
    return f"^(?:{''.join(out)})$"


def similar_to(text: Column, pattern: str) -> Column:
    return text.rlike(similar_to_pattern(pattern))


def contains_all(whole: Column, part: Column) -> Column:
    """@> on arrays: every element of part is in whole."""
    return F.size(F.array_except(part, whole)) == 0


def json_contains(whole: Column, part: dict) -> Column:
    """@> on JSON objects: each path of part has an equal scalar in whole; nested objects are followed."""

    def walk(path: str, value) -> Column:
        if isinstance(value, dict):
            found = F.lit(True)
            for k, v in value.items():
                found = found & walk(f"{path}.{k}", v)
            return found
        wanted = str(value).lower() if isinstance(value, bool) else str(value)
        return F.coalesce(F.get_json_object(whole, path) == wanted, F.lit(False))

    return walk("$", part)


def json_has_key(json: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def json_has_all(json: Column, keys: list[str]) -> Column:
    """?& on JSON objects."""
    return F.coalesce(F.size(F.array_intersect(F.json_object_keys(json), F.array(*map(F.lit, keys)))) == len(set(keys)), F.lit(False))


def json_has_any(json: Column, keys: list[str]) -> Column:
    """?| on JSON objects."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(json), F.array(*map(F.lit, keys))), F.lit(False))


def json_path_exists(json: Column, path: str) -> Column:
    """@? on JSON: whether the path leads to a value, null values included."""
    return F.coalesce(F.variant_get(F.try_parse_json(json), path, "variant").isNotNull(), F.lit(False))


def json_without_path(name: str, path: list[str]) -> Column:
    """#- on a column of JSON objects: without the member at a path; other values keep their types and nesting."""
    return F.expr(json_changed(name, path, None, "remove"))


def age_months(later: Column, earlier: Column) -> Column:
    """Whole months between two dates, toward zero."""
    return F.months_between(later, earlier).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Whether a point lies in a polygon, an array of (x, y) structs: an odd number of edges to its right. Of a point on an
    edge only one of two polygons that share it says so; null coordinates give null, fewer than three corners false."""
    following = F.concat(F.slice(corners, 2, F.greatest(F.size(corners) - 1, F.lit(0))), F.slice(corners, 1, 1))

    def crosses(a: Column, b: Column) -> Column:
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0)) + a["x"])

    crossed = F.filter(F.zip_with(corners, following, crosses), lambda c: c)
    return F.when(x.isNotNull() & y.isNotNull(), (F.size(crossed) % 2 == 1) & (F.size(corners) > 2))


def range_of(lo: Column, hi: Column, lo_in: bool = True, hi_in: bool = False) -> Column:
    """A range value; a null end is open."""
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(lo_in).alias("lo_in"), F.lit(hi_in).alias("hi_in"))


def range_contains(r: Column, value: Column) -> Column:
    above = r["lo"].isNull() | (value > r["lo"]) | (r["lo_in"] & (value == r["lo"]))
    below = r["hi"].isNull() | (value < r["hi"]) | (r["hi_in"] & (value == r["hi"]))
    return above & below


def ranges_overlap(a: Column, b: Column) -> Column:
    """&& on ranges: neither ends before the other begins."""

    def before(x: Column, y: Column) -> Column:
        return F.coalesce((x["hi"] < y["lo"]) | ((x["hi"] == y["lo"]) & ~(x["hi_in"] & y["lo_in"])), F.lit(False))

    return ~before(a, b) & ~before(b, a)
