"""Positions, distances and names of directions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
#: Sixteen winds, clockwise from north.
WINDS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def direction(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a position in degrees, y-up."""
    lo, la = F.radians(lon), F.radians(lat)
    return F.cos(la) * F.cos(lo), F.sin(la), F.cos(la) * F.sin(lo)


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 to 360 clockwise from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(deg + 360, F.lit(360.0))


def wind(bearing: Column) -> Column:
    """Name of the wind nearest to a bearing."""
    return F.element_at(F.array(*map(F.lit, WINDS)), (F.floor((bearing + 11.25) / 22.5) % 16 + 1).cast("int"))


def stable_id(namespace: Column, kind: Column, key: Column) -> Column:
    """kind, a colon and 16 hex digits that depend on nothing but the three parts."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", namespace, kind, key)), 1, 16))


def river_width_m(accum_m2: Column) -> Column:
    """Width of a channel by the area it drains."""
    return 7 * F.sqrt(accum_m2 * 0.5 / 3.15e7)
