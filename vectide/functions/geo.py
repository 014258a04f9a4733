"""Geographic functions on degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the Earth's radius in metres.
EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance along the sphere in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def parse_point(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of "lat,lon"; null where the text is no such pair."""
    part = lambda i: F.try_element_at(F.split(text, ","), F.lit(i)).try_cast("double")
    return part(1), part(2)


def within_radius(lat: Column, lon: Column, centre: tuple[float, float], metres: float) -> Column:
    """False where the place is unknown."""
    return F.coalesce(haversine_m(F.lit(centre[0]), F.lit(centre[1]), lat, lon) <= metres, F.lit(False))


def within_box(lat: Column, lon: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Edges included; false where the place is unknown."""
    return F.coalesce(lat.between(low[0], high[0]) & lon.between(low[1], high[1]), F.lit(False))


def intersects(text: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether a location given as text lies in an area; false for what is no location."""
    return within_box(*parse_point(text), low, high)


def all_of(text: Column, conditions: Sequence[tuple]) -> Column:
    """Whether a location given as text meets every condition: ("radius", centre, metres), ("box" or "intersects", low,
    high). No conditions: true; what is no location meets none."""
    lat, lon = parse_point(text)
    out = F.lit(True)
    for kind, a, b in conditions:
        out = out & (within_radius(lat, lon, a, b) if kind == "radius" else within_box(lat, lon, a, b))
    return out
