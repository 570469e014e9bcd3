"""Great-circle distance and positions on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Earth radius in km.
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_dlon), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def chord_km(arc_km: Column) -> Column:
    """Straight-line distance through the sphere for a distance along its surface."""
    return F.lit(2 * EARTH_KM) * F.sin(arc_km / F.lit(2 * EARTH_KM))


def cartesian_km(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Position in km from the Earth's centre; free of poles and of the date line."""
    phi, lam = F.radians(lat), F.radians(lon)
    return (
        F.lit(EARTH_KM) * F.cos(phi) * F.cos(lam),
        F.lit(EARTH_KM) * F.cos(phi) * F.sin(lam),
        F.lit(EARTH_KM) * F.sin(phi),
    )
