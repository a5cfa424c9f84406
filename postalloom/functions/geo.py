"""Distances, spatial similarity, grid cells and coordinates in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def known(x: Column) -> Column:
    """NaN as null, so that a missing coordinate has one form."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, null if a coordinate is missing."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def approx_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance; a degree of longitude counts at least half a degree of latitude."""
    shrink = F.greatest(F.lit(0.5), F.cos(F.radians((lat1 + lat2) / 2)))
    return F.sqrt(F.pow((lat2 - lat1) * KM_PER_DEGREE, 2) + F.pow((lon2 - lon1) * KM_PER_DEGREE * shrink, 2))


def spatial_similarity(distance_km: Column, decay_km: float) -> Column:
    """Exponential decay with distance; 0 without one."""
    return F.coalesce(F.exp(-known(distance_km) / decay_km), F.lit(0.0))


def cell(degrees: Column, size: float) -> Column:
    """Grid cell by truncation towards zero, so cell 0 is twice as wide."""
    return (degrees / size).cast("bigint")


def offline_point(document: Column, faithful: bool = False) -> Column:
    """Struct (lat, lon) from ``{"offline_geocode": {"gcj02": "lon,lat", "wgs84": "lon,lat"}}``, null if there is none.

    gcj02 goes first. Clean mode turns to wgs84 where gcj02 is present but malformed; faithful mode doesn't.
    """

    def point(datum: str) -> Column:
        parts = F.split(F.get_json_object(document, f"$.offline_geocode.{datum}"), ",")
        lon, lat = (F.get(parts, i).try_cast("double") for i in (0, 1))
        return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))

    if faithful:
        return F.when(F.get_json_object(document, "$.offline_geocode.gcj02").isNotNull(), point("gcj02")).otherwise(point("wgs84"))
    return F.coalesce(point("gcj02"), point("wgs84"))


def first_pair(*points: Column) -> Column:
    """The first point with both coordinates, taken as a pair."""
    return F.coalesce(*[F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))) for p in points])


def coordinates_json(lat: Column, lon: Column) -> Column:
    """``[lat,lon]``, null unless both are known."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.to_json(F.array(lat, lon)))


def read_coordinates(document: Column) -> Column:
    """Struct (lat, lon) from ``[lat, lon]`` or ``{"latitude":…, "longitude":…}``; parts that don't parse are null."""
    pick = lambda a, b: F.coalesce(F.get_json_object(document, a), F.get_json_object(document, b)).try_cast("double")
    return F.struct(pick("$[0]", "$.latitude").alias("lat"), pick("$[1]", "$.longitude").alias("lon"))
