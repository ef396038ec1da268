"""Distances and the India bounding box."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearwell import constants as K


def in_india(lat, lng) -> Column:
    return lat.between(*K.INDIA["lat"]) & lng.between(*K.INDIA["lng"])


def india_bbox_guard(lat, lng) -> tuple[Column, Column]:
    """Both coordinates, or NULL for both when the point lies outside India."""
    inside = in_india(lat, lng)
    return F.when(inside, lat), F.when(inside, lng)


def geo_confidence(lat, lng) -> Column:
    return F.when(in_india(lat, lng), "exact_spatial").otherwise("unresolved")


def distance_slc(lat1, lng1, lat2, lng2) -> Column:
    """Kilometres by the spherical law of cosines, clamped against rounding."""
    cos_angle = (F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
                 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1)))
    # greatest/least skip NULLs, so a missing coordinate must be guarded to stay NULL
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_angle))
    return F.when(cos_angle.isNotNull(), K.EARTH_KM * F.acos(clamped))


def distance_of_parts(sin1, cos1, lng1, sin2, cos2, lng2) -> Column:
    """:func:`distance_slc` of points of which none is missing, by the sines and cosines of their
    latitudes, which a join of many pairs works out once per point."""
    cos_angle = sin1 * sin2 + cos1 * cos2 * F.cos(F.radians(lng2 - lng1))
    return K.EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_angle)))


def distance_haversine(lat1, lng1, lat2, lng2) -> Column:
    """Kilometres by the haversine formula."""
    h = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)))
    return F.when(h.isNotNull(),
                  K.EARTH_KM * 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))
