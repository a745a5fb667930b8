"""Column functions: dates, bins, strings and small vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of a Julian year and of a day.
YEAR_US, DAY_US = 365.25 * 86_400e6, 86_400e6
#: Scale that makes a median absolute deviation comparable with a standard deviation.
NMAD = 1.4826


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def years_between(start: Column | str, end: Column | str) -> Column:
    """Julian years."""
    return micros_between(start, end) / F.lit(YEAR_US)


def days_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(DAY_US)


def in_range(c: Column | str, low, high) -> Column:
    """``low <= c < high``. A null is in no range."""
    c = F.col(c) if isinstance(c, str) else c
    return (c >= low) & (c < high)


def cut_right_closed(c: Column | str, first: float, last: float, width: float) -> Column:
    """Middle, as an integer, of the bin (a, a + width] that holds a value of (first, last]; null outside."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.ceil((c - first) / width)
    return F.when((c > first) & (c <= last), (F.lit(first) + (number - 0.5) * width).cast("int"))


def fixed_bin(c: Column | str, low: float, width: float) -> Column:
    """Number of the bin [low + k * width, low + (k + 1) * width)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor((c - low) / width).cast("long")


def decibels(c: Column | str) -> Column:
    """10 * log10; null unless positive."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, F.log10(c) * 10)


def normalised_difference(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b); null where the sum is zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a - b, a + b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length_of(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle_between(a: Column, b: Column) -> Column:
    """Angle of two vectors in radians; null if either has no length."""
    cosine = F.try_divide(dot(a, b), length_of(a) * length_of(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def half_even(c: Column) -> Column:
    """Nearest integer, a half going to the even one."""
    return F.rint(c).cast("long")


def utm_zone(lon: Column | str) -> Column:
    lon = F.col(lon) if isinstance(lon, str) else lon
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def site_dirname(number: Column | str, x: Column, y: Column) -> Column:
    """``id{n}_{x}x_{y}y`` with coordinates to the nearest integer, halves to even."""
    return F.format_string("id%d_%dx_%dy", number, half_even(x), half_even(y))


def sibling_urls(json_url: Column | str) -> dict[str, Column]:
    """Addresses of the raster and of its bit mask beside a metadata file."""
    json_url = F.col(json_url) if isinstance(json_url, str) else json_url
    raster = F.replace(json_url, F.lit(".json"), F.lit("_dem.tif"))
    return {"downloadurl": raster, "bitmaskurl": F.replace(raster, F.lit("_dem"), F.lit("_bitmask"))}


def split_label(c: Column | str, sep: str = "_") -> dict[str, Column]:
    """The first part and the second, with a capital, of a compound label."""
    return {"head": F.split_part(c, F.lit(sep), F.lit(1)), "tail": F.initcap(F.split_part(c, F.lit(sep), F.lit(2)))}


def hemisphere_label(lat: Column | str) -> Column:
    lat = F.col(lat) if isinstance(lat, str) else lat
    return F.when(lat > 0, "north").when(lat < 0, "south").otherwise("equator")


# polar stereographic projection (Snyder 1987), ellipsoid WGS 84
_A, _E = 6378137.0, 0.0818191908426215


def polar_stereographic(lon: Column, lat: Column, true_lat: float = 70.0, central_lon: float = -45.0) -> tuple[Column, Column]:
    """x and y in metres of points given in degrees, north polar aspect."""
    phi, lam, p1 = F.radians(lat), F.radians(lon - central_lon), math.radians(true_lat)

    def t_of(sin: Column, phi: Column) -> Column:
        return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - _E * sin) / (1 + _E * sin), F.lit(_E / 2))

    s1 = math.sin(p1)
    t1 = math.tan(math.pi / 4 - p1 / 2) / ((1 - _E * s1) / (1 + _E * s1)) ** (_E / 2)
    m1 = math.cos(p1) / math.sqrt(1 - (_E * s1) ** 2)
    rho = t_of(F.sin(phi), phi) * (_A * m1 / t1)
    return rho * F.sin(lam), -rho * F.cos(lam)


def polar_stereographic_inverse(x: Column, y: Column, true_lat: float = 70.0, central_lon: float = -45.0) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, by the series of the conformal latitude."""
    p1 = math.radians(true_lat)
    s1 = math.sin(p1)
    t1 = math.tan(math.pi / 4 - p1 / 2) / ((1 - _E * s1) / (1 + _E * s1)) ** (_E / 2)
    m1 = math.cos(p1) / math.sqrt(1 - (_E * s1) ** 2)
    t = F.hypot(x, y) * (t1 / (_A * m1))
    chi = math.pi / 2 - 2 * F.atan(t)
    e2 = _E * _E
    lat = chi + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12) * F.sin(2 * chi) + (7 * e2**2 / 48 + 29 * e2**3 / 240) * F.sin(4 * chi) + (7 * e2**3 / 120) * F.sin(6 * chi)
    return F.degrees(F.atan2(x, -y)) + central_lon, F.degrees(lat)
