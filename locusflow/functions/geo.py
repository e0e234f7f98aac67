"""Distances, grid cells, boxes and geohashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null when a coordinate is."""
    up, over = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(up), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(over), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres, for near points."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_KM * 1000 * F.hypot(x, F.radians(lat2 - lat1))


def cell(x: Column, size: float) -> Column:
    """The grid cell that holds a coordinate."""
    return F.floor(x / F.lit(float(size)))


def cell_towards_zero(x: Column, size: float) -> Column:
    """The grid cell by truncation: cells on both sides of zero share number 0."""
    return (x / F.lit(float(size))).cast("long")


def neighbours(i: Column, j: Column) -> Column:
    """The 3 x 3 cells about a cell, in row order, with their place: array of (ord, i, j)."""
    steps = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    return F.array(*(F.struct(F.lit(n).alias("ord"), (i + di).alias("i"), (j + dj).alias("j")) for n, (di, dj) in enumerate(steps)))


def _cell_width(i: Column, size: float) -> Column:
    """Degrees of longitude of a cell in a row of the grid: nowhere in it or the rows beside it narrower than its height; 360 near the poles."""
    edge = F.greatest(F.abs(i), F.abs(i + 1)) * size + size  # towards the pole, with the next row
    wide = F.lit(size) / F.cos(F.radians(F.least(edge, F.lit(89.0))))
    return F.when((edge < 89.0) & (wide < 30), wide).otherwise(360.0)


def _columns(lon: Column, i: Column, size: float, reach: Column | float) -> tuple[Column, Column]:
    """The numbers of the cells of a row about a longitude less, and more, by the part `reach` of a cell."""
    wide = _cell_width(i, size)
    n = F.floor(360.0 / wide)  # cells of a row, each at least that wide
    at = (lon + 180.0) / 360.0 * n
    over = wide / 360.0 * n * reach
    number = lambda x: F.shiftleft(i.cast("bigint"), 32) + F.pmod(F.floor(x), n)
    return number(at - over), number(at + over)


def _near_size(km: float) -> float:
    """Degrees of a cell of the grid for a distance: twice as far, so that what is near lies in two rows and two columns."""
    return 2 * km / 110.0


def near_cell(lat: Column, lon: Column, km: float) -> Column:
    """The number of the cell of a grid whose columns widen towards the poles and close at the date line."""
    size = _near_size(km)
    return _columns(lon, cell(lat, size), size, F.lit(0.0))[0]


def near_cells(lat: Column, lon: Column, km: float) -> Column:
    """All cells of `near_cell` that can hold a point within km: at most four, each once.

    The distance reaches half a cell, so from where the point lies in its own only two rows, and in each two columns, are met.
    """
    size = _near_size(km)
    out = []
    for step in (-size / 2, size / 2):
        out += _columns(lon, cell(lat + step, size), size, F.lit(0.5))
    return F.array_distinct(F.array(*out))


def box(lat: Column, lon: Column, at_lat: float, at_lon: float, km: float) -> Column:
    """The degree box about a point that holds its circle; plain comparisons reach the scan."""
    from math import cos, radians

    up = km / 110.0
    over = up / max(0.2, cos(radians(at_lat)))
    return lat.between(at_lat - up, at_lat + up) & lon.between(at_lon - over, at_lon + over)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def coarse(x: Column, when: Column, places: int = 2) -> Column:
    """A coordinate rounded where `when` holds, as it is elsewhere."""
    return F.when(when, F.round(x, places)).otherwise(x)


def geohash(lat: Column, lon: Column, length: int = 6) -> Column:
    """Geohash of up to 12 characters; +90 and +180 fall into the last cell."""
    bits = 5 * length
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * (1 << n_lon)).cast("long"), F.lit((1 << n_lon) - 1))
    y = F.least(F.floor((lat + 90.0) / 180.0 * (1 << n_lat)).cast("long"), F.lit((1 << n_lat) - 1))
    chars = []
    for c in range(length):
        code = F.lit(0)
        for b in range(5 * c, 5 * c + 5):  # bits alternate, longitude first
            source, left = (x, n_lon - 1 - b // 2) if b % 2 == 0 else (y, n_lat - 1 - b // 2)
            code = code * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1))
        chars.append(F.substring(F.lit(BASE32), code.cast("int") + 1, F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*chars))
