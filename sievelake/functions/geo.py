"""Geographic column expressions: great-circle distance and Z-order cell codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is null. The square is clipped to [0, 1]."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0)
    )
    clipped = F.when(a.isNull(), a).otherwise(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))
    return F.lit(EARTH_KM * 2) * F.asin(F.sqrt(clipped))


#: Bits per axis of a full cell code. A cell is 360 / 2^20 by 180 / 2^20 degrees, about 38 by 19 m.
BITS = 20


def _spread(x: Column) -> Column:
    """A zero bit between all bits of a number below 2^32."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def z_code(lat: Column, lon: Column) -> Column:
    """Z-order code of a point's cell (latitude in the higher bit of each pair), as bigint."""
    n = 1 << BITS
    row = F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit(n - 1)).cast("long")
    col = F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit(n - 1)).cast("long")
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def valid_point(lat: Column, lon: Column) -> Column:
    """Neither null nor NaN, latitude within 90 and longitude within 180 degrees."""
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))
