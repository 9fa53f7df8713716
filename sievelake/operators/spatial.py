"""Points in or near regions, by cell ranges on a space-filling curve.

A region (a disc or a polygon) is covered by cells of a quadtree; each cell is
one range of Z-order codes. Points meet ranges through an equi-join on a code
prefix, with the range as a further condition, and are then tested exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.geo import BITS, EARTH_KM, haversine_km, valid_point, z_code
from sievelake.operators.salted import heavy_hashes
from sievelake.staging import stage

#: Levels at which ranges are joined; a range of level l joins at the largest of these not above l.
JOIN_LEVELS = (0, 4, 8, 11)
#: Cells of a cover; refining stops there or at MAX_LEVEL. Bounds the cover, not the result.
COVER_CELLS, MAX_LEVEL = 96, 16
#: Bytes of ranges that may be broadcast, counted before: 120 for a range and 32 for each edge it carries. More are joined by shuffle with salted hot cells.
BROADCAST_BYTES, RANGE_BYTES, EDGE_BYTES = 64 << 20, 120, 32
SALTS = 16


def _interleave(row: int, col: int) -> int:
    return int(f"{row:b}", 4) * 2 + int(f"{col:b}", 4)  # binary digits read in base four leave a zero bit between


def unwrap(lon: np.ndarray) -> np.ndarray:
    """Longitudes of a ring as a continuous line: each step goes the short way round."""
    step = np.diff(lon)
    return lon[0] + np.concatenate([[0.0], np.cumsum(step - 360.0 * np.round(step / 360.0))])


def ring_edges(lat, lon) -> np.ndarray | None:
    """Edges (y1, x1, y2, x2) of a closed ring with unwrapped longitudes; None for what bounds no area.

    None: null or unequal arrays, NaN, fewer than three vertices, or a ring around a pole.
    """
    if lat is None or lon is None or len(lat) != len(lon) or len(lat) < 3:
        return None
    y, x = np.asarray(lat, float), np.asarray(lon, float)
    if not (np.isfinite(y).all() and np.isfinite(x).all()):
        return None
    if y[0] != y[-1] or (x[0] - x[-1]) % 360.0:
        y, x = np.append(y, y[0]), np.append(x, x[0])
    x = unwrap(x)
    if abs(x[-1] - x[0]) > 1e-6 or len(y) < 4:
        return None
    return np.column_stack([y[:-1], x[:-1], y[1:], x[1:]])


def _inside(edges: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Even-odd test of many points."""
    y1, x1, y2, x2 = edges.T
    lat, lon = lat[:, None], lon[:, None]
    up = (y1 > lat) != (y2 > lat)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (up & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)).sum(1) % 2 == 1


def _touches(edges: np.ndarray, south: np.ndarray, west: np.ndarray, h: float, w: float) -> np.ndarray:
    """Whether an edge meets the closed box (separating axes of segment and box), for many boxes of one size."""
    y1, x1, y2, x2 = edges.T
    my, mx = (y1 + y2) / 2 - (south + h / 2)[:, None], (x1 + x2) / 2 - (west + w / 2)[:, None]
    hy, hx, dy, dx = h / 2 + 1e-9, w / 2 + 1e-9, np.abs(y2 - y1) / 2, np.abs(x2 - x1) / 2  # enlarged: a point on the border must not escape by rounding
    apart = (np.abs(my) > hy + dy) | (np.abs(mx) > hx + dx)
    apart |= np.abs((x2 - x1) / 2 * my - (y2 - y1) / 2 * mx) > hy * dx + hx * dy + 1e-12
    return (~apart).any(1)


def cover_cells(boxes: list[tuple[float, float, float, float]], edges: np.ndarray | None) -> list[tuple[int, int, int, bool]]:
    """(level, row, col, inside) of disjoint cells that cover all boxes (south, west, north, east).

    With ``edges`` a cell is kept only if an edge meets it or it lies inside; inside: no exact test is needed.
    A level at a time, cells are divided until COVER_CELLS or MAX_LEVEL is reached.
    """
    shifts = [] if edges is None else [k for k in (-360.0, 0.0, 360.0) if edges[:, 1].min() <= 180 + k and edges[:, 1].max() >= k - 180]
    row, col, done = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    for level in range(MAX_LEVEL + 1):
        h, w = 180.0 / (1 << level), 360.0 / (1 << level)
        south, west = row * h - 90.0, col * w - 180.0
        kept = np.zeros(len(row), bool)
        for s, a, n, b in boxes:
            kept |= (south <= n) & (south + h >= s) & (west <= b) & (west + w >= a)
        row, col, south, west = row[kept], col[kept], south[kept], west[kept]
        if edges is not None:
            edge, full = np.zeros(len(row), bool), np.zeros(len(row), bool)
            for k in shifts:  # the ring's line may leave the window of the cells
                edge |= _touches(edges, south, west + k, h, w)
                full |= _inside(edges, south + h / 2, west + k + w / 2)
            full &= ~edge
            done += [(level, int(r), int(c), True) for r, c in zip(row[full], col[full])]
            row, col = row[edge], col[edge]
        if level == MAX_LEVEL or not len(row) or 2 * len(row) + len(done) > COVER_CELLS:
            break
        row, col = (2 * row[:, None] + [0, 0, 1, 1]).ravel(), (2 * col[:, None] + [0, 1, 0, 1]).ravel()
    return done + [(level, int(r), int(c), False) for r, c in zip(row, col)]


def disc_boxes(lat: float, lon: float, km: float) -> list[tuple[float, float, float, float]]:
    """Boxes around a disc, cut at the 180th meridian; slightly enlarged against rounding."""
    turn = km / EARTH_KM * (1 + 1e-9) + 1e-12
    d = math.degrees(turn)
    south, north = lat - d, lat + d
    if north >= 90 or south <= -90 or turn >= math.pi / 2:
        return [(max(south, -90.0), -180.0, min(north, 90.0), 180.0)]
    half = math.degrees(math.asin(min(1.0, math.sin(turn) / math.cos(math.radians(lat))))) + 1e-9
    return _split(south, lon - half, north, lon + half)


def _split(south: float, west: float, north: float, east: float) -> list[tuple[float, float, float, float]]:
    if east - west >= 360:
        return [(south, -180.0, north, 180.0)]
    return [(south, max(-180.0, west + k), north, min(180.0, east + k)) for k in (-360.0, 0.0, 360.0) if west + k <= 180 and east + k >= -180]


_RANGES = "place long, join_level int, prefix long, lo long, hi long, is_inside boolean, disc_lat double, disc_lon double, disc_km double, west double, east double, edges array<struct<y1:double,x1:double,y2:double,x2:double>>"


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            edges = None
            disc = pd.notna(r.disc_lat) and pd.notna(r.disc_lon) and pd.notna(r.disc_km)
            if disc:
                if not (abs(r.disc_lat) <= 90 and abs(r.disc_lon) <= 180 and r.disc_km >= 0):
                    continue
                boxes = disc_boxes(r.disc_lat, r.disc_lon, r.disc_km)
            else:
                edges = ring_edges(r.ring_lat, r.ring_lon)
                if edges is None:
                    continue
                boxes = _split(edges[:, 0].min(), edges[:, 1].min(), edges[:, 0].max(), edges[:, 1].max())
            west, east = (None, None) if edges is None else (float(edges[:, 1].min()), float(edges[:, 1].max()))
            for level, row, col, full in cover_cells(boxes, edges):
                join = max(x for x in JOIN_LEVELS if x <= level)
                # an edge outside a cell's latitudes crosses the parallel of no point in it
                band = None if edges is None or full else [tuple(map(float, e)) for e in _in_band(edges, row, level)]
                lo = _interleave(row << (BITS - level), col << (BITS - level))
                hi = lo + (1 << 2 * (BITS - level)) - 1
                out.append((r.place, join, lo >> 2 * (BITS - join), lo, hi, full, *((r.disc_lat, r.disc_lon, r.disc_km) if disc else (None,) * 3), west, east, band))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _RANGES.split(", ")])


def _in_band(edges: np.ndarray, row: int, level: int) -> np.ndarray:
    h = 180.0 / (1 << level)
    south, north = row * h - 90.0 - 1e-9, (row + 1) * h - 90.0 + 1e-9
    return edges[(np.minimum(edges[:, 0], edges[:, 2]) <= north) & (np.maximum(edges[:, 0], edges[:, 2]) >= south)]


def cover_ranges(regions: DataFrame) -> DataFrame:
    """Code ranges of regions (place, disc_lat, disc_lon, disc_km, ring_lat, ring_lon), computed where the regions are."""
    return regions.mapInPandas(_ranges, _RANGES)


def _in_ring(lat: Column, lon: Column) -> Column:
    x = F.when(lon < F.col("west"), lon + 360.0).when(lon > F.col("east"), lon - 360.0).otherwise(lon)

    def crossed(n: Column, e: Column) -> Column:
        hit = ((e["y1"] > lat) != (e["y2"] > lat)) & (x < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
        return n + F.when(hit, 1).otherwise(0)

    return F.aggregate("edges", F.lit(0), crossed) % 2 == 1


def points_in_regions(points: DataFrame, lat: str, lon: str, regions: DataFrame, *, place: str = "place_id") -> DataFrame:
    """``points`` with the column ``place``, one row per region that holds the point.

    ``regions`` has place (bigint) and either disc_lat, disc_lon, disc_km or ring_lat, ring_lon. In a disc:
    great-circle distance at most disc_km. In a ring: even-odd rule in the latitude-longitude plane, edges the short
    way round. Points with null, NaN or out-of-range coordinates, and regions without a usable shape, meet nothing. Repeated
    points each keep their rows. All columns of ``points`` are kept; ``place`` may not be one of them.

    Cover ranges carry the edges in their latitudes and are broadcast up to BROADCAST_BYTES (counted first); beyond, the join shuffles on the
    prefix, and prefixes that hold many points are salted, with their ranges repeated once per salt.
    """
    if place in points.columns:
        raise ValueError(f"points already have a column {place}")
    ranges = stage(cover_ranges(regions), "cover")
    n_edges = F.sum(F.greatest(F.size("edges"), F.lit(0)))
    found = ranges.groupBy("join_level").agg((F.count(F.lit(1)) * RANGE_BYTES + n_edges * EDGE_BYTES).alias("bytes")).collect()  # at most one row per join level
    levels, total = sorted(r["join_level"] for r in found), sum(r["bytes"] for r in found)
    kept = points.where(valid_point(F.col(lat), F.col(lon)))
    coded = kept.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("p"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    coded = coded.withColumn("code", z_code(F.col("y"), F.col("x"))).withColumn("join_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.expr("cast(array() as array<int>)")))
    shift = F.lit(2 * BITS) - 2 * F.col("join_level")
    coded = coded.withColumn("prefix", F.expr("shiftright(code, %d - 2 * join_level)" % (2 * BITS)) if levels else shift.cast("long"))
    on = ["join_level", "prefix"]
    if total <= BROADCAST_BYTES:
        ranges = F.broadcast(ranges)
    else:
        hot = heavy_hashes(coded, on, 0.005)
        is_hot = F.xxhash64(*on).isin(hot) if hot else F.lit(False)
        coded = coded.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        ranges = ranges.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on.append("salt")
    y, x = F.col("y"), F.col("x")
    exact = F.when(F.col("is_inside"), F.lit(True)).when(F.col("disc_km").isNotNull(), haversine_km(y, x, F.col("disc_lat"), F.col("disc_lon")) <= F.col("disc_km")).otherwise(_in_ring(y, x))
    return coded.join(ranges, on).where(F.col("code").between(F.col("lo"), F.col("hi"))).where(exact).select("p.*", F.col("place").alias(place))
