import math
import random

import pytest

from sievelake.operators import spatial
from sievelake.operators.spatial import points_in_regions, ring_edges

REGION = "place long, disc_lat double, disc_lon double, disc_km double, ring_lat array<double>, ring_lon array<double>"
POINT = "id long, lat double, lon double, code string, x int"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def in_ring(lat, lon, ys, xs):
    e = ring_edges(ys, xs)
    if e is None:
        return False
    hit = 0
    for shift in (-360, 0, 360):
        x, odd = lon + shift, 0
        for y1, x1, y2, x2 in e:
            odd ^= (y1 > lat) != (y2 > lat) and x < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        hit |= odd
    return bool(hit)


def brute(points, regions):
    out = set()
    for i, lat, lon, *_ in points:
        if lat is None or lon is None or lat != lat or not (abs(lat) <= 90 and abs(lon) <= 180):
            continue
        for p, a, b, r, ys, xs in regions:
            if r is not None and km(lat, lon, a, b) <= r or r is None and in_ring(lat, lon, ys, xs):
                out.add((i, p))
    return out


def world(seed, n=400):
    rng = random.Random(seed)
    regions = [(1, 65.0, 179.9, 40.0, None, None), (2, 0.0, 0.0, 300.0, None, None), (3, 89.5, 10.0, 120.0, None, None), (4, -89.9, 0.0, 30.0, None, None)]
    regions += [(5, None, None, None, [64.0, 66.0, 66.0, 64.0], [179.0, 179.0, -179.0, -179.0]), (6, None, None, None, [-5.0, 5.0, 0.0, 5.0, -5.0, -5.0], [-5.0, -5.0, 0.0, 5.0, 5.0, -5.0])]
    regions += [(7, None, None, None, [1.0, 2.0], [1.0, 2.0]), (8, None, None, None, None, None), (9, 10.0, 10.0, -1.0, None, None), (10, None, None, None, [-60.0, 60.0, 60.0, -60.0], [-100.0, -100.0, 20.0, 20.0])]
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6), "c", 1) for i in range(n)]
    points += [(n + i, rng.uniform(63, 67), rng.choice([-1, 1]) * rng.uniform(178.5, 180), "c", 1) for i in range(n)]
    points += [(2 * n + i, rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-180, 180), "c", 1) for i in range(n)]
    points += [(3 * n, None, 1.0, "", 0), (3 * n + 1, float("nan"), 1.0, "", 0), (3 * n + 2, 91.0, 0.0, "", 0), (3 * n + 3, 0.0, 181.0, "", 0), (3 * n + 4, 90.0, 180.0, "", 0), (3 * n + 5, 0.0, 0.0, "", 0)]
    return points, regions


@pytest.mark.parametrize("bound", [10**6, 0])
def test_equals_brute_force(spark, monkeypatch, bound):
    """Both ways to join: ranges broadcast, and by shuffle with salted hot cells."""
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", bound)
    points, regions = world(1)
    got = points_in_regions(spark.createDataFrame(points, POINT), "lat", "lon", spark.createDataFrame(regions, REGION)).collect()
    assert {(r["id"], r["place_id"]) for r in got} == brute(points, regions)
    assert len(got) == len({(r["id"], r["place_id"]) for r in got})


def test_repeated_points_empty_tables_and_names(spark):
    points, regions = world(2, 5)
    p, r = spark.createDataFrame(points, POINT), spark.createDataFrame(regions, REGION)
    once = points_in_regions(p, "lat", "lon", r)
    assert points_in_regions(p.union(p), "lat", "lon", r).count() == 2 * once.count()
    assert once.columns == ["id", "lat", "lon", "code", "x", "place_id"]
    assert points_in_regions(p.limit(0), "lat", "lon", r).count() == 0
    assert points_in_regions(p, "lat", "lon", r.limit(0)).count() == 0
    with pytest.raises(ValueError):
        points_in_regions(p, "lat", "lon", r, place="code")


def test_cover_has_every_point_of_a_disc():
    from sievelake.operators.spatial import cover_cells, disc_boxes

    rng = random.Random(3)
    for _ in range(50):
        lat, lon, r = rng.uniform(-89, 89), rng.uniform(-180, 180), rng.choice([0.3, 5, 200])
        cells = cover_cells(disc_boxes(lat, lon, r), None)
        for _ in range(20):
            y, x = lat + rng.uniform(-1, 1) * r / 111, lon + rng.uniform(-1, 1) * r / 111
            if abs(y) <= 90 and abs(x) <= 180 and km(y, x, lat, lon) <= r:
                assert any(i * 180 / 2**n - 90 <= y <= (i + 1) * 180 / 2**n - 90 and j * 360 / 2**n - 180 <= x <= (j + 1) * 360 / 2**n - 180 for n, i, j, _ in cells)
