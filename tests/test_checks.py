"""Proximity, zones, orphans and skew against brute force, with awkward rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfold.operators.orphans import find_orphans, key_runs, orphan_report
from wayfold.operators.proximity import EARTH_RADIUS_M, distinct_points, near_pairs, near_pairs_on_sphere
from wayfold.operators.skew import hot_keys, repeat, spread
from wayfold.operators.zones import locate_in_zones, trapezoids

POINTS = "id bigint, c0 double, c1 double"


def pairs(df):
    return sorted((r.a_id, r.b_id) for r in df.collect())


def test_hot_keys_split_and_meet(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), "id")
    hot = hot_keys(df, [F.col("k")], rows_per_salt=100)
    assert [r.salts for r in hot.collect()] == [4]
    salts = spread(df, [F.col("k")], hot, [F.col("id")])
    assert salts.where("k = 7").select("salt").distinct().count() == 4 and salts.count() == 1000
    other = repeat(df.select("k").distinct(), [F.col("k")], hot)
    assert other.where("k = 7").count() == 4
    assert salts.join(other, ["k", "salt"]).count() == 1000
    assert hot_keys(df.where("false"), [F.col("k")]).count() == 0


def test_two_thousand_hot_keys_are_all_spread(spark):
    df = spark.range(42_000).select((F.col("id") % 2100).alias("k"), "id").where("k < 2000 OR id < 2100")
    hot = hot_keys(df, [F.col("k")], rows_per_salt=5)
    assert hot.count() == 2000 and {r.salts for r in hot.select("salts").distinct().collect()} == {4}
    spread_over = spread(df, [F.col("k")], hot, [F.col("id")]).groupBy("k").agg(F.countDistinct("salt").alias("n"))
    assert spread_over.where("k < 2000 AND n < 2").count() == 0 and spread_over.where("k >= 2000 AND n > 1").count() == 0


@pytest.mark.parametrize("rows_per_salt", [100_000, 5])
def test_near_pairs_against_brute_force(spark, rows_per_salt):
    rng = random.Random(5)
    points = [(k, rng.uniform(-40, 40), rng.uniform(-40, 40)) for k in range(250)] + [(300 + k, 1.0, 1.0) for k in range(6)]
    points += [(400, -7.0, 0.0), (401, 1.0, 0.0)]
    found = pairs(near_pairs(spark.createDataFrame(points, POINTS), 8.0, rows_per_salt=rows_per_salt))
    expected = sorted(
        (a, b) for a, ax, ay in points for b, bx, by in points if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= 64.0
    )
    assert found == expected and (400, 401) in found


def test_near_pairs_on_sphere_at_pole_and_antimeridian(spark):
    points = [(1, 89.99999, 0.0), (2, 89.99999, 180.0), (3, 10.0, 179.99999), (4, 10.0, -179.99999), (5, 10.0, 0.0)]
    points += [(10 + k, 45.0 + k * 0.0002, 7.0) for k in range(6)]

    def apart(p, q):
        (la, lo), (lb, lp) = [(math.radians(r[1]), math.radians(r[2])) for r in (p, q)]
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))

    expected = sorted((p[0], q[0]) for p in points for q in points if p[0] < q[0] and apart(p, q) <= 30)
    assert pairs(near_pairs_on_sphere(spark.createDataFrame(points, POINTS), 30.0)) == expected
    assert (1, 2) in expected and (3, 4) in expected


def test_points_nulls_repeats_and_empty(spark):
    raw = spark.createDataFrame(
        [(1, 0.0, 0.0, 9), (1, 0.0, 0.0, 8), (1, None, None, 7), (2, float("nan"), 1.0, 1), (None, 0.0, 0.0, 1), (3, 0.0, 5.0, 1), (4, float("inf"), 0.0, 1)],
        "id bigint, x double, y double, c0 int",
    )
    points = distinct_points(raw, "id", ["x", "y"])
    assert sorted(tuple(r) for r in points.collect()) == [(1, 0.0, 0.0), (3, 0.0, 5.0)]
    assert pairs(near_pairs(points, 8.0)) == [(1, 3)]
    assert pairs(near_pairs(points.where("false"), 8.0)) == []
    with pytest.raises(ValueError):
        near_pairs(points, 0.0)


def ring(zone, no, corners, closed=False, backwards=False):
    corners = corners[::-1] if backwards else corners
    corners = corners + corners[:1] if closed else corners
    return [(zone, no, k, float(x), float(y)) for k, (x, y) in enumerate(corners)]


RINGS = "zone_id bigint, ring_no int, vertex_no int, lon double, lat double"


def inside(rings, zone, x, y):
    odd = False
    for no in {r[1] for r in rings if r[0] == zone}:
        corner = [(r[3], r[4]) for r in sorted(r for r in rings if r[0] == zone and r[1] == no)]
        for (ax, ay), (bx, by) in zip(corner, corner[1:] + corner[:1]):
            if (ax > x) != (bx > x) and y > ay + (by - ay) * (x - ax) / (bx - ax):
                odd = not odd
    return odd


@pytest.mark.parametrize("rows_per_salt", [200_000, 20])
def test_zones_against_ray_casting(spark, rows_per_salt):
    rings = ring(1, 0, [(0, 0), (4, 0), (4, 4), (0, 4)], closed=True) + ring(1, 1, [(1, 1), (2, 1), (2, 3), (1, 2)], backwards=True)
    rings += ring(2, 0, [(4, 0), (7, 1), (5, 2), (8, 5), (4, 4)])  # touches zone 1, with a notch
    rings += ring(3, 0, [(-0.2, 4.5), (-0.1, 4.6), (-0.3, 4.7)], backwards=True) + ring(4, 0, [(100, 10), (160, 20), (130, 70), (101, 60)])
    rings += [(2, 0, 9, None, 3.0), (None, 0, 0, 1.0, 1.0)]
    clean = [r for r in rings if None not in r]
    rng = random.Random(8)
    points = [(k, rng.uniform(-1, 6), rng.uniform(-1, 9)) for k in range(600)] + [(1000 + k, rng.uniform(0, 80), rng.uniform(90, 170)) for k in range(200)]
    points += [(5000, 0.5, 2.0), (5001, 2.0, 1.0000001)]  # above a vertex of the hole
    found = sorted((r.zone_id, r.id) for r in locate_in_zones(
        spark.createDataFrame(points, POINTS), spark.createDataFrame(rings, RINGS), rows_per_salt).collect())
    assert found == sorted((z, p) for p, y, x in points for z in (1, 2, 3, 4) if inside(clean, z, x, y))
    assert len({z for z, _ in found}) >= 3


def test_zone_of_very_many_edges(spark):
    corners = [(math.cos(a) * (3 + math.sin(40 * a)), math.sin(a) * (3 + math.sin(40 * a))) for a in (2 * math.pi * k / 3000 for k in range(3000))]
    rings = ring(1, 0, corners) + ring(2, 0, [(9, 9), (10, 9), (9, 10)])
    rng = random.Random(9)
    points = [(k, rng.uniform(-4.5, 4.5), rng.uniform(-4.5, 4.5)) for k in range(400)]
    found = sorted((r.zone_id, r.id) for r in locate_in_zones(spark.createDataFrame(points, POINTS), spark.createDataFrame(rings, RINGS)).collect())
    assert found == sorted((1, p) for p, y, x in points if inside(rings, 1, x, y)) and len(found) > 50
    assert {r.level for r in trapezoids(spark.createDataFrame(rings, RINGS)).select("level").distinct().collect()} == {0, 2}


def test_zones_that_overlap(spark):
    rings = ring(1, 0, [(0, 0), (16, 0), (16, 16), (0, 16)]) + ring(2, 0, [(0.5, 4), (15.5, 4), (15.5, 5), (0.5, 5)]) + ring(3, 0, [(-3, 8), (7, -2), (17, 8), (7, 18)])
    rng = random.Random(4)
    points = [(k, rng.uniform(-4, 19), rng.uniform(-4, 19)) for k in range(300)] + [(999, 10.0, 8.0)]
    found = sorted((r.zone_id, r.id) for r in locate_in_zones(spark.createDataFrame(points, POINTS), spark.createDataFrame(rings, RINGS)).collect())
    assert found == sorted((z, p) for p, y, x in points for z in (1, 2, 3) if inside(rings, z, x, y)) and (1, 999) in found


def test_zones_empty_and_repeated_vertices(spark):
    rings = ring(1, 0, [(0, 0), (4, 0), (4, 4), (0, 4)])
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], POINTS)
    doubled = spark.createDataFrame(rings + rings, RINGS)
    assert [(r.zone_id, r.id) for r in locate_in_zones(points, doubled).collect()] == [(1, 1)]
    assert locate_in_zones(points, doubled.where("false")).count() == 0
    assert locate_in_zones(points.where("false"), doubled).count() == 0
    assert trapezoids(spark.createDataFrame(ring(5, 0, [(0, 0), (0, 4)]), RINGS)).count() == 0


T0 = datetime(2024, 1, 1)


def at(day):
    return None if day is None else T0 + timedelta(days=day)


def test_runs(spark):
    parents = spark.createDataFrame([(k, True) for k in [1, 2, 3, 3, 7, 8, 4095, 4096, 4097, -5]] + [(4, False), (2, False), (None, True), (9, None)], "key bigint, placed boolean")
    found = sorted(tuple(r)[1:] for r in key_runs(parents).collect())
    assert found == [(-5, -5, True), (1, 3, True), (4, 4, False), (7, 8, True), (9, 9, False), (4095, 4095, True), (4096, 4097, True)]


def reason(key, t, parents):
    rows = [p for p in parents if p[0] == key]
    placed = [p for p in rows if p[1]]
    t = 10**9 if t is None else t
    loaded = [p for p in placed if (p[2] if p[2] is not None else -1) <= t]
    if not rows:
        return "missing"
    if not placed:
        return "unplaced"
    if not loaded:
        return "late"
    return None if any(p[3] is None or p[3] > t for p in loaded) else "deleted"


@pytest.mark.parametrize("rows_per_salt", [200_000, 30])
def test_orphans_against_brute_force(spark, rows_per_salt):
    rng = random.Random(2)
    parents = [(rng.choice([1, 2, 3, 10, 5000, 5001, -7]), rng.random() < 0.7, rng.choice([None, *range(10)]), None) for _ in range(25)]
    parents = [(k, p, a, rng.choice([None, *range((a or 0), 12)])) for k, p, a, _ in parents] + [(4, False, 1, None), (None, True, 1, None)]
    refs = [(n, rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 10, 4999, 5000, 5001, 9999, -7, -8]), rng.choice([None, *range(12)])) for n in range(300)]
    refs += refs[:5]
    df = spark.createDataFrame([(n, k, at(t), "x") for n, k, t in refs], "row_id int, key bigint, loaded_at timestamp, placed string")
    pf = spark.createDataFrame([(k, p, at(a), at(b)) for k, p, a, b in parents], "key bigint, placed boolean, loaded_at timestamp, deleted_at timestamp")
    found = find_orphans(df, pf, rows_per_salt=rows_per_salt)
    assert found.columns == ["row_id", "placed", "reason"]
    expected = sorted((n, why) for n, k, t in refs if k is not None and (why := reason(k, t, parents)))
    assert sorted((r.row_id, r.reason) for r in found.collect()) == expected
    assert {w for _, w in expected} == {"missing", "unplaced", "late", "deleted"}


def test_orphans_empty_tables(spark):
    df = spark.createDataFrame([(1, 5, at(1)), (1, 5, at(1))], "row_id int, key bigint, loaded_at timestamp")
    none = spark.createDataFrame([], "key bigint, placed boolean, loaded_at timestamp, deleted_at timestamp")
    found = find_orphans(df, none)
    assert [tuple(r) for r in found.collect()] == [(1, "missing")] * 2
    assert find_orphans(df.where("false"), none).count() == 0
    kept = find_orphans(df.withColumn("at", F.col("loaded_at")), none)
    report = orphan_report(kept, [], "month", "at")
    assert [(str(r.period), r.reason, r.orphans) for r in report.collect()] == [("2024-01-01", "missing", 1)]
