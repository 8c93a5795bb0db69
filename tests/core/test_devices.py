"""Devices, hulls, names, places as text and opening hours against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import matching
from fieldglass.operators import devices


def folded(readings, needed):
    """Levels accepted one reading at a time."""
    out, last, tried = [], None, []
    for ms, level in readings:
        if level == last:
            continue
        tried = [*tried, (ms, level)] if tried and tried[-1][1] == level else [(ms, level)]
        if len(tried) >= needed:
            out.append(tried[0])
            last, tried = level, []
    return out


def test_levels_need_equal_readings(spark):
    rng = random.Random(3)
    rows = {k: [(i * 10, rng.choice((1, 1, 1, 2, 2, 3))) for i in range(n)] for k, n in (("a", 400), ("b", 60), ("c", 4), ("d", 5))}
    rows["e"] = [(i, v) for i, v in enumerate([1] * 5 + [2, 2, 1, 2, 1, 2, 2, 1])]
    df = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v] + [("a", None, 1), ("f", 1, None)], "key string, ms long, level long").repartition(3)
    for needed in (2, 3, 5):
        got = {}
        for r in devices.debounced_levels(df, "key", needed).orderBy("ms").collect():
            got.setdefault(r.key, []).append((r.ms, r.level))
        assert got == {k: v for k, rs in rows.items() if (v := folded(rs, needed))}


def inside_all(points, p, q):
    return all((q[0] - p[0]) * (c[1] - p[1]) - (q[1] - p[1]) * (c[0] - p[0]) >= 0 for c in points)


def test_hulls_hold_all_points(spark):
    rng = random.Random(5)
    groups = {k: [(rng.randrange(20) * 1.0, rng.randrange(20) * 1.0) for _ in range(n)] for k, n in ((1, 200), (2, 30), (3, 1), (4, 2))}
    groups[5] = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]
    rows = [(k, *p) for k, v in groups.items() for p in v]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1, None, 2.0)], "k long, lon double, lat double").repartition(5)
    got = {r.k: [(p.lon, p.lat) for p in r.ring] for r in devices.convex_hulls(df, "k").collect()}
    assert set(got) == set(groups)
    for k, ring in got.items():
        assert ring[0] == ring[-1] and set(ring) <= set(groups[k])
        if k < 3:
            assert all(inside_all(groups[k], p, q) for p, q in zip(ring, ring[1:], strict=False))
            assert len(ring) - 1 == sum(1 for p in set(groups[k]) if not_between(p, set(groups[k])))
    assert got[5] == [(1.0, 1.0), (3.0, 3.0), (1.0, 1.0)] and len(got[3]) == 2


def not_between(p, points):
    """Whether a point is a corner: some half-plane through it has all others strictly on one side, by angles without a gap below a half turn."""
    import math

    angles = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in points if q != p)
    gaps = [b - a for a, b in zip(angles, angles[1:], strict=False)] + [angles[0] + 2 * math.pi - angles[-1]]
    return max(gaps) > math.pi + 1e-9


@pytest.mark.parametrize("hours, day, minute, expected", [
    ("24/7", 3, 0, True), ("Mo-Su 00:00-24:00", 6, 1439, True), ("08:00-12:00", 2, 479, False), ("08:00-12:00", 2, 480, True), ("08:00-12:00", 2, 720, False), ("Mo 22:00-03:00", 1, 179, True),
    ("Mo 22:00-03:00", 0, 100, False), ("Sa-Mo 10:00-11:00", 6, 610, True), ("Sa-Mo 10:00-11:00", 2, 610, False), ("Mo-Su 08:00-20:00; We off", 2, 600, False), ("Tu,Th 9:00-10:00,11:00-12:00", 3, 665, True),
    ("PH off", 0, 0, None), ("sunrise-sunset", 0, 0, None), ("", 0, 0, None), (None, 0, 0, None),
])
def test_opening_hours(spark, hours, day, minute, expected):
    df = spark.createDataFrame([(hours, day, minute)], "h string, d int, m int")
    assert df.select(matching.is_open(F.col("h"), F.col("d"), F.col("m"))).first()[0] is expected


@pytest.mark.parametrize("text, expected", [
    ("39.5, -75.25", (39.5, -75.25)), ("39,5 -75,25", (39.5, -75.25)), ("39 30 N 75 15 W", (39.5, -75.25)), ("75°15'0\"W 39°30'0\"N", (39.5, -75.25)), ("-10 30 36, 20 0 0", (-10.51, 20.0)), ("95 10", None),
    ("39.5", None), ("Main Street 5 7", None), ("1 2 3", None), ("", None), (None, None),
])
def test_places_as_text(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(matching.place(F.col("t"))).first()[0]
    assert got is None if expected is None else tuple(got) == pytest.approx(expected)


@pytest.mark.parametrize("name, query, mode, expected", [
    ("Rue de Créteil", "crete", "word_starts", True), ("Rue de Créteil", "rue", "later_word_starts", False), ("Rue de Créteil", "de", "word_equals", True), ("Saint-Denis", "saintdenis", "equals", True),
    ("Saint-Denis", "denis", "word_equals", True), ("Saint Denis", "sain.", "word_equals", True), ("Saint Denis", "sain", "word_equals", False), ("Denis", "in Saint Denis", "query_holds_word", True), (None, "a", "contains", False), ("b", "", "equals", True),
])
def test_matching_modes(spark, name, query, mode, expected):
    assert spark.createDataFrame([(name,)], "n string").select(matching.matches(F.col("n"), query, mode)).first()[0] is expected


def test_ids_of_split_ways_and_made_nodes(spark):
    rows = [(7 << 11 | devices.SPLIT_BIT, 7), (9 << 11 | 3 << 6 >> 6 | devices.NODE_BIT, 9), (14, 7), (15, 7), (devices.RELATION_BIT + (7 << 11), 7)]
    got = spark.createDataFrame(rows, "i long, want long").select(devices.osm_id(F.col("i")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rings_that_cross_are_not_inside(spark):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    notch = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0), (0.0, 0.0)]
    rows = [(box(1.0, 1.0, 2.0, 2.0), notch, True), (box(1.0, 1.0, 9.0, 4.0), notch, False), (box(4.0, 6.0, 6.0, 8.0), notch, False), (box(-1.0, 1.0, 2.0, 2.0), notch, False)]
    kind = "array<struct<lon:double,lat:double>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, want boolean")
    assert all(r.got == r.want for r in df.select(devices.ring_in_ring(F.col("a"), F.col("b")).alias("got"), "want").collect())
