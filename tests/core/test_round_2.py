"""What the findings of round 2 named, each on a small input that failed before."""

import contextlib
import gzip
import math
import random
import zlib
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.operators import cameras, devices, search
from fieldglass.plans import mobility, scans
from fieldglass.plans.standins import standin
from fieldglass.sources import readers


SF = "/root/testdata/sf0.001"


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_alerts_judge_the_values_they_report(spark):
    rows = [(i, 0.0, 0.0, 0.0, 10.0, 0.01, m / 60, 0.0, 0.0) for i, m in enumerate((0.9, 1.00003, 1.00008))]
    df = spark.createDataFrame(rows, "idx long, lat double, lon double, cog double, sog double, o_lat double, o_lon double, o_cog double, o_sog double")
    assert sorted(tuple(r) for r in devices.approach_alerts(df, 1.0, 0.5).select("idx", "miles").collect()) == [(0, 0.9), (1, 1.0)]


def test_box_has_every_camera(spark, tmp_path):
    part = spark.range(60_000).select(
        F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit("red").alias("p_name"), F.lit(1).alias("p_size")
    )
    got = mobility.cameras_in_box(spark, write(part, tmp_path, "part"))
    assert got.count() == got.where("not truncated").count() > 20_000


@pytest.fixture
def tenths(spark, tmp_path):
    """Tracks whose speeds add up to 100 or just less, by their order, against the order of the file; one of unknown speed, one of unknown kind."""
    rng, rows, sums = random.Random(5), [], {}
    for track in range(200):
        speeds = [rng.randrange(200) for _ in range(10)]
        while sum(speeds) < 1000:
            speeds.append(min(199, 1000 - sum(speeds)))
        speeds = speeds if sum(speeds) == 1000 else [125] * 8
        # 31 * 71 is 1 modulo 200, so this id has that speed.
        ids = [track * 10_000 + i * 200 + s * 71 % 200 for i, s in enumerate(speeds)]
        rows += [(i, track, "click") for i in ids]
        sums[track] = reduce(add, (i * 31 % 200 / 10 for i in ids))  # sum() would make up for rounding
    rows = [*reversed(rows), (None, -1, "view"), (71, -2, None)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1)
    events = events.select("*", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))
    return write(events, tmp_path, "events"), sums


def test_lengths_are_added_in_order(spark, tenths):
    folder, sums = tenths
    low = sum(x < 100 for x in sums.values())
    assert 0 < low < 200
    got = {tuple(r) for r in mobility.organized_by_range(spark, folder).collect()}
    assert got == {("from_100_to_200", 200 - low), (None, 1), ("from_0_to_100", low + 1)}


def test_folders_of_lengths_added_in_order(spark, tenths):
    folder, sums = tenths
    want = {(k, "click", x >= 100, True) for k, x in sums.items()} | {(-1, "view", None, True), (-2, None, False, None)}
    assert {tuple(r) for r in mobility.smart_folders(spark, folder).collect()} == want


def test_gzip_scan_with_an_empty_file(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b'{"k": 1}\n'))
    (tmp_path / "c.gz").write_bytes(b"")
    (tmp_path / "d.gz").write_bytes(gzip.compress(b'{"k": 2}'))
    assert [r.k for r in readers.gzip_lines(spark, str(tmp_path), "k long").collect()] == [1]


def test_gzip_scan_of_a_table_whose_first_partition_is_empty(spark, tmp_path):
    events = spark.createDataFrame([(1, 2, "view")], "event_id long, user_id long, event_type string")
    folder = write(events.limit(0).union(events), tmp_path, "events")
    assert [tuple(r) for r in scans.gzip_scan(spark, folder).collect()] == [(1, 2, "view")]


@pytest.mark.parametrize("at", [0, 40, 5_000, 30_000, 70_000, 10**9])
def test_damaged_gzip_keeps_what_comes_before(at):
    rng = random.Random(1)
    text = b"".join(b"%d %d\n" % (i, rng.getrandbits(60)) for i in range(20_000))
    whole = gzip.compress(text[:9]) + gzip.compress(text[9:])
    bad = bytearray(whole)
    bad[at : at + 64] = bytes(len(bad[at : at + 64]))
    z, want, left = zlib.decompressobj(31), b"", bytes(bad)
    with contextlib.suppress(zlib.error):
        while left:
            for i in range(0, len(left), 256):
                want += z.decompress(left[i : i + 256])
                if z.eof:
                    left = z.unused_data + left[i + 256 :]
                    break
            else:
                break
            z = zlib.decompressobj(31)
    got = [x for lines in readers.salvaged(bytes(bad)) for x in lines]
    assert got == want[: want.rfind(b"\n") + 1].decode("utf-8", "replace").splitlines()
    assert at < 10**9 or len(got) == 20_000


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_posted_cameras_of_watched_points_are_not_broadcast(spark):
    assert broadcasts(mobility.watched_points(spark, SF)) == 0


def test_nearest_widens_without_broadcast(spark):
    rng = random.Random(3)
    spot = lambda i, spread: (i, 39 + rng.random() * spread, -75 + rng.random() * spread)
    places, points = [spot(i, 0.01) for i in range(300)], [spot(i, 0.02) for i in range(200)]
    rows = lambda rows, key: spark.createDataFrame(rows, f"{key} long, lat double, lon double")
    df = search.nearest(rows([*points, (None, 39.0, -75.0), (None, 39.02, -75.02)], "idx"), rows([*places, (-1, *places[0][1:])], "id"), ["idx"], 300.0)

    def metres(a, b):
        (y1, x1), (y2, x2) = (map(math.radians, p) for p in (a, b))
        return 2 * 6372800 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))

    want = {}
    for i, *at in [*points, (None, 39.0, -75.0), (None, 39.02, -75.02)]:
        d, place = min((metres(at, p), k) for k, *p in [(-1, *places[0][1:]), *places])
        if d <= 300 and (i not in want or (d, place) < want[i]):
            want[i] = (d, place)
    got = {r.idx: (r.metres, r.place) for r in df.collect()}
    assert {k: (round(d, 6), p) for k, (d, p) in got.items()} == {k: (round(d, 6), p) for k, (d, p) in want.items()} and len(got) < 201
    assert df.count() == len(got) and broadcasts(df) == 0


def test_ways_have_each_wedge_once_without_broadcast(spark):
    wedges = cameras.cones(standin(spark, SF, "cameras").where("id % 3 = 0"))
    rng = random.Random(11)
    spot = lambda: (39 + rng.random() * 0.1, -75.5 + rng.random() * 0.1)
    ways = [(i, *spot(), *spot()) for i in range(30)] + [(30, 39.05, -75.45, 39.05, -75.45), (31, 39.05, -75.48, 39.05, -75.42)]
    # The corner of some ways lies in a wedge, so both legs meet it.
    ways += [(100 + i, r.lat + 2e-5 + 0.01, r.lon, r.lat + 2e-5, r.lon + 0.01) for i, r in enumerate(wedges.orderBy("id", "head").limit(20).collect())]
    legs = [(w, y1, x1, y2, x1, None, None) for w, y1, x1, y2, x2 in ways] + [(w, y2, x1, y2, x2, y1, x1) for w, y1, x1, y2, x2 in ways]
    segments = spark.createDataFrame(legs, "way long, y1 double, x1 double, y2 double, x2 double, y0 double, x0 double")
    df = cameras.crossed_cones(segments, wedges, corner=("x0", "y0"))
    got = sorted((r.way, r.id, r["head"]) for r in df.collect())
    # All pairs, by the edges of the rings.
    rings = wedges.select("id", "head", "ring")
    edges = F.arrays_zip(F.col("ring").alias("p"), F.slice("ring", 2, 1000).alias("q"))
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    meets = F.exists(edges, lambda e: F.coalesce(geo.segments_cross(*ends, e["p"]["lon"], e["p"]["lat"], e["q"]["lon"], e["q"]["lat"]), F.lit(False))) | geo.in_ring(ends[0], ends[1], F.col("ring"))
    each = segments.crossJoin(rings).where(meets).select("way", "id", "head")
    assert got == sorted(tuple(r) for r in each.distinct().collect()) and each.count() > len(got)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_commutes_do_not_broadcast_by_file_size(spark):
    plan = mobility.watched_commutes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [o_orderkey" not in plan and "BroadcastHashJoin [cy" not in plan and "SortMergeJoin [o_orderkey" in plan
