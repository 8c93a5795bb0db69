"""Operators without SQL against plain Python."""

import gzip
import json
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import geo, text
from fieldglass.operators import cameras, graph, search, study, tracks
from fieldglass.plans.standins import standin
from fieldglass.sources import readers
from fieldglass.streaming import state

SF = "/root/testdata/sf0.001"


def test_segments_meet_wedges_as_by_all_pairs(spark):
    wedges = cameras.cones(standin(spark, SF, "cameras").limit(60))
    rows = [(i, -75.5 + i * 0.003, 39.0 + (i * 7 % 10) * 0.01, -75.49 + i * 0.003, 39.0 + (i * 3 % 10) * 0.01) for i in range(20)]
    segments = spark.createDataFrame(rows, "seg long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.seg, r.id, r.head) for r in cameras.crossed_cones(segments, wedges).collect()}
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    want = set()
    for w in wedges.collect():
        ring = [(p.lon, p.lat) for p in w.ring]
        for s, x1, y1, x2, y2 in rows:
            p, q = (x1, y1), (x2, y2)
            if any(cross(p, q, a) * cross(p, q, b) <= 0 and cross(a, b, p) * cross(a, b, q) <= 0 for a, b in zip(ring, ring[1:])):
                want.add((s, w.id, w.head))
    assert got == want and want


@pytest.mark.parametrize("direction, heads", [
    ("200", [(200, 45)]), ("10-30", [(20, 20)]), ("350-10", [(0, 20)]), ("15;75", [(15, 45), (75, 45)]), ("30-60;340-0", [(45, 30), (350, 20)]), ("w", [(270, 45)]), ("N E", [(45, 45)]),
    ("20-20", [(42.5, 45)]), ("up", []), (" ; ", []), (None, []), ("-90", [(270, 45)]), (".5", [(0.5, 45)]), ("5.", [(5, 45)]), ("1e2", [(100, 45)]), ("0x10", []), ("1-2-3", []), ("NaN", []),
])
def test_directions(spark, direction, heads):
    df = spark.createDataFrame([(direction,)], "d string")
    assert [tuple(h) for h in df.select(text.heads(F.col("d"))).first()[0]] == heads


def test_quartiles_are_the_exclusive_ones(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "g string, v double")
    rows = {r.g: r for r in study.exclusive_quartiles(df, "v", ["g"]).collect()}
    assert [rows["a"].q1, rows["a"].q2, rows["a"].q3] == pytest.approx(statistics.quantiles(values, n=4))
    assert rows["b"].q1 is None


def test_bootstrap_repeats_itself(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", 7.0)], "g string, v double")
    one, two = (sorted(map(tuple, study.bootstrap(df.repartition(k), ["g"], ["v"], study.medians, 200).collect())) for k in (1, 5))
    assert one == two and one[1] == ("b", 7.0, 7.0, 7.0) and one[0][2] < 24.5 < one[0][3]


def test_smoothing_and_elevation(spark):
    pts = pd.DataFrame({"track": 1, "idx": range(6), "metres": [None, 4.0, 4.0, 4.0, 4.0, 1.0], "ele": [0.0, 3.0, 20.0, 18.0, 5.0, 6.0], "run": [0.0, 4, 8, 12, 16, 17]})
    df = spark.createDataFrame(pts)
    assert sorted(r.idx for r in tracks.smoothed(df, 7.0).collect()) == [0, 2, 4, 5]
    up = tracks.elevation_changes(df).first()
    assert (up.up, up.down) == (20.0, 14.0)


def test_boxes_are_validated(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.5, 1.5)], "id long, lat double, lon double")
    assert cameras.in_box(df, 0, 0, 2, 2, limit=1).first().truncated
    for bad in ((2, 0, 1, 1), (0, 0, 6, 1)):
        with pytest.raises(ValueError):
            cameras.in_box(df, *bad)


def test_haversine_known_value(spark):
    one = F.lit(1.0)
    d = spark.range(1).select(geo.haversine_6371000(F.lit(0.0), F.lit(0.0), F.lit(0.0), one)).first()[0]
    assert d == pytest.approx(111194.9, abs=0.1)


def test_cut_gzip_keeps_whole_lines(spark, tmp_path):
    a, b = (gzip.compress("".join(json.dumps({"k": i}) + "\n" for i in r).encode()) for r in (range(5), range(5, 2000)))
    (tmp_path / "x.gz").write_bytes(a + b[: len(b) // 2])
    got = sorted(r.k for r in readers.gzip_lines(spark, str(tmp_path), "k long").collect())
    assert got == list(range(len(got))) and len(got) > 5


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg><trkpt lat="1" lon="2"><ele>3</ele><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="1.5" lon="2"/></trkseg></trk></gpx>')
    (tmp_path / "b.gpx").write_text("<gpx")
    rows = readers.gpx_points(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.lat, r.ele, r.ms) for r in rows] == [(1.0, 3.0, 1704067200000), (1.5, None, 0)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 10, 5.0), (1, 20, 999.0), (2, 5, 1.0), (1, 15, 6.0)], "key long, ms long, v double").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ms long, v double").parquet(str(tmp_path / "in"))
    df = state.accepted_positions(stream, 6)
    q = df.writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("accepted").collect()} == {(1, 10), (1, 20), (2, 5)}


def test_every_row_has_a_level_and_a_place(spark):
    keys = [i * i // 4000 for i in range(1500)] + [900 + i for i in range(30)]
    want, level, held = [], 0, 0
    for i, k in enumerate(keys):
        if i and k != keys[i - 1] and held >= (3, 20, 100)[min(level, 2)]:
            level, held = level + 1, 0
        held += 1
        want.append((i, level))
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key long").repartition(5)
    assert sorted((r.id, r.level) for r in search.visible_levels(df, ["key"]).collect()) == want
    places = search.placed(df, [F.col("key").desc(), F.col("id")])
    assert sorted((r.place, r.id) for r in places.collect()) == [(p, i) for p, (_, i) in enumerate(sorted((-k, i) for i, k in enumerate(keys)), 1)]


def test_least_costs_reach_the_end_of_a_long_path(spark):
    edges = [(i, i + 1, 1.0) for i in range(70)] + [(0, 70, 90.0), (70, 71, 50.0)]
    df = spark.createDataFrame(edges, "src long, dst long, cost double").coalesce(1).cache()
    got = graph.least_costs(df, spark.range(1).select(F.col("id").alias("node")), 100.0)
    assert sorted(tuple(r) for r in got.collect()) == [(0, i, float(i)) for i in range(71)]
    with pytest.raises(ValueError, match="negative"):
        graph.least_costs(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, cost double"), spark.range(1).select(F.col("id").alias("node")), 1.0)
