"""Registered queries of the track library, places along paths, vessels, vehicles and text forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import geo, text
from fieldglass.operators import library as L
from fieldglass.operators.search import placed
from fieldglass.plans.mobility import HAV, LEGS
from fieldglass.plans.standins import duck, standin, table

big = lambda c: c.cast("long")
r = lambda c, n=6: F.round(c, n)
col = F.col
HOME = (39.05, -75.45)

# A library of tracks, one a kind and user: 0, -1 and null are unknown dates.
TRACKS = """SELECT CAST(min(idx) AS BIGINT) AS id, concat(kind, '-', CAST(track % 7 AS STRING)) AS name, concat('all/', kind) AS folder, CASE WHEN track % 11 = 0 THEN -1 WHEN track % 13 = 0 THEN NULL ELSE min(ms) END AS created,
 max(ms) AS modified, CASE WHEN track % 5 > 0 THEN count(*) END AS value, CASE WHEN track % 6 > 0 THEN CAST(sum(CAST(idx * 7 % 1000 AS BIGINT)) AS BIGINT) END AS distance, max(ms) - min(ms) AS duration, min(lat) AS lat, min(lon) AS lon,
 track % 2 = 0 AS visible, CASE WHEN track % 3 > 0 THEN track % 4 = 0 END AS waypoints FROM points GROUP BY track, kind"""


def tracks(spark: SparkSession, d: str) -> DataFrame:
    df = spark.sql(TRACKS.replace("FROM points", "FROM {points}"), points=standin(spark, d, "points"))
    away = geo.haversine_6372800(F.lit(HOME[0]), F.lit(HOME[1]), col("lat"), col("lon"))
    return df.withColumn("metres_away", big(F.round(away)))


def track_filters(spark: SparkSession, d: str) -> DataFrame:
    """Date, text and flag filters, as one scan."""
    dates = L.in_dates(col("created"), 1_704_100_000_000, 1_704_900_000_000)
    return tracks(spark, d).select("id", dates.alias("dated"), L.has_text(col("name"), " CLI ").alias("named"), L.has_all({"visible": True, "waypoints": True}).alias("flagged"))


def sorted_by_modes(spark: SparkSession, d: str) -> DataFrame:
    """The place of every track in each of the twelve orders."""
    df = tracks(spark, d)
    each = [placed(df, L.sort_keys(m)).select(F.lit(m).alias("mode"), "id", "place") for m in L.SORT_MODES]
    return reduce(lambda a, b: a.unionByName(b), each)


def sorted_groups(spark: SparkSession, d: str) -> DataFrame:
    """Folders by total distance, unknown last, then by duration and name."""
    g = tracks(spark, d).groupBy("folder").agg(big(F.sum("distance")).alias("distance"), big(F.sum("duration")).alias("duration"))
    return placed(g, [col("distance").desc_nulls_last(), col("duration").desc(), col("folder")])


def accepted_places(spark: SparkSession, d: str) -> DataFrame:
    places = standin(spark, d, "cameras").select("id", F.lower("kind").alias("category"), F.lower("vendor").alias("subtype"))
    types = spark.createDataFrame([("small", None), ("economy", "brand#2"), ("economy", "brand#17"), ("other", "brand#4")], "category string, subtype string")
    return L.accepted_types(places, types, ["small", "economy", "standard"]).select("id")


def places_by_rating(spark: SparkSession, d: str) -> DataFrame:
    """The 1,000 best rated places: a list of that length is the feature."""
    return standin(spark, d, "cameras").select("id", big(col("size")).alias("rating")).orderBy(col("rating").desc(), "id").limit(1000)


def unexpired_rows(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "points").where(col("ms") >= 1_704_400_000_000).select("idx")


def vendor_classes(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "cameras").withColumn("vendor", F.when(col("id") % 9 > 0, col("vendor")))
    return df.groupBy(text.vendor_class(col("vendor"), "brand#1").alias("class")).agg(big(F.count(F.lit(1))).alias("n"))


def brand_places(spark: SparkSession, d: str) -> DataFrame:
    """One tag equal whatever the case, one kind equal as it is."""
    return standin(spark, d, "cameras").where((F.lower("vendor") == "brand#4") & (col("kind") == "SMALL")).select("id")


def moved_points(spark: SparkSession, d: str) -> DataFrame:
    """Course to a place, turn from a heading, the point on a constant course, and one along the great circle."""
    lat, lon, home = col("lat"), col("lon"), [F.lit(x) for x in HOME]
    to = geo.bearing(lat, lon, *home)
    y, x = geo.rhumb_destination(lat, lon, F.lit(1000.0), (col("idx") * 37 % 360).cast("double"))
    gy, gx = geo.intermediate(lat, lon, *home, F.lit(0.25))
    my, mx = geo.midpoint(lat, lon, *home)
    out = {"course": to, "turn": geo.signed_angle((col("idx") * 37 % 360).cast("double"), to), "y": y, "x": x, "gy": gy, "gx": gx, "my": my, "mx": mx}
    return standin(spark, d, "points").select("idx", *[r(c).alias(n) for n, c in out.items()])


def projected_points(spark: SparkSession, d: str) -> DataFrame:
    ends = [F.lit(x) for x in (39.02, -75.48, 39.07, -75.41)]
    df = standin(spark, d, "points")
    return df.select("idx", r(geo.projection_share(col("lat"), col("lon"), *ends)).alias("share"), r(geo.orthogonal_metres(col("lat"), col("lon"), *ends), 3).alias("metres"))


LEG_ROWS = [(0, 39.0, -75.5, 39.03, -75.46), (1, 39.03, -75.46, 39.03, -75.43), (2, 39.03, -75.43, 39.09, -75.42)]


def cameras_along_path(spark: SparkSession, d: str) -> DataFrame:
    """Cameras within 250 m of a path, with the leg they are nearest to."""
    legs = spark.createDataFrame(LEG_ROWS, "leg long, y1 double, x1 double, y2 double, x2 double")
    return L.along_path(standin(spark, d, "cameras").select("id", "lat", "lon"), legs, 250.0).select("id", "leg", r(col("off"), 3).alias("off"))


def cone_areas(spark: SparkSession, d: str) -> DataFrame:
    """Signed area of each field of view, in square micro-degrees, and whether it runs clockwise."""
    from fieldglass.operators.cameras import cones

    a = geo.ring_area(col("ring"))
    return cones(standin(spark, d, "cameras")).select("id", big(col("head")).alias("head"), F.round(a * F.lit(1e12), 1).alias("area"), (a < 0).alias("clockwise"))


def tile_corners(spark: SparkSession, d: str) -> DataFrame:
    """Tiles from their interleaved codes, and where they lie."""
    df = standin(spark, d, "cameras")
    df = df.withColumn("code", geo.morton(geo.tile_x(col("lon"), 15), geo.tile_y(col("lat"), 15)))
    df = df.withColumn("x", geo.unmorton(col("code"), False)).withColumn("y", geo.unmorton(col("code"), True))
    return df.select("id", "x", "y", r(geo.tile_west(col("x"), 15), 8).alias("west"), r(geo.tile_north(col("y"), 15), 8).alias("north"))


def boxes_around(spark: SparkSession, d: str) -> DataFrame:
    b = geo.box_around(col("lat"), col("lon"), (col("size") * 100).cast("double"))
    return standin(spark, d, "cameras").select("id", b.alias("b")).select("id", *[r(col(f"b.{c}")).alias(c) for c in ("south", "west", "north", "east")])


def albers_places(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.albers(col("lat"), col("lon"))
    return standin(spark, d, "cameras").select("id", r(x, 9).alias("x"), r(y, 9).alias("y"))


def converted_units(spark: SparkSession, d: str) -> DataFrame:
    v = col("p_retailprice")
    out = {"miles": geo.convert(v, geo.LENGTH, "m", "mi"), "knots": geo.convert(v, geo.SPEED, "km/h", "kn"), "pounds": geo.convert(v, geo.WEIGHT, "kg", "lb"), "mils": geo.convert(v, geo.ANGLE, "deg", "mil"), "fahrenheit": geo.fahrenheit(v)}
    return table(spark, d, "part").select("p_partkey", *[r(c).alias(n) for n, c in out.items()])


def ellipsoid_legs(spark: SparkSession, d: str) -> DataFrame:
    """Metres from home on the ellipsoid, beside those on the sphere."""
    args = [F.lit(HOME[0]), F.lit(HOME[1]), col("lat"), col("lon")]
    return standin(spark, d, "cameras").select("id", F.round(geo.vincenty(*args), 2).alias("ellipsoid"), F.round(geo.haversine_6372800(*args), 2).alias("sphere"))


def vessel_approaches(spark: SparkSession, d: str) -> DataFrame:
    """Every vessel against own ship, which keeps 45 degrees at 12 knots."""
    df = standin(spark, d, "points").select("idx", F.lit(39.05).alias("lat"), F.lit(-75.45).alias("lon"), F.lit(45.0).alias("cog"), F.lit(12.0).alias("sog"), col("lat").alias("o_lat"), col("lon").alias("o_lon"), (col("idx") * 53 % 360).cast("double").alias("o_cog"), col("speed").alias("o_sog"))
    return L.vessel_approach(df).select("idx", r(col("hours"), 5).alias("hours"), r(col("miles"), 4).alias("miles"))


KINDS = tuple(L.VEHICLE)


def vehicle_values(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), (col("event_id") % len(KINDS)).cast("int"))
    return table(spark, d, "events").select("event_id", r(L.vehicle_value(kind, col("event_id") * 7 % 256, col("event_id") * 13 % 256), 4).alias("value"))


def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lengths, speeds and weights written with units."""
    n = col("p_size").cast("string")
    length = F.when(col("p_partkey") % 4 == 0, F.concat(n, F.lit("'6\""))).when(col("p_partkey") % 4 == 1, F.concat(n, F.lit(" km"))).when(col("p_partkey") % 4 == 2, F.concat(n, F.lit(" cm"))).otherwise(F.lit("high"))
    speed = F.when(col("p_partkey") % 2 == 0, F.concat(n, F.lit(" mph"))).otherwise(n)
    weight = F.when(col("p_partkey") % 2 == 0, F.concat(n, F.lit(" lbs"))).otherwise(F.concat(n, F.lit(".5")))
    return table(spark, d, "part").select("p_partkey", r(text.length_metres(length)).alias("metres"), r(text.speed_ms(speed)).alias("ms"), r(text.weight_tons(weight), 8).alias("tons"))


def degree_texts(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "cameras").select("id", text.degrees_text(col("lat"), "N", "S").alias("lat"), text.degrees_text(col("lon"), "E", "W").alias("lon"))


def short_links(spark: SparkSession, d: str) -> DataFrame:
    """Short links of places and back: the corner lies within a link's last digit of the place."""
    df = standin(spark, d, "cameras").withColumn("link", text.short_link(col("lat"), col("lon"), 16))
    df = df.withColumn("at", text.link_place(col("link")))
    near = (F.abs(col("at.lat") - col("lat")) < 0.00005) & (F.abs(col("at.lon") - col("lon")) < 0.0001)
    return df.select("id", big(F.length("link")).alias("n"), big(col("at.zoom")).alias("zoom"), near.alias("near"))


def class_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Metres and runs of each kind on a track, in classes that follow one another."""
    _, totals = L.class_lengths(standin(spark, d, "points").withColumn("metres", (col("idx") * 17 % 100).cast("double")), "track", "idx", "kind", "metres")
    return totals.select("track", "kind", "metres", big(col("runs")).alias("runs"))


def oldest_stamps(spark: SparkSession, d: str) -> DataFrame:
    """The oldest stamp of each kind and whether a day has passed since."""
    g = standin(spark, d, "points").groupBy("kind").agg(F.min("ms").alias("oldest"))
    return g.select("kind", "oldest", (F.lit(1_704_200_000_000) - col("oldest") > 86_400_000).alias("expired"))


def items_by_category(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(col("id") % 8 > 0, F.trim("vendor")).otherwise(F.lit("  "))
    df = standin(spark, d, "cameras").withColumn("category", F.trim(F.coalesce(c, F.lit(""))))
    return df.groupBy("category").agg(big(F.count(F.lit(1))).alias("n"), F.min("id").alias("first"))


def grouped_hits(spark: SparkSession, d: str) -> DataFrame:
    """Titles of a route in the language preferred: the base one, then English, then the first by name."""
    df = table(spark, d, "documents").select((col("doc_id") % 300).alias("route"), "lang", "doc_id")
    rank = F.when(col("lang") == "fr", 0).when(col("lang") == "en", 1).otherwise(2)
    g = df.where("lang is not null").groupBy("route").agg(F.min(F.struct(rank.alias("rank"), "lang", "doc_id")).alias("best"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return g.select("route", "best.lang", "best.doc_id", "langs")


def glide_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Metres flown to metres lost over the last hour; null where none are lost."""
    from fieldglass.operators.tracks import legs

    w = Window.partitionBy("track").orderBy("ms").rangeBetween(-3_600_000, 0)
    df = legs(standin(spark, d, "points"))
    lost = F.first("ele").over(w) - F.last("ele").over(w)
    return df.select("track", "idx", r(F.sum(F.coalesce("metres", F.lit(0.0))).over(w) / F.when(lost > F.lit(0.1), lost), 3).alias("ratio"))


def distances_between_times(spark: SparkSession, d: str) -> DataFrame:
    """Metres of the legs whose both ends lie strictly inside the middle of each track's time; 0 without one."""
    from fieldglass.operators.tracks import legs

    df = legs(standin(spark, d, "points")).withColumn("from_ms", F.lag("ms").over(Window.partitionBy("track").orderBy("idx")))
    spans = df.groupBy("track").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    spans = spans.select("track", (col("a") + F.floor((col("b") - col("a")) / 4)).alias("start"), (col("b") - F.floor((col("b") - col("a")) / 4)).alias("end"))
    inside = lambda c: (col(c) > col("start")) & (col(c) < col("end"))
    metres = F.coalesce(F.sum(F.when(inside("ms") & inside("from_ms"), col("metres"))), F.lit(0.0))
    return df.join(spans, "track").groupBy("track").agg(r(metres, 3).alias("metres"))


def transferred_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights of cameras from points on the same hundredth of a degree; the last point's wins."""
    q = lambda c: F.round(col(c) * 100).cast("long")
    known = standin(spark, d, "points").where("ele is not null").groupBy(q("lat").alias("qy"), q("lon").alias("qx")).agg(F.max_by("ele", "idx").alias("ele"))
    return standin(spark, d, "cameras").select("id", q("lat").alias("qy"), q("lon").alias("qx")).join(known, ["qy", "qx"], "left").select("id", "ele")


def nearest_places_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cameras within a kilometre of home: the cells of the circle, then the distance."""
    y, x = HOME
    high = 1000 / geo.METRES_PER_DEGREE
    df = standin(spark, d, "cameras").where(geo.cell(col("lat"), 0.01).between(int((y - high) // 0.01), int((y + high) // 0.01)) & geo.cell(col("lon"), 0.01).between(int((x - 2 * high) // 0.01), int((x + 2 * high) // 0.01)))
    away = geo.haversine_6372800(F.lit(y), F.lit(x), col("lat"), col("lon"))
    return df.select("id", F.round(away, 3).alias("metres")).where("metres <= 1000")


def packed_ranks(spark: SparkSession, d: str) -> DataFrame:
    """A rank of three keys in one number: matched words, then rating, then nearness, each cut to its bits."""
    capped = lambda c, bits: F.least(F.greatest(c, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    words = F.size(F.filter(F.split("name", " "), lambda w: w.isin("red", "ring", "small")))
    near = F.lit((1 << 14) - 1) - capped(col("id") * 31 % 20000, 14)
    key = F.shiftleft(capped(words, 4), 26) + F.shiftleft(capped(col("size") * 200, 12), 14) + near
    return standin(spark, d, "cameras").select("id", key.alias("rank"))


def travel_order(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin with the phrase first, then the others that hold it, each by name."""
    df = standin(spark, d, "cameras").where(F.lower("name").contains("re")).select("id", "name")
    return placed(df, [(~F.lower("name").startswith("re")).cast("int"), col("name"), col("id")])


def user_filters(spark: SparkSession, d: str) -> DataFrame:
    """Nations as filters with their categories; one without any has an empty list."""
    cats = table(spark, d, "supplier").where("s_nationkey % 4 > 0").select(col("s_nationkey").alias("n_nationkey"), (col("s_suppkey") % 3).alias("c")).distinct()
    g = cats.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("categories"))
    return table(spark, d, "nation").join(g, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("categories", F.lit("")).alias("categories"))


def article_family(spark: SparkSession, d: str) -> DataFrame:
    """Children, parent and siblings of an article, each once."""
    n, reg = table(spark, d, "nation").select("n_name", "n_regionkey"), table(spark, d, "region")
    own = n.where("n_name = 'FRANCE' or n_name like '%3'").select("n_regionkey").distinct()
    siblings = n.join(own, "n_regionkey", "left_semi").select(col("n_name").alias("title"))
    parents = reg.join(own, col("r_regionkey") == col("n_regionkey"), "left_semi").select(col("r_name").alias("title"))
    return siblings.union(parents).distinct()


def catalogue_usage(spark: SparkSession, d: str) -> DataFrame:
    """Two left joins with the condition on the right side inside the join, so that the left row stays."""
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation")
    j = n.join(s, col("n_nationkey") == col("s_nationkey"), "left").join(table(spark, d, "region"), col("n_regionkey") == col("r_regionkey"), "left")
    return j.groupBy("n_name", "r_name").agg(big(F.count("s_suppkey")).alias("n"))


def tag_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets with values added, taken away and looked for."""
    a, b = F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"), F.lit("red"))
    text_of = lambda c: F.array_join(F.array_sort(c), ",")
    return table(spark, d, "part").select("p_partkey", text_of(F.array_union(a, b)).alias("added"), text_of(F.array_except(a, F.array(F.lit("red")))).alias("taken"), F.arrays_overlap(a, b).alias("some"))


def palette_colours(spark: SparkSession, d: str) -> DataFrame:
    """A value between two colours, as red, green and blue; none is grey."""
    v = F.least(F.greatest(col("ele"), F.lit(0.0)), F.lit(100.0)) / F.lit(100.0)
    part = lambda lo, hi: F.coalesce((F.lit(float(lo)) + F.lit(float(hi - lo)) * v).cast("long"), F.lit(128).cast("long"))
    return standin(spark, d, "points").select("idx", part(0, 255).alias("red"), part(200, 20).alias("green"), part(50, 50).alias("blue"))


def nearest_index(spark: SparkSession, d: str) -> DataFrame:
    """The point of each track whose distance so far is nearest to 20 km; the first of equals."""
    from fieldglass.operators.tracks import legs

    off = F.round(F.abs(col("run") - F.lit(20000.0)), 3)
    return legs(standin(spark, d, "points")).groupBy("track").agg(F.min(F.struct(off.alias("off"), "idx")).alias("n")).select("track", "n.idx", "n.off")


def resampled_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights at every 10 km of a track, on the straight line between the points around; each leg answers for the steps inside it."""
    from fieldglass.operators.tracks import legs

    w = Window.partitionBy("track").orderBy("idx")
    df = legs(standin(spark, d, "points").where("ele is not null"))
    df = df.withColumn("r0", F.lag("run").over(w)).withColumn("e0", F.lag("ele").over(w)).where("run > r0")
    k = F.explode(F.sequence(F.ceil(col("r0") / 10000), F.greatest(F.ceil(col("run") / 10000) - 1, F.ceil(col("r0") / 10000) - 1), F.lit(1).cast("long")))
    inside = df.where("ceil(r0 / 10000) <= ceil(run / 10000) - 1").select("track", "r0", "run", "e0", "ele", k.alias("step"))
    height = col("e0") + (col("ele") - col("e0")) * (col("step") * F.lit(10000.0) - col("r0")) / (col("run") - col("r0"))
    return inside.select("track", big(col("step")).alias("step"), r(height, 3).alias("ele"))


QUERIES = {f.__name__: f for f in (
    track_filters, sorted_by_modes, sorted_groups, accepted_places, places_by_rating, unexpired_rows, vendor_classes, brand_places, moved_points, projected_points, cameras_along_path, cone_areas, tile_corners,
    boxes_around, albers_places, converted_units, ellipsoid_legs, vessel_approaches, vehicle_values, unit_texts, degree_texts, short_links, class_lengths, oldest_stamps, items_by_category, grouped_hits, glide_ratios,
    distances_between_times, transferred_heights, nearest_places_in_cells, packed_ranks, travel_order, user_filters, article_family, catalogue_usage, tag_sets, palette_colours, nearest_index, resampled_heights,
)}

D_TRACKS = f", k AS ({TRACKS.replace('AS STRING', 'AS VARCHAR')}), tracks AS (SELECT *, CAST(round({HAV.format(r=6372800, a='39.05::DOUBLE', b='(-75.45::DOUBLE)', c='lat', d='lon')}) AS BIGINT) AS metres_away FROM k)"
WAY = {"nearest": "metres_away ASC", "last_modified": "modified DESC"} | {f"{n}_{w}": f"{c} {'DESC' if (w == 'descending') != (n == 'date') else 'ASC'}" for n, c in (("name", "name"), ("value", "value"), ("date", "CASE WHEN created >= 10 THEN created END"), ("distance", "distance"), ("duration", "duration")) for w in ("ascending", "descending")}
Y, X = "39.05::DOUBLE", "(-75.45::DOUBLE)"
TO = f"(degrees(atan2(sin(radians({X} - lon)) * cos(radians({Y})), cos(radians(lat)) * sin(radians({Y})) - sin(radians(lat)) * cos(radians({Y})) * cos(radians({X} - lon)))) + 360) % 360"
DMS = "(t // 360000) || '°' || lpad(CAST((t // 6000) % 60 AS VARCHAR), 2, '0') || '''' || lpad(CAST((t // 100) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0') || '\"'"
ORTH = lambda a, b, c, d: (f"greatest(0, least(1, (({c} - {a}) * (lat - {a}) + ({d} - {b}) * (lon - {b})) / (({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b}))))")

ORACLE_SQL = {
    "track_filters": duck("points", D_TRACKS + " SELECT id, coalesce(created >= 10 AND created BETWEEN 1704100000000 AND 1704900000000, false) AS dated, contains(lower(name), 'cli') AS named, visible AND coalesce(waypoints, false) AS flagged FROM tracks"),
    "sorted_by_modes": duck("points", D_TRACKS + " " + " UNION ALL ".join(f"SELECT '{m}' AS mode, id, row_number() OVER (ORDER BY {w} NULLS LAST, name, id) AS place FROM tracks" for m, w in WAY.items())),
    "sorted_groups": duck("points", D_TRACKS + ", g AS (SELECT folder, CAST(sum(distance) AS BIGINT) AS distance, CAST(sum(duration) AS BIGINT) AS duration FROM tracks GROUP BY 1) SELECT *, row_number() OVER (ORDER BY distance DESC NULLS LAST, duration DESC, folder) AS place FROM g"),
    "accepted_places": duck("cameras", ", p AS (SELECT id, CASE WHEN lower(kind) IN ('small', 'economy', 'standard') THEN lower(kind) ELSE 'other' END AS c, lower(vendor) AS s FROM cameras) SELECT id FROM p WHERE c = 'small' OR (c = 'economy' AND s IN ('brand#2', 'brand#17')) OR (c = 'other' AND s = 'brand#4')"),
    "places_by_rating": duck("cameras", "SELECT id, CAST(size AS BIGINT) AS rating FROM cameras ORDER BY rating DESC, id LIMIT 1000"),
    "unexpired_rows": duck("points", "SELECT idx FROM points WHERE ms >= 1704400000000"),
    "vendor_classes": duck("cameras", ", v AS (SELECT CASE WHEN id % 9 > 0 THEN lower(vendor) ELSE '' END AS v FROM cameras) SELECT CASE WHEN contains(v, 'brand#1') THEN 'brand#1' WHEN v <> '' THEN 'other' ELSE 'untagged' END AS class, count(*) AS n FROM v GROUP BY 1"),
    "brand_places": duck("cameras", "SELECT id FROM cameras WHERE lower(vendor) = 'brand#4' AND kind = 'SMALL'"),
    "moved_points": duck("points", f""", a AS (SELECT idx, lat, lon, {TO} AS course, (idx * 37 % 360)::DOUBLE AS h, 1000 / 6378137.0::DOUBLE AS q FROM points), b AS (SELECT *, radians(lat) AS p1, radians(lat) + q * cos(radians(h)) AS p2, (course - h + 720) % 360 AS t,
 2 * asin(sqrt(pow(sin(radians(lat - {Y}) / 2), 2) + cos(radians(lat)) * cos(radians({Y})) * pow(sin(radians(lon - {X}) / 2), 2))) AS d FROM a),
 c AS (SELECT *, ln(tan(p2 / 2 + pi() / 4) / tan(p1 / 2 + pi() / 4)) AS psi, sin(0.75::DOUBLE * d) / sin(d) AS u, sin(0.25::DOUBLE * d) / sin(d) AS v FROM b),
 e AS (SELECT *, u * cos(p1) * cos(radians(lon)) + v * cos(radians({Y})) * cos(radians({X})) AS gx_, u * cos(p1) * sin(radians(lon)) + v * cos(radians({Y})) * sin(radians({X})) AS gy_, u * sin(p1) + v * sin(radians({Y})) AS gz,
  cos(radians({Y})) * cos(radians({X} - lon)) AS bx, cos(radians({Y})) * sin(radians({X} - lon)) AS b_y FROM c)
 SELECT idx, round(course, 6) AS course, round(CASE WHEN t > 180 THEN t - 360 ELSE t END, 6) AS turn, round(degrees(p2), 6) AS y, round(lon + degrees(q * sin(radians(h)) / CASE WHEN abs(psi) > 10e-12 THEN q * cos(radians(h)) / psi ELSE cos(p1) END), 6) AS x,
 round(degrees(atan2(gz, sqrt(gx_ * gx_ + gy_ * gy_))), 6) AS gy, round(degrees(atan2(gy_, gx_)), 6) AS gx, round(degrees(atan2(sin(p1) + sin(radians({Y})), sqrt(pow(cos(p1) + bx, 2) + b_y * b_y))), 6) AS my, round(lon + degrees(atan2(b_y, cos(p1) + bx)), 6) AS mx FROM e"""),
    "projected_points": duck("points", f", a AS (SELECT *, {ORTH('39.02::DOUBLE', '(-75.48::DOUBLE)', '39.07::DOUBLE', '(-75.41::DOUBLE)')} AS s FROM points), b AS (SELECT *, 39.02::DOUBLE + 0.05::DOUBLE * s AS py, -75.48::DOUBLE + 0.07::DOUBLE * s AS px FROM a) SELECT idx, round(s, 6) AS share, round({HAV.format(r=6372800, a='lat', b='lon', c='py', d='px')}, 3) AS metres FROM b"),
    "cameras_along_path": duck("cameras", ", l(leg, y1, x1, y2, x2) AS (VALUES " + ", ".join("(" + ", ".join([str(v[0]), *(f"{x}::DOUBLE" if x >= 0 else f"({x}::DOUBLE)" for x in v[1:])]) + ")" for v in LEG_ROWS) + f"), a AS (SELECT *, {ORTH('y1', 'x1', 'y2', 'x2')} AS s FROM cameras, l), b AS (SELECT *, y1 + (y2 - y1) * s AS py, x1 + (x2 - x1) * s AS px FROM a), c AS (SELECT id, leg, {HAV.format(r=6372800, a='lat', b='lon', c='py', d='px')} AS off FROM b) SELECT id, CAST(leg AS BIGINT) AS leg, round(off, 3) AS off FROM c WHERE off <= 250 QUALIFY row_number() OVER (PARTITION BY id ORDER BY off, leg) = 1"),
    "tile_corners": duck("cameras", ", t AS (SELECT id, CAST(floor((lon + 180) / 360 * 32768) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768) AS BIGINT) AS y FROM cameras) SELECT id, x, y, round(x / 32768.0::DOUBLE * 360 - 180, 8) AS west, round(degrees(atan((exp(pi() * (1 - 2 * y / 32768.0::DOUBLE)) - exp(-pi() * (1 - 2 * y / 32768.0::DOUBLE))) / 2)), 8) AS north FROM t"),
    "boxes_around": duck("cameras", ", b AS (SELECT id, lat, lon, degrees(size * 100 / 6372800.0::DOUBLE) AS h FROM cameras) SELECT id, round(lat - h, 6) AS south, round(lon - h / cos(radians(lat)), 6) AS west, round(lat + h, 6) AS north, round(lon + h / cos(radians(lat)), 6) AS east FROM b"),
    "albers_places": duck("cameras", ", n AS (SELECT (sin(radians(29.5::DOUBLE)) + sin(radians(45.5::DOUBLE))) / 2 AS n), c AS (SELECT n, pow(cos(radians(29.5::DOUBLE)), 2) + 2 * n * sin(radians(29.5::DOUBLE)) AS c FROM n) SELECT id, round(sqrt(c - 2 * n * sin(radians(lat))) / n * sin(n * radians(lon + 96)), 9) AS x, round(sqrt(c - 2 * n * sin(radians(37.5::DOUBLE))) / n - sqrt(c - 2 * n * sin(radians(lat))) / n * cos(n * radians(lon + 96)), 9) AS y FROM cameras, c"),
    "converted_units": "SELECT p_partkey, round(p_retailprice / 1609.344::DOUBLE, 6) AS miles, round(p_retailprice / 1.852::DOUBLE, 6) AS knots, round(p_retailprice / 0.45359237::DOUBLE, 6) AS pounds, round(p_retailprice * 6400 / 360.0::DOUBLE, 6) AS mils, round(p_retailprice * 1.8::DOUBLE + 32, 6) AS fahrenheit FROM part",
    "vessel_approaches": duck("points", """, a AS (SELECT idx, (lon + 75.45::DOUBLE) * 60 * cos(radians(39.05::DOUBLE)) AS dx, (lat - 39.05::DOUBLE) * 60 AS dy, speed * sin(radians(idx * 53 % 360)) - 12 * sin(radians(45)) AS vx, speed * cos(radians(idx * 53 % 360)) - 12 * cos(radians(45)) AS vy FROM points),
 b AS (SELECT *, CASE WHEN vx * vx + vy * vy >= 1e-10 THEN -(dx * vx + dy * vy) / (vx * vx + vy * vy) END AS h FROM a), c AS (SELECT *, CASE WHEN h >= 0 THEN h END AS hours FROM b) SELECT idx, round(hours, 5) AS hours, round(sqrt(pow(dx + vx * hours, 2) + pow(dy + vy * hours, 2)), 4) AS miles FROM c"""),
    "vehicle_values": "WITH e AS (SELECT event_id, event_id * 7 % 256 AS a, event_id * 13 % 256 AS b FROM events) SELECT event_id, round(CAST(CASE event_id % 8 WHEN 0 THEN floor((a * 256 + b) / 4) WHEN 1 THEN a * 256 + b WHEN 2 THEN a WHEN 3 THEN a - 40 WHEN 4 THEN a * 3 WHEN 5 THEN a * 100.0::DOUBLE / 255.0::DOUBLE WHEN 6 THEN (a * 256 + b) / 1000.0::DOUBLE ELSE (a * 256 + b) / 20.0::DOUBLE END AS DOUBLE), 4) AS value FROM e",
    "unit_texts": "SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 0.3048::DOUBLE + 6 * 0.0254::DOUBLE WHEN 1 THEN p_size * 1000.0::DOUBLE WHEN 2 THEN p_size * 0.01::DOUBLE END, 6) AS metres, round(p_size / 3.6::DOUBLE * CASE WHEN p_partkey % 2 = 0 THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END, 6) AS ms, round(CASE WHEN p_partkey % 2 = 0 THEN p_size * 0.4535::DOUBLE / 1000 ELSE p_size + 0.5::DOUBLE END, 8) AS tons FROM part",
    "degree_texts": duck("cameras", f", a AS (SELECT id, CAST(round(abs(lat) * 360000) AS BIGINT) AS t, CAST(round(abs(lon) * 360000) AS BIGINT) AS u FROM cameras) SELECT id, {DMS} || 'N' AS lat, {DMS.replace('t //', 'u //').replace('t %', 'u %')} || 'W' AS lon FROM a"),
    "short_links": duck("cameras", "SELECT id, 8::BIGINT AS n, 16::BIGINT AS zoom, true AS near FROM cameras"),
    "class_lengths": duck("points", ", a AS (SELECT track, idx, kind, (idx * 17 % 100)::DOUBLE AS m, CASE WHEN kind <> lag(kind) OVER (PARTITION BY track ORDER BY idx) THEN 1 ELSE 0 END AS new FROM points), b AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY idx) AS i FROM a) SELECT track, kind, sum(m) AS metres, count(DISTINCT i) AS runs FROM b GROUP BY 1, 2"),
    "oldest_stamps": duck("points", "SELECT kind, min(ms) AS oldest, 1704200000000 - min(ms) > 86400000 AS expired FROM points GROUP BY 1"),
    "items_by_category": duck("cameras", "SELECT CASE WHEN id % 8 > 0 THEN trim(vendor) ELSE '' END AS category, count(*) AS n, min(id) AS first FROM cameras GROUP BY 1"),
    "grouped_hits": "WITH a AS (SELECT doc_id % 300 AS route, lang, doc_id, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS k FROM documents WHERE lang IS NOT NULL), l AS (SELECT route, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM a GROUP BY 1) SELECT route, lang, doc_id, langs FROM a JOIN l USING (route) QUALIFY row_number() OVER (PARTITION BY route ORDER BY k, lang, doc_id) = 1",
    "glide_ratios": duck("points", LEGS + ", a AS (SELECT track, idx, sum(coalesce(metres, 0)) OVER w AS m, first_value(ele) OVER w - last_value(ele) OVER w AS lost FROM legs WINDOW w AS (PARTITION BY track ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)) SELECT track, idx, round(m / CASE WHEN lost > 0.1::DOUBLE THEN lost END, 3) AS ratio FROM a"),
    "distances_between_times": duck("points", LEGS + ", s AS (SELECT track, min(ms) + (max(ms) - min(ms)) // 4 AS a, max(ms) - (max(ms) - min(ms)) // 4 AS b FROM points GROUP BY 1) SELECT track, round(coalesce(sum(CASE WHEN ms > a AND ms < b AND pms > a AND pms < b THEN metres END), 0), 3) AS metres FROM legs JOIN s USING (track) GROUP BY 1"),
    "transferred_heights": duck("cameras points", ", k AS (SELECT CAST(round(lat * 100) AS BIGINT) AS qy, CAST(round(lon * 100) AS BIGINT) AS qx, arg_max(ele, idx) AS ele FROM points WHERE ele IS NOT NULL GROUP BY 1, 2) SELECT id, k.ele FROM cameras LEFT JOIN k ON qy = CAST(round(lat * 100) AS BIGINT) AND qx = CAST(round(lon * 100) AS BIGINT)"),
    "nearest_places_in_cells": duck("cameras", f", a AS (SELECT id, round({HAV.format(r=6372800, a=Y, b=X, c='lat', d='lon')}, 3) AS metres FROM cameras) SELECT * FROM a WHERE metres <= 1000"),
    "packed_ranks": duck("cameras", "SELECT id, (CAST(len(list_filter(string_split(name, ' '), lambda w: w IN ('red', 'ring', 'small'))) AS BIGINT) << 26) + (CAST(least(size * 200, 4095) AS BIGINT) << 14) + 16383 - least(id * 31 % 20000, 16383) AS rank FROM cameras"),
    "travel_order": duck("cameras", "SELECT id, name, row_number() OVER (ORDER BY CASE WHEN lower(name) LIKE 're%' THEN 0 ELSE 1 END, name, id) AS place FROM cameras WHERE contains(lower(name), 're')"),
    "user_filters": "WITH c AS (SELECT DISTINCT s_nationkey AS n_nationkey, s_suppkey % 3 AS c FROM supplier WHERE s_nationkey % 4 > 0), g AS (SELECT n_nationkey, array_to_string(list_sort(list(c)), ',') AS categories FROM c GROUP BY 1) SELECT n_nationkey, n_name, coalesce(categories, '') AS categories FROM nation LEFT JOIN g USING (n_nationkey)",
    "article_family": "WITH o AS (SELECT DISTINCT n_regionkey FROM nation WHERE n_name = 'FRANCE' OR n_name LIKE '%3') SELECT n_name AS title FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM o) UNION SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM o)",
    "catalogue_usage": "SELECT n_name, r_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "tag_sets": "WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, [lower(p_type), 'red'] AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS added, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x <> 'red'))), ',') AS taken, list_has_any(a, b) AS some FROM p",
    "palette_colours": duck("points", ", v AS (SELECT idx, least(greatest(ele, 0), 100) / 100.0::DOUBLE AS v FROM points) SELECT idx, coalesce(CAST(trunc(255 * v) AS BIGINT), 128) AS red, coalesce(CAST(trunc(200.0::DOUBLE + -180.0::DOUBLE * v) AS BIGINT), 128) AS green, CASE WHEN v IS NULL THEN 128 ELSE 50 END::BIGINT AS blue FROM v"),
    "nearest_index": duck("points", LEGS + ", a AS (SELECT track, idx, round(abs(run - 20000), 3) AS off FROM legs) SELECT track, idx, off FROM a QUALIFY row_number() OVER (PARTITION BY track ORDER BY off, idx) = 1"),
    "resampled_heights": duck("points", LEGS.replace("FROM points", "FROM (SELECT * FROM points WHERE ele IS NOT NULL) points") + ", a AS (SELECT track, run, ele, lag(run) OVER w AS r0, lag(ele) OVER w AS e0 FROM legs WINDOW w AS (PARTITION BY track ORDER BY idx)), k AS (SELECT *, unnest(range(CAST(ceil(r0 / 10000) AS BIGINT), CAST(ceil(run / 10000) AS BIGINT))) AS step FROM a WHERE run > r0) SELECT track, step, round(e0 + (ele - e0) * (step * 10000.0::DOUBLE - r0) / (run - r0), 3) AS ele FROM k"),
    "cone_areas": None, "ellipsoid_legs": None,
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
