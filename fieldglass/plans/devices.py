"""Registered queries of names and places as text, opening hours, vessels, vehicles, map ids, hulls and slopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions import geo, matching, text
from fieldglass.operators import devices as D
from fieldglass.operators.search import placed
from fieldglass.plans import library
from fieldglass.plans.mobility import HAV, LEGS
from fieldglass.plans.standins import duck, standin, table

col, lit = F.col, F.lit
big = lambda c: c.cast("long")
r = lambda c, n=6: F.round(c, n)

WORDS = {"starts": "RE", "word_starts": "ri", "later_word_starts": "re", "word_equals": "ring", "contains": "in", "equals": "small.", "query_holds_word": "a big red ring"}


def matched_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name by the seven modes of matching; first words alone by the last, hyphens for some spaces."""
    n = F.when(col("p_partkey") % 2 == 0, F.replace(col("p_name"), lit(" "), lit("-"))).otherwise(col("p_name"))
    of = lambda m: F.substring_index("p_name", " ", 1) if m == "query_holds_word" else n
    return table(spark, d, "part").select("p_partkey", *[matching.matches(of(m), q, m).alias(m) for m, q in WORDS.items()])


def house_numbers(spark: SparkSession, d: str) -> DataFrame:
    sep = F.element_at(F.array(*map(lit, ("", "-", "/", " "))), (col("s_suppkey") % 4 + 1).cast("int"))
    name = F.when(col("s_suppkey") % 9 == 0, "#").otherwise(F.concat(col("s_suppkey").cast("string"), sep, lit("B")))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(matching.house_number_parts(name), "|").alias("parts"))


def route_tag_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the routes in a place's tags, with their refs; a gap in the numbers gives an empty one."""
    size = col("p_size").cast("string")
    tags = F.create_map(lit("route_hiking_1"), lit(""), lit("route_hiking_1_ref"), size, lit("highway"), lit("path"))
    third = F.create_map(lit("route_hiking_3"), lit(""), lit("route_hiking_3_ref"), lit("x"))
    cycle = F.create_map(lit("route_bicycle_1"), lit(""), lit("route_bicycle_1_ref"), col("p_name"), lit("route_bicycle_2_ref"), lit("lost"))
    tags = F.map_concat(tags, F.when(col("p_partkey") % 3 == 0, third).otherwise(F.create_map().cast("map<string,string>")), F.when(col("p_partkey") % 2 == 0, cycle).otherwise(F.create_map().cast("map<string,string>")))
    found = table(spark, d, "part").select("p_partkey", F.explode(matching.route_keys(tags)).alias("k"))
    return found.select("p_partkey", "k.type", big(col("k.n")).alias("n"), col("k.tags")["ref"].alias("ref"))


def coordinate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Places written in five ways and read back; the last of them is no place."""
    y, x, which = col("lat"), col("lon"), col("id") % 5
    dms = F.concat(text.degrees_text(y, "N", "S"), lit(" "), text.degrees_text(x, "E", "W"))
    minutes = lambda v: F.concat(F.floor(F.abs(v)).cast("string"), lit("° "), F.round((F.abs(v) - F.floor(F.abs(v))) * 60, 4).cast("string"), lit("'"))
    dm = F.concat(minutes(x), lit("W "), minutes(y), lit("N"))
    comma = F.concat_ws("; ", F.replace(y.cast("string"), lit("."), lit(",")), F.replace(x.cast("string"), lit("."), lit(",")))
    written = F.when(which == 0, F.concat_ws(", ", y.cast("string"), x.cast("string"))).when(which == 1, dms).when(which == 2, dm).when(which == 3, comma).otherwise(F.concat(lit("near "), y.cast("string")))
    p = matching.place(written)
    return standin(spark, d, "cameras").select("id", r(p["lat"], 4).alias("lat"), r(p["lon"], 4).alias("lon"))


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    y, x = col("lat").cast("string"), col("lon").cast("string")
    forms = [("geo:{y},{x}?z=14"), ("https://example.org/maps/@{y},{x},14z"), ("https://example.org/#map=14/{y}/{x}"), ("https://yandex.example/?ll={x}%2C{y}&z=14"), ("https://example.org/?ll={y},{x}"), ("https://example.org/about")]
    links = [reduce(lambda c, kv: F.replace(c, lit(kv[0]), kv[1]), (("{y}", y), ("{x}", x)), lit(f)) for f in forms]
    p = matching.link_target(F.get(F.array(*links), (col("id") % len(forms)).cast("int")))
    return standin(spark, d, "cameras").select("id", p["lat"].alias("lat"), p["lon"].alias("lon"), p["zoom"].alias("zoom"))


HOURS = ("Mo-Fr 08:00-18:00; Sa 10:00-14:00", "24/7", "Fr-Su 20:00-02:00", "Sa,Su off; Mo off; We-Fr 9:00-12:00, 13:00-17:00", "by appointment")


def _time() -> tuple[Column, Column]:
    """Day and minute at which a place is looked at."""
    return col("p_partkey") % 7, col("p_partkey") * 37 % 1440


def _hours() -> Column:
    return F.get(F.array(*map(lit, HOURS)), (col("p_partkey") % len(HOURS)).cast("int"))


def open_places(spark: SparkSession, d: str) -> DataFrame:
    """Whether a place is open at a time, unknown where its hours do not parse."""
    return table(spark, d, "part").select("p_partkey", matching.is_open(_hours(), *_time()).alias("open"))


def conditional_tags(spark: SparkSession, d: str) -> DataFrame:
    """Access of roads, closed to some at the hours that a condition names."""
    condition = F.concat(lit("destination @ (Sa-Su 00:00-24:00); no @ ("), _hours(), lit(")"))
    return table(spark, d, "part").select("p_partkey", matching.conditional_value(lit("yes"), condition, *_time()).alias("access"))


def _vessels(spark: SparkSession, d: str) -> DataFrame:
    i = col("idx")
    return standin(spark, d, "points").select(
        "idx", "ms", "lat", "lon", F.when(i % 4 > 0, i * 7 % 100).alias("kind"), F.array((i % 30).cast("int"), F.when(i % 2 == 0, 18).otherwise(5)).alias("messages"), (i % 31).alias("aid"), (i * 3 % 16).alias("status"),
        F.when(i % 6 > 0, col("speed") / 20).alias("knots"), F.when(i % 5 > 0, (i * 37 % 360).cast("double")).alias("course"),
    )


def vessel_states(spark: SparkSession, d: str) -> DataFrame:
    """Class, and whether a vessel can move, is at rest, and is lost."""
    df = _vessels(spark, d).withColumn("class", D.vessel_class(col("kind"), col("messages"), col("aid"), col("status")))
    seen = (col("messages"), col("status"), col("knots"), col("course"))
    age = col("idx") * 1000 % 600_000
    return df.select("idx", "class", D.is_movable(col("class"), col("knots")).alias("movable"), D.is_at_rest(col("class"), *seen).alias("rests"), D.is_lost(col("class"), *seen, age).alias("lost"))


def reckoned_vessels(spark: SparkSession, d: str) -> DataFrame:
    """Where vessels are ten minutes later."""
    y, x = D.reckoned(col("lat"), col("lon"), col("knots"), col("course"), lit(600.0))
    return _vessels(spark, d).select("idx", r(y).alias("y"), r(x).alias("x"))


def approach_alerts(spark: SparkSession, d: str) -> DataFrame:
    own = {"lat": 39.05, "lon": -75.45, "cog": 45.0, "sog": 12.0}
    other = [col("lat").alias("o_lat"), col("lon").alias("o_lon"), (col("idx") * 53 % 360).cast("double").alias("o_cog"), col("speed").alias("o_sog")]
    pairs = standin(spark, d, "points").select("idx", *[lit(v).alias(k) for k, v in own.items()], *other)
    return D.approach_alerts(pairs, 1.0, 0.5).select("idx", "miles")


def fuel_rates(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth point of a track as an accepted level, with the metres since the last."""
    from fieldglass.operators.tracks import legs

    k = F.row_number().over(Window.partitionBy("track").orderBy("idx"))
    df = legs(standin(spark, d, "points")).withColumn("k", k).where("k % 5 = 1")
    w = Window.partitionBy("track").orderBy("idx")
    levels = df.select("track", "idx", "ms", (lit(100.0) - (col("idx") * 7 % 100)).alias("level"), (col("run") - F.lag("run").over(w)).alias("metres"))
    got = D.fuel_rates(levels, "track")
    return got.select("track", "ms", "level", *[r(col(c), 4).alias(c) for c in ("percent_hour", "litres_hour", "litres_100km", "metres_litre", "metres_left", "litres_left")])


def sliding_values(spark: SparkSession, d: str) -> DataFrame:
    got = D.sliding_values(standin(spark, d, "points"), ["track", "kind"], "ms", "speed", 36 * 3_600_000)
    return got.select("idx", r(col("mean")).alias("mean"), big(col("n")).alias("n"))


def accepted_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of vehicles that five equal readings confirm."""
    return D.debounced_levels(standin(spark, d, "points").select("track", "ms", big(F.floor(col("speed") / 14)).alias("level")), "track", 2)


def map_ids(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(lit("node"), lit("way"), lit("relation")), (col("p_partkey") % 3 + 1).cast("int"))
    of = D.map_id(col("p_partkey"), kind)
    return table(spark, d, "part").select("p_partkey", of.alias("map_id"), D.osm_id(of).alias("osm_id"))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    """Squares of eleven sizes, each a little apart by its id, so that no two share a side: whether a ring that touches another lies in it is not defined."""
    half = (col("id") % 11 * 100 + 100) / lit(100_000.0) + col("id") * lit(1e-9)
    corner = lambda sx, sy: F.struct((col("lon") + half * sx).alias("lon"), (col("lat") + half * sy).alias("lat"))
    return standin(spark, d, "cameras").select("id", "lat", "lon", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"))


def contained_regions(spark: SparkSession, d: str) -> DataFrame:
    return D.contained_regions(_squares(spark, d), 0.01)


def track_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Corners and area of the hull of each track's points."""
    got = D.convex_hulls(standin(spark, d, "points").select("track", "lon", "lat"), "track")
    return got.select("track", big(F.size("ring") - 1).alias("corners"), F.round(geo.ring_area(col("ring")) * lit(1e8), 2).alias("area"))


def slope_classes(spark: SparkSession, d: str) -> DataFrame:
    """Steps of each class of slope, from heights (in centimetres here) one step before and after."""
    w = Window.partitionBy("track").orderBy("step")
    slope = (F.lead("ele").over(w) - F.lag("ele").over(w)) * lit(1000.0) / lit(200.0)
    df = library.resampled_heights(spark, d).select("track", D.slope_class(r(slope, 3)).alias("class"))
    return df.groupBy("class").agg(F.count(lit(1)).alias("n"))


def organized_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Orders by year and month, keyed by the start of each; those without a date are at 0."""
    when = F.when(col("o_orderkey") % 50 > 0, col("o_orderdate").cast("timestamp"))
    start = lambda u: F.coalesce(F.unix_millis(F.date_trunc(u, when)), lit(0))
    return table(spark, d, "orders").groupBy(start("year").alias("year"), start("month").alias("month")).agg(F.count(lit(1)).alias("n"))


def tag_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of key and value, how often they occur and among how many kinds of places."""
    tags = F.create_map(lit("brand"), col("vendor"), lit("size"), (col("size") % 10).cast("string"))
    pairs = standin(spark, d, "cameras").select("kind", F.explode(tags).alias("key", "value"))
    return pairs.groupBy("key", "value", "kind").agg(F.count(lit(1)).alias("n")).groupBy("key", "value").agg(F.sum("n").alias("n"), F.count(lit(1)).alias("kinds"))


def sorted_markers(spark: SparkSession, d: str) -> DataFrame:
    """The place of every marker by name and by distance, both ways."""
    away = geo.haversine_6372800(lit(library.HOME[0]), lit(library.HOME[1]), col("lat"), col("lon"))
    df = standin(spark, d, "cameras").select("id", "name", big(F.round(away)).alias("metres"))
    orders = {"name_up": col("name").asc(), "name_down": col("name").desc(), "near": col("metres").asc(), "far": col("metres").desc()}
    return reduce(DataFrame.unionByName, [placed(df, [o, col("id")]).select(lit(m).alias("mode"), "id", "place") for m, o in orders.items()])


def buffered_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a user that are at most two days older than the newest one."""
    newest = F.max("ms").over(Window.partitionBy("track"))
    return standin(spark, d, "points").withColumn("newest", newest).where(col("ms") >= col("newest") - 2 * 86_400_000).select("idx")


QUERIES = {f.__name__: f for f in (
    matched_names, house_numbers, route_tag_keys, coordinate_texts, link_targets, open_places, conditional_tags, vessel_states, reckoned_vessels, approach_alerts, fuel_rates, sliding_values, accepted_levels, map_ids,
    contained_regions, track_hulls, slope_classes, organized_by_year, tag_frequencies, sorted_markers, buffered_messages,
)}

# Whether the hours of HOURS hold: d the day, m the minute, k the form.
OPEN = """CASE k WHEN 0 THEN (d <= 4 AND m >= 480 AND m < 1080) OR (d = 5 AND m >= 600 AND m < 840) WHEN 1 THEN true WHEN 2 THEN (d >= 4 AND m >= 1200) OR (d IN (5, 6, 0) AND m < 120)
 WHEN 3 THEN d IN (2, 3, 4) AND ((m >= 540 AND m < 720) OR (m >= 780 AND m < 1020)) END"""
TIMES = "WITH t AS (SELECT p_partkey, p_partkey % 5 AS k, p_partkey % 7 AS d, p_partkey * 37 % 1440 AS m FROM part)"
FAST, TRADE = "kind BETWEEN 20 AND 29 OR kind BETWEEN 40 AND 49", "kind BETWEEN 30 AND 34 OR kind IN (50, 52, 53, 54, 56, 57, 59)"
VESSELS = f""", v AS (SELECT * EXCLUDE (kind), CASE WHEN idx % 4 > 0 THEN idx * 7 % 100 END AS kind, idx % 30 AS m1, CASE WHEN idx % 2 = 0 THEN 18 ELSE 5 END AS m2, idx % 31 AS aid, idx * 3 % 16 AS status, CASE WHEN idx % 6 > 0 THEN speed / 20 END AS knots,
 CASE WHEN idx % 5 > 0 THEN (idx * 37 % 360)::DOUBLE END AS course FROM points), c AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN m1 = 9 THEN 'airplane' WHEN m1 = 4 THEN 'land_station' WHEN m1 = 21 THEN CASE WHEN aid IN (29, 30) THEN 'virtual_aid' ELSE 'aid' END
 WHEN 18 IN (m1, m2) THEN 'vessel' WHEN status IN (0, 1, 2, 3, 4, 5, 6, 8, 11, 12) THEN 'vessel' WHEN status = 7 THEN 'commercial' WHEN status = 14 THEN 'beacon' ELSE 'invalid' END WHEN {FAST} THEN 'fast' WHEN {TRADE} THEN 'commercial'
 WHEN kind IN (35, 55) THEN 'authorities' WHEN kind IN (51, 58) THEN 'rescue' WHEN kind IN (36, 37) THEN 'sport' WHEN kind BETWEEN 60 AND 69 THEN 'passenger' WHEN kind BETWEEN 70 AND 89 THEN 'freight' ELSE 'other' END AS class FROM v),
 s AS (SELECT *, class NOT IN ('airplane', 'land_station', 'virtual_aid', 'aid', 'beacon', 'invalid') AS ship, coalesce(knots < 0.4, false) AS slow FROM c),
 q AS (SELECT *, ship OR class = 'airplane' OR (class = 'invalid' AND coalesce(knots > 0, false)) AS movable, ship AND CASE WHEN status IN (1, 5) THEN course IS NULL OR slow ELSE slow AND (m1 IN (1, 3, 18, 24) OR m2 = 18) END AS rests FROM s)"""
NAME = "CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_name END"  # without hyphens
ORACLE_SQL = {
    "matched_names": f"""WITH n AS (SELECT p_partkey, lower(p_name) AS a, lower({NAME}) AS b, split_part(lower(p_name), ' ', 1) AS f FROM part) SELECT p_partkey, a LIKE 're%' AS starts, a LIKE 'ri%' OR a LIKE '% ri%' AS word_starts, a LIKE '% re%' AS later_word_starts,
 contains(' ' || a || ' ', ' ring ') OR b = 'ring' AS word_equals, a LIKE '%in%' OR b LIKE '%in%' AS contains, a LIKE 'small%' AS equals, f IN ('a', 'big', 'red', 'ring') AS query_holds_word FROM n""",
    "house_numbers": "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN '#' ELSE s_suppkey || '|b' END AS parts FROM supplier",
    "route_tag_keys": """SELECT p_partkey, 'hiking' AS type, 1::BIGINT AS n, CAST(p_size AS VARCHAR) AS ref FROM part UNION ALL SELECT p_partkey, 'hiking', n, CASE n WHEN 3 THEN 'x' END FROM part, (VALUES (2::BIGINT), (3::BIGINT)) v(n) WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey, 'bicycle', 1, p_name FROM part WHERE p_partkey % 2 = 0""",
    "coordinate_texts": duck("cameras", "SELECT id, CASE WHEN id % 5 < 4 THEN round(lat, 4) END AS lat, CASE WHEN id % 5 < 4 THEN round(lon, 4) END AS lon FROM cameras"),
    "link_targets": duck("cameras", "SELECT id, CASE WHEN id % 6 < 5 THEN lat END AS lat, CASE WHEN id % 6 < 5 THEN lon END AS lon, CASE WHEN id % 6 < 4 THEN 14 WHEN id % 6 = 4 THEN 0 END::DOUBLE AS zoom FROM cameras"),
    "open_places": f"{TIMES} SELECT p_partkey, {OPEN} AS open FROM t",
    "conditional_tags": f"{TIMES} SELECT p_partkey, CASE WHEN coalesce({OPEN}, false) THEN 'no' WHEN d >= 5 THEN 'destination' ELSE 'yes' END AS access FROM t",
    "vessel_states": duck("points", VESSELS + " SELECT idx, class, movable, rests, (idx * 1000 % 600000) // 60000 > 4 AND movable AND NOT rests AS lost FROM q"),
    "reckoned_vessels": duck("points", VESSELS + """, a AS (SELECT idx, lat, lon, course, knots, radians(lat) AS p1, knots * 1852 / 3600 * 600 / 6378137.0::DOUBLE AS q, radians(course) AS c FROM v),
 b AS (SELECT *, p1 + q * cos(c) AS p2, ln(tan((p1 + q * cos(c)) / 2 + pi() / 4) / tan(p1 / 2 + pi() / 4)) AS psi FROM a) SELECT idx, round(CASE WHEN q IS NULL OR c IS NULL THEN lat ELSE degrees(p2) END, 6) AS y,
 round(CASE WHEN q IS NULL OR c IS NULL THEN lon ELSE lon + degrees(q * sin(c) / CASE WHEN abs(psi) > 10e-12 THEN q * cos(c) / psi ELSE cos(p1) END) END, 6) AS x FROM b"""),
    "approach_alerts": "WITH a AS (" + library.ORACLE_SQL["vessel_approaches"] + ") SELECT idx, miles FROM a WHERE miles <= 1 AND hours <= 0.5",
    "fuel_rates": duck("points", LEGS + """, k AS (SELECT track, idx, ms, run, 100.0::DOUBLE - idx * 7 % 100 AS level FROM legs QUALIFY row_number() OVER (PARTITION BY track ORDER BY idx) % 5 = 1),
 l AS (SELECT *, run - lag(run) OVER (PARTITION BY track ORDER BY idx) AS metres FROM k), u AS (SELECT *, lag(level) OVER (PARTITION BY track ORDER BY ms) - level AS used, ms - lag(ms) OVER (PARTITION BY track ORDER BY ms) AS gap FROM l),
 h AS (SELECT *, used / CASE WHEN gap <> 0 THEN gap END * 3.6e6::DOUBLE AS hourly, CASE WHEN used > 0 AND metres > 0 THEN metres END AS driven, 52 * used / 100 AS litres FROM u)
 SELECT track, ms, level, round(hourly, 4) AS percent_hour, CASE WHEN 0.52 * hourly <= 100 THEN round(52.0::DOUBLE * hourly / 100, 4) END AS litres_hour, CASE WHEN litres * 100000 / driven <= 100 THEN round(litres * 100 / (driven / 1000), 4) END AS litres_100km,
 CASE WHEN driven / litres <= 1000 THEN round(driven / litres, 4) END AS metres_litre, round(level * driven / used, 4) AS metres_left, round(52.0::DOUBLE * level / 100, 4) AS litres_left FROM h"""),
    "sliding_values": duck("points", "SELECT idx, round(avg(speed) OVER w, 6) AS mean, count(speed) OVER w AS n FROM points WINDOW w AS (PARTITION BY track, kind ORDER BY ms RANGE BETWEEN 129600000 PRECEDING AND CURRENT ROW)"),
    "map_ids": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 2 WHEN 1 THEN p_partkey * 2 + 1 ELSE 4398046511104 + p_partkey * 2048 END AS map_id, p_partkey AS osm_id FROM part",
    "contained_regions": duck("cameras", """, b AS (SELECT id, lat - ((id % 11 * 100 + 100) / 100000.0::DOUBLE + id * 1e-9::DOUBLE) AS s, lat + ((id % 11 * 100 + 100) / 100000.0::DOUBLE + id * 1e-9::DOUBLE) AS n, lon - ((id % 11 * 100 + 100) / 100000.0::DOUBLE + id * 1e-9::DOUBLE) AS w, lon + ((id % 11 * 100 + 100) / 100000.0::DOUBLE + id * 1e-9::DOUBLE) AS e FROM cameras)
 SELECT a.id AS inner, b.id AS outer FROM b a JOIN b ON a.id <> b.id AND a.s > b.s AND a.n < b.n AND a.w > b.w AND a.e < b.e"""),
    "slope_classes": "WITH h AS (" + library.ORACLE_SQL["resampled_heights"] + "), s AS (SELECT round((lead(ele) OVER w - lag(ele) OVER w) * 5.0::DOUBLE, 3) AS p FROM h WINDOW w AS (PARTITION BY track ORDER BY step)) SELECT CASE WHEN p IS NULL THEN NULL WHEN p <= -101 THEN 0 WHEN p > 20 THEN 12 WHEN p <= -20 THEN 1 ELSE CAST(ceil((p + 20) / 4) AS INT) + 1 END AS class, count(*) AS n FROM s GROUP BY 1",
    "organized_by_year": "WITH a AS (SELECT CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS t FROM orders) SELECT coalesce(epoch_us(date_trunc('year', t)::TIMESTAMP) // 1000, 0) AS year, coalesce(epoch_us(date_trunc('month', t)::TIMESTAMP) // 1000, 0) AS month, count(*) AS n FROM a GROUP BY 1, 2",
    "tag_frequencies": duck("cameras", ", t AS (SELECT 'brand' AS key, vendor AS value, kind FROM cameras UNION ALL SELECT 'size', CAST(size % 10 AS VARCHAR), kind FROM cameras) SELECT key, value, count(*) AS n, count(DISTINCT kind) AS kinds FROM t GROUP BY 1, 2"),
    "sorted_markers": duck("cameras", f", m AS (SELECT id, name, CAST(round({HAV.format(r=6372800, a=library.Y, b=library.X, c='lat', d='lon')}) AS BIGINT) AS metres FROM cameras) " + " UNION ALL ".join(f"SELECT '{n}' AS mode, id, row_number() OVER (ORDER BY {o}, id) AS place FROM m" for n, o in (("name_up", "name"), ("name_down", "name DESC"), ("near", "metres"), ("far", "metres DESC")))),
    "buffered_messages": duck("points", "SELECT idx FROM points QUALIFY ms >= max(ms) OVER (PARTITION BY track) - 172800000"),
}
