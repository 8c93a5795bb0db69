"""Registered queries of scans and sinks: whole tables are written in a format of the study and read back by its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.operators.staging import scratch_path
from fieldglass.plans.standins import duck, standin, table
from fieldglass.sources import markup, readers

col, lit = F.col, F.lit


def _written(df: DataFrame, name: str, form: str = "text", partition: str | None = None, **options: str) -> str:
    path = scratch_path(df.sparkSession, name)
    writer = df.write.format(form).options(**options)
    (writer.partitionBy(partition) if partition else writer).save(path)
    return path


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", col("s_acctbal").cast("double").alias("s_acctbal"))
    path = _written(df, "csv", "csv", header="true")
    return readers.csv_table(spark, path, "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")


def padded_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated text with padded headers; balances of every seventh row do not parse."""
    balance = F.when(col("s_suppkey") % 7 == 0, "n/a").otherwise(col("s_acctbal").cast("double").cast("string"))
    df = table(spark, d, "supplier").select(col("s_suppkey").cast("string").alias("KEY "), balance.alias("BALANCE   "))
    got = readers.padded_table(spark, _written(df, "padded", "csv", header="true", sep="\t"), ["BALANCE"])
    return got.select(col("KEY").cast("long").alias("s_suppkey"), col("BALANCE").alias("balance"))


def place_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pipe-separated rows; only places with the prefix stay."""
    geo_id = F.concat(F.when(col("c_custkey") % 4 > 0, readers.PLACE_PREFIX).otherwise("0500000US"), col("c_custkey").cast("string"))
    df = table(spark, d, "customer").select(geo_id.alias("GEO_ID"), col("c_acctbal").cast("double").alias("B01"))
    return readers.place_table(spark, _written(df, "places", "csv", header="true", sep="|"), {"income": "B01"})


def gzip_scan(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return readers.gzip_lines(spark, _written(df, "lines", "json", compression="gzip", maxRecordsPerFile="250000"), "event_id long, user_id long, event_type string")


def _xml(df: DataFrame, name: str, row: str, root: str = "osm") -> str:
    return _written(df, name, "xml", rowTag=row, rootTag=root)


def _camera_element() -> list[Column]:
    """A camera as a node of a map file."""
    tag = lambda k, c: F.struct(lit(k).alias("_k"), c.alias("_v"))
    tags = F.filter(F.array(tag("brand", col("vendor")), tag("Direction", col("direction"))), lambda t: t["_v"].isNotNull())
    return [col("id").alias("_id"), col("lat").alias("_lat"), col("lon").alias("_lon"), tags.alias("tag")]


def map_nodes_scan(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of map files, with keys of tags in lower case."""
    got = markup.osm_objects(spark, _xml(standin(spark, d, "cameras").select(*_camera_element()), "nodes", "node"), "node")
    return got.select("id", "lat", "lon", col("tags")["brand"].alias("vendor"), col("tags")["direction"].alias("direction"))


def map_ways_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ways over the parts of their lines, in order; length and ends of each."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    ways = lines.select(col("l_orderkey").alias("_id"), F.transform("p", lambda p: F.struct(p["l_partkey"].alias("_ref"))).alias("nd"))
    got = markup.osm_objects(spark, _xml(ways, "ways", "way"), "way")
    return got.select("id", F.size("nodes").cast("long").alias("n"), F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"))


def map_changes_scan(spark: SparkSession, d: str) -> DataFrame:
    """Cameras as created, modified and deleted nodes, a folder an action."""
    path = scratch_path(spark, "changes")
    for i, action in enumerate(markup.ACTIONS):
        rows = standin(spark, d, "cameras").where(col("id") % 3 == i).select(F.array(F.struct(*_camera_element())).alias("node"))
        rows.write.format("xml").options(rowTag=action, rootTag="osmChange").save(f"{path}/{action}")
    return markup.osm_changes(spark, f"{path}/*").select("action", "kind", "id", "lat", "lon")


def placemark_scan(spark: SparkSession, d: str) -> DataFrame:
    """Points, lines and tracks of placemarks: kind, number of points, first point."""
    at = lambda sep: F.concat(col("lon").cast("string"), lit(sep), col("lat").cast("string"), lit(sep), col("size").cast("string"))
    kind = col("id") % 3
    point = F.when(kind == 0, F.struct(at(",").alias("coordinates"))).alias("Point")
    line = F.when(kind == 1, F.struct(F.concat(at(","), lit(" "), at(",")).alias("coordinates"))).alias("LineString")
    track = F.when(kind == 2, F.struct(F.array(lit("2024-01-01T00:00:00Z")).alias("when"), F.array(at(" ")).alias("coord"))).alias("Track")
    rows = standin(spark, d, "cameras").select(col("id").cast("string").alias("name"), point, line, track)
    got = markup.kml_places(spark, _xml(rows, "placemarks", "Placemark", "kml"))
    p = F.element_at("points", 1)
    return got.select(col("name").cast("long").alias("id"), "kind", F.size("points").cast("long").alias("n"), p["lat"].alias("lat"), p["lon"].alias("lon"), p["ele"].alias("ele"), F.element_at("ms", 1).alias("ms"))


def polygon_scan(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around cameras, written as features and read back."""
    b = geo.box_around(col("lat"), col("lon"), lit(1000.0))
    corner = lambda x, y: F.struct(col(f"b.{x}").alias("lon"), col(f"b.{y}").alias("lat"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))
    df = standin(spark, d, "cameras").withColumn("b", b).select(markup.geojson_text(col("id"), ring).alias("value"))
    got = readers.geojson_polygons(spark, _written(df, "polygons"), lines=True)
    outer = F.element_at("rings", 1)
    edge = lambda f, i: F.round(f(F.transform(outer, lambda p: F.get(p, lit(i)))), 6)
    return got.select(col("id").cast("long").alias("id"), F.size(outer).cast("long").alias("n"), edge(F.array_min, 1).alias("south"), edge(F.array_max, 0).alias("east"))


TILES = 16


def _tile_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Answers of sixteen tiles; every fifth camera is in the next tile, too, by another brand."""
    df = standin(spark, d, "cameras").withColumn("tile", col("id") % TILES)
    again = df.where(col("id") % 5 == 0).withColumn("tile", col("tile") + 1).withColumn("vendor", lit("other"))
    return df.unionByName(again).withColumn("stamp", F.concat(lit("2024-01-"), F.lpad((col("tile") * 7 % 28 + 1).cast("string"), 2, "0")))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    tags = F.map_filter(F.create_map(lit("brand"), "vendor", lit("direction"), "direction", lit("name"), "name"), lambda _, v: v.isNotNull())
    element = F.struct(lit("node").alias("type"), "id", "lat", "lon", tags.alias("tags"))
    answers = _tile_nodes(spark, d).groupBy("tile").agg(F.min("stamp").alias("stamp"), F.collect_list(element).alias("elements"))
    text = F.to_json(F.struct(F.struct(col("stamp").alias("timestamp_osm_base")).alias("osm3s"), "elements"))
    path = _written(answers.select("tile", text.alias("value")), "answers", partition="tile")
    return markup.camera_snapshot(readers.overpass_nodes(spark, path, tile="tile"))


def camera_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Cameras of all tiles' answers, once each, with the oldest stamp."""
    return _snapshot(spark, d).select("id", "lat", "lon", col("tags")["brand"].alias("vendor"), F.size(F.map_keys("tags")).cast("long").alias("n"), "stamp")


def camera_pack_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "packs")
    markup.write_packs(_snapshot(spark, d), path, 0.01)
    return markup.read_packs(spark, path)


def region_additions(spark: SparkSession, d: str) -> DataFrame:
    """New ids of each region, in the order in which regions are merged."""
    return readers.new_ids(_tile_nodes(spark, d).select("tile", "id"), "tile").select(col("tile").alias("region"), "n", "new")


QUERIES = {f.__name__: f for f in (
    csv_scan, padded_scan, place_scan, gzip_scan, map_nodes_scan, map_ways_scan, map_changes_scan, placemark_scan, polygon_scan, camera_snapshot, camera_pack_scan, region_additions
)}

D_TILES = f", t AS (SELECT *, id % {TILES} AS tile FROM cameras UNION ALL SELECT * REPLACE ('other' AS vendor), id % {TILES} + 1 AS tile FROM cameras WHERE id % 5 = 0)"
H = "degrees(1000 / 6372800.0::DOUBLE)"
ORACLE_SQL = {
    "csv_scan": "SELECT s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier",
    "padded_scan": "SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier WHERE s_suppkey % 7 > 0",
    "place_scan": "SELECT CAST(c_custkey AS VARCHAR) AS place, CAST(c_acctbal AS DOUBLE) AS income FROM customer WHERE c_custkey % 4 > 0",
    "gzip_scan": "SELECT event_id, user_id, event_type FROM events",
    "map_nodes_scan": duck("cameras", "SELECT id, lat, lon, vendor, direction FROM cameras"),
    "map_ways_scan": "SELECT l_orderkey AS id, count(*) AS n, min(l_linenumber::BIGINT * 1000000000 + l_partkey) % 1000000000 AS first, max(l_linenumber::BIGINT * 1000000000 + l_partkey) % 1000000000 AS last FROM lineitem GROUP BY 1",
    "map_changes_scan": duck("cameras", "SELECT CASE id % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' ELSE 'delete' END AS action, 'node' AS kind, id, lat, lon FROM cameras"),
    "placemark_scan": duck("cameras", "SELECT id, CASE id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'track' END AS kind, CASE id % 3 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS n, lat, lon, CAST(size AS DOUBLE) AS ele, CASE id % 3 WHEN 2 THEN 1704067200000 END AS ms FROM cameras"),
    "polygon_scan": duck("cameras", f"SELECT id, 5::BIGINT AS n, round(lat - {H}, 6) AS south, round(lon + {H} / cos(radians(lat)), 6) AS east FROM cameras"),
    "camera_snapshot": duck("cameras", "SELECT id, lat, lon, CASE WHEN id % 5 = 0 THEN 'other' ELSE vendor END AS vendor, CASE WHEN direction IS NULL THEN 1 ELSE 2 END::BIGINT AS n, '2024-01-01' AS stamp FROM cameras"),
    "camera_pack_scan": duck("cameras", "SELECT round(lat, 5) AS lat, round(lon, 5) AS lon, coalesce(direction, '') AS direction FROM cameras"),
    "region_additions": duck("cameras", D_TILES + ", f AS (SELECT id, min(tile) AS tile FROM t GROUP BY 1) SELECT tile AS region, count(*) AS n, CAST(sum(CASE WHEN tile = (SELECT min(u.tile) FROM t u WHERE u.id = t.id) THEN 1 ELSE 0 END) AS BIGINT) AS new FROM t GROUP BY 1"),
}
