"""Map and place files: OSM XML and its changes, KML, GeoJSON text, camera snapshots and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import geo

# The tags that a camera snapshot keeps.
KEPT_TAGS = ("direction", "camera:direction", "operator", "brand", "manufacturer")

OBJECT = "_id long, _lat double, _lon double, nd array<struct<_ref:long>>, member array<struct<_type:string,_ref:long,_role:string>>, tag array<struct<_k:string,_v:string>>"
NESTED = "struct<" + OBJECT.replace(" array", ":array").replace(" long", ":long").replace(" double", ":double") + ">"
ACTIONS = ("create", "modify", "delete")
KINDS = ("node", "way", "relation")


def tag_map(tags: Column) -> Column:
    """Keys in lower case; of keys that differ in case alone the last counts. Empty without tags."""
    pairs = F.transform(F.coalesce(tags, F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(F.lower(t["_k"]).alias("key"), t["_v"].alias("value")))
    last = F.filter(pairs, lambda p, i: p["key"].isNotNull() & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def _fields(o: str) -> list[Column]:
    at = lambda c: F.col(f"{o}.{c}" if o else c)
    return [at("_id").alias("id"), at("_lat").alias("lat"), at("_lon").alias("lon"), tag_map(at("tag")).alias("tags"), F.transform(at("nd"), lambda n: n["_ref"]).alias("nodes"), at("member").alias("members")]


def osm_objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """id, lat, lon, tags, nodes, members of the nodes, ways or relations of OSM XML files; files are split between elements."""
    return spark.read.format("xml").option("rowTag", kind).schema(OBJECT).load(path).select(*_fields(""))


def osm_changes(spark: SparkSession, path: str) -> DataFrame:
    """action and kind, then the columns of osm_objects, for every object of osmChange files."""
    out = None
    for action in ACTIONS:
        rows = spark.read.format("xml").option("rowTag", action).schema(", ".join(f"{k} array<{NESTED}>" for k in KINDS)).load(path)
        for kind in KINDS:
            found = rows.select(F.explode(kind).alias("o")).select(F.lit(action).alias("action"), F.lit(kind).alias("kind"), *_fields("o"))
            out = found if out is None else out.unionByName(found)
    return out


PLACEMARK = "name string, Point struct<coordinates:string>, LineString struct<coordinates:string>, Track struct<when:array<string>,coord:array<string>>"


def kml_places(spark: SparkSession, path: str) -> DataFrame:
    """name, kind (point, line or track), points array<struct<lon, lat, ele>> and ms of KML placemarks.

    A track with times (its own element, whatever the namespace) has one time a point; others have none.
    Points whose numbers do not parse drop out; a placemark without a shape does, too.
    """
    df = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true").schema(PLACEMARK).load(path)

    def points(texts: Column, sep: str) -> Column:
        part = lambda t, i: F.get(F.split(t, sep), F.lit(i)).try_cast("double")
        each = F.transform(texts, lambda t: F.struct(part(t, 0).alias("lon"), part(t, 1).alias("lat"), part(t, 2).alias("ele")))
        return F.filter(each, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())

    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    kind = F.when(F.col("Point").isNotNull(), "point").when(F.col("LineString").isNotNull(), "line").when(F.col("Track").isNotNull(), "track")
    shape = F.when(F.col("Point").isNotNull(), points(words(F.col("Point.coordinates")), ",")).when(F.col("LineString").isNotNull(), points(words(F.col("LineString.coordinates")), ",")).otherwise(points(F.col("Track.coord"), r"\s+"))
    ms = F.transform(F.col("Track.when"), lambda t: F.unix_millis(F.to_timestamp(t)))
    return df.select("name", kind.alias("kind"), shape.alias("points"), ms.alias("ms")).where("kind is not null")


def geojson_text(name: Column, ring: Column) -> Column:
    """A feature collection of one polygon, as text; ring is an array<struct<lon, lat>>."""
    at = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(at).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), name.cast("string").alias("id"), geometry.alias("geometry"))
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))


def camera_snapshot(nodes: DataFrame) -> DataFrame:
    """id, lat, lon, tags, stamp: nodes (tile, stamp, id, lat, lon, tags) of all tiles, the last tile's of each id, five tags, and the oldest stamp of all.

    Nodes without a place drop out; a tag without a value, too.
    """
    here = nodes.where("lat is not null and lon is not null")
    rows = here.groupBy("id").agg(F.max_by(F.struct("lat", "lon", "tags"), "tile").alias("n"))
    slim = F.map_filter(F.col("n.tags"), lambda k, v: k.isin(*KEPT_TAGS) & (F.coalesce(v, F.lit("")) != ""))
    oldest = nodes.agg(F.coalesce(F.min(F.nullif("stamp", F.lit(""))), F.lit("unknown")).alias("stamp"))
    return rows.select("id", "n.lat", "n.lon", F.coalesce(slim, F.create_map().cast("map<string,string>")).alias("tags")).join(F.broadcast(oldest))


def write_packs(snapshot: DataFrame, path: str, degrees: float = 1.0) -> None:
    """Gzip JSON, one document a line: version, count, and [lat, lon, direction as written] to five places, of each cell of a grid."""
    direction = F.coalesce(F.nullif(F.col("tags")["direction"], F.lit("")), F.col("tags")["camera:direction"], F.lit(""))
    five = lambda c: F.round(c, 5).cast("string")
    item = F.concat(F.lit("["), five("lat"), F.lit(","), five("lon"), F.lit(","), F.substr(F.to_json(F.array(direction)), F.lit(2)))
    cells = snapshot.groupBy(geo.cell(F.col("lat"), degrees), geo.cell(F.col("lon"), degrees)).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(item)), ",").alias("cams"))
    text = F.concat(F.lit('{"v":1,"count":'), F.col("n").cast("string"), F.lit(',"cams":['), F.col("cams"), F.lit("]}"))
    cells.select(text.alias("value")).write.option("compression", "gzip").text(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, direction of packs; further fields are ignored, documents that do not parse and items without a place drop out."""
    df = spark.read.text(path).select(F.from_json("value", "cams array<array<string>>").alias("r"))
    cams = df.select(F.explode("r.cams").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    return cams.select(at(0).try_cast("double").alias("lat"), at(1).try_cast("double").alias("lon"), F.coalesce(at(2), F.lit("")).alias("direction")).where("lat is not null and lon is not null")
