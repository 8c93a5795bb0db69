"""Readers and writers of study inputs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACE_PREFIX = "1400000US"


def csv_table(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header by explicit schema; an empty string is null, a malformed field too."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding, nullValue="", mode="PERMISSIVE")


def padded_table(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """Tab-separated latin-1 text with padded headers; rows whose numbers do not parse drop out."""
    df = spark.read.csv(path, header=True, sep="\t", encoding="ISO-8859-1")
    df = df.select([F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])
    df = df.select([F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in numbers else F.col(c) for c in df.columns])
    return df.dropna(subset=numbers)


def place_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Pipe-separated rows of places with the prefix, which is stripped; columns maps new names to those of the file."""
    df = spark.read.csv(path, header=True, sep="|")
    if missing := [c for c in columns.values() if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    df = df.where(F.col("GEO_ID").startswith(PLACE_PREFIX))
    place = F.substring("GEO_ID", len(PLACE_PREFIX) + 1, 100).alias("place")
    return df.select(place, *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(n) for n, c in columns.items()])


#: Compressed bytes of a gzip file that are decoded at once, and those by which what precedes damage is found.
GZIP_PIECE, GZIP_STEP = 1 << 14, 1 << 8


def inflated(data: bytes) -> Iterator[bytes]:
    """What a gzip file of several members holds, piece by piece, up to where it is cut or corrupt."""
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while at < len(view) and not z.eof:
            piece, before = view[at : at + GZIP_PIECE], z.copy()
            try:
                yield z.decompress(piece)
            except zlib.error:
                # What came before the damage can still be decoded.
                try:
                    for i in range(0, len(piece), GZIP_STEP):
                        yield before.decompress(piece[i : i + GZIP_STEP])
                except zlib.error:
                    pass
                return
            at += len(piece) - len(z.unused_data)


def salvaged(data: bytes) -> Iterator[list[str]]:
    """Whole lines of a gzip file of several members that may be cut or corrupt anywhere; few at a time, never none."""
    rest = []
    for piece in inflated(data):
        end = piece.rfind(b"\n") + 1
        if end:
            yield [x.decode("utf-8", "replace") for x in b"".join([*rest, piece[:end]]).splitlines()]
            rest = []
        rest.append(piece[end:])


def gzip_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of gzip files that may be empty, have several members and a cut tail; lines that do not parse drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for lines in salvaged(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return raw.select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


OVERPASS = "osm3s struct<timestamp_osm_base:string>, remark string, elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>>>"


def overpass_nodes(spark: SparkSession, path: str, tile: str | None = None) -> DataFrame:
    """Nodes of query answers, with the partition column `tile` if the folder has one; an answer that reports a time-out or a runtime error fails the read instead of looking empty."""
    df = spark.read.schema(OVERPASS).json(path, multiLine=True)
    bad = F.coalesce(F.lower("remark").rlike("timed out|runtime error"), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("the answer is not complete: "), F.col("remark")))).otherwise(F.col("elements"))
    kept = [tile] if tile else []
    return df.select(*kept, F.col("osm3s.timestamp_osm_base").alias("stamp"), F.explode(checked.cast("array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>>>")).alias("e")).where("e.type = 'node'").select(*kept, "stamp", "e.id", "e.lat", "e.lon", "e.tags")


def merged_regions(regions: list[DataFrame], key: str = "id") -> DataFrame:
    """Union by key; of rows with one key the later region's stays."""
    tagged = [r.withColumn("region_", F.lit(i)) for i, r in enumerate(regions)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return last_by_key(out, [key], "region_").drop("region_")


def new_ids(rows: DataFrame, region: str, key: str = "id") -> DataFrame:
    """region, n, new: rows of each region, and those whose key no earlier region has."""
    first = rows.groupBy(key).agg(F.min(region).alias("first_"))
    seen = rows.groupBy(region, key).agg(F.count(F.lit(1)).alias("n_")).join(first, key)
    return seen.groupBy(region).agg(F.sum("n_").alias("n"), F.sum((F.col("first_") == F.col(region)).cast("long")).alias("new"))


def geojson_polygons(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id and rings (outer and inner, of every polygon) of Polygon and MultiPolygon features.

    A document is a collection, one feature, or a bare geometry: a whole file, or with `lines` one of its lines.
    """
    geometry = "struct<type:string,coordinates:string>"
    feature = f"struct<id:string,geometry:{geometry}>"
    df = spark.read.schema(f"id string, type string, coordinates string, geometry {geometry}, features array<{feature}>").json(path, multiLine=not lines)
    bare = F.struct("type", "coordinates").cast(geometry)
    one_feature = F.array(F.struct(F.col("id"), F.coalesce("geometry", bare).alias("geometry")).cast(feature))
    df = df.select(F.explode(F.coalesce("features", one_feature)).alias("f"))
    g = F.col("f.geometry.coordinates")
    many = F.from_json(g, "array<array<array<array<double>>>>")
    one = F.from_json(g, "array<array<array<double>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(many)).when(F.col("f.geometry.type") == "Polygon", one)
    return df.select(F.col("f.id").alias("id"), rings.alias("rings")).where("rings is not null")


def gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """file, track, seg, idx, lat, lon, ele, ms of GPX files."""
    import xml.etree.ElementTree as ET

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "track", "seg", "idx", "lat", "lon", "ele", "ms"]
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    root = ET.fromstring(data)
                except ET.ParseError:
                    continue
                tag = lambda e: e.tag.rpartition("}")[2]
                for t, trk in enumerate(e for e in root if tag(e) == "trk"):
                    for s, seg in enumerate(e for e in trk if tag(e) == "trkseg"):
                        for i, p in enumerate(e for e in seg if tag(e) == "trkpt"):
                            sub = {tag(c): c.text for c in p}
                            ms = pd.Timestamp(sub["time"]).value // 10**6 if sub.get("time") else 0
                            rows.append((name, t, s, i, float(p.get("lat")), float(p.get("lon")), float(sub["ele"]) if sub.get("ele") else None, ms))
                yield pd.DataFrame(rows, columns=names)

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gpx").load(path).select("path", "content")
    return raw.mapInPandas(run, "file string, track int, seg int, idx int, lat double, lon double, ele double, ms long")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changed rows replaced and new ones added."""
    return table.join(changes, keys, "left_anti").unionByName(changes)
