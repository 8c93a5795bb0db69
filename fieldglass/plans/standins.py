"""The driver's tables as mobility data, by integer hashes that DuckDB computes alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Two prime moduli, so that latitude and longitude vary independently; points lie off the cameras.
LAT = "CAST(39 AS DOUBLE) + CAST(({k} * 7919) % 997 AS DOUBLE) / CAST(10000 AS DOUBLE)"
LON = "CAST(-75.5 AS DOUBLE) + CAST(({k} * 104729) % 1009 AS DOUBLE) / CAST(10000 AS DOUBLE)"
P_LAT = "CAST(39.00013 AS DOUBLE) + CAST(({k} * 6151) % 991 AS DOUBLE) / CAST(10000 AS DOUBLE)"
P_LON = "CAST(-75.49979 AS DOUBLE) + CAST(({k} * 92821) % 1013 AS DOUBLE) / CAST(10000 AS DOUBLE)"

CAMERAS = f"""SELECT p_partkey AS id, {LAT.format(k='p_partkey')} AS lat, {LON.format(k='p_partkey')} AS lon,
 p_brand AS vendor, p_type AS kind, p_name AS name, p_size AS size,
 CASE WHEN p_partkey % 17 = 0 THEN concat(CAST(p_partkey * 37 % 360 AS STRING), '-', CAST((p_partkey * 37 + 70) % 360 AS STRING))
  WHEN p_partkey % 10 = 0 THEN concat(CAST(p_partkey * 37 % 180 AS STRING), ';', CAST(p_partkey * 37 % 180 + 180 AS STRING))
  WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 'NE' ELSE CAST(p_partkey * 37 % 360 AS STRING) END AS direction
 FROM part"""
POINTS = f"""SELECT user_id AS track, event_id AS idx, {{ms}} AS ms, {P_LAT.format(k='event_id')} AS lat, {P_LON.format(k='event_id')} AS lon,
 value AS ele, CAST(event_id * 31 % 200 AS DOUBLE) / CAST(10 AS DOUBLE) AS speed, event_type AS kind FROM events"""
FLOWS = """SELECT o_custkey AS h, l_suppkey AS w, sum(l_quantity) AS workers FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 WHERE o_custkey <> l_suppkey GROUP BY o_custkey, l_suppkey"""
# One row a commute: an order, with its lines as what is passed and its quantities as kilometres.
RESULTS = """SELECT o_orderkey AS id, c_nationkey AS state, o_custkey AS h, c_mktsegment AS area, c_acctbal AS income,
 count(*) AS base_cameras, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS avoid_cameras,
 sum(l_quantity) AS base_km, sum(l_quantity) + sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END) AS avoid_km
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
 GROUP BY o_orderkey, c_nationkey, o_custkey, c_mktsegment, c_acctbal"""

SPARK = {"cameras": CAMERAS, "points": POINTS.format(ms="timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"), "flows": FLOWS, "results": RESULTS}
DUCK = {k: v.replace("AS STRING", "AS VARCHAR") for k, v in SPARK.items()} | {"points": POINTS.format(ms="(epoch_us(ts) // 1000)")}
SOURCES = {"cameras": ["part"], "points": ["events"], "flows": ["orders", "lineitem"], "results": ["orders", "lineitem", "customer"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str, hint: str | None = None) -> DataFrame:
    """A stand-in table; its sources are passed by name, so no view is registered. A hint says how they are joined, where packed files look small enough to broadcast."""
    text = SPARK[name]
    tables = {t: table(spark, sf_dir, t) for t in SOURCES[name]}
    return spark.sql(_bound(text, SOURCES[name]), **{t: df.hint(hint) if hint else df for t, df in tables.items()})


def _bound(text: str, names: list[str]) -> str:
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return text


def duck(names: str, rest: str) -> str:
    """DuckDB text: the named stand-ins as common table expressions, then `rest` (further ones begin with a comma)."""
    return "WITH " + ", ".join(f"{n} AS ({DUCK[n]})" for n in names.split()) + " " + rest
