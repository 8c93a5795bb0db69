"""Registered search, place, graph and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions import geo, text
from fieldglass.operators import graph as G
from fieldglass.operators import search as S
from fieldglass.plans.mobility import HAV
from fieldglass.plans.standins import duck, standin, table

big = lambda c: c.cast("long")


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(standin(spark, d, "cameras"), "id", "name").groupBy("token").agg(big(F.count(F.lit(1))).alias("n"))


def all_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.with_all_terms(S.postings(standin(spark, d, "cameras"), "id", "name"), "id", "sm ri")


def ranked_lookup(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select(F.col("p_brand").alias("code"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    return S.ranked_lookup(df, "code", "name", "brand#1").select("code", "name", big(F.col("rank")).alias("rank"))


def nearest_camera(spark: SparkSession, d: str) -> DataFrame:
    near = S.nearest(standin(spark, d, "points"), standin(spark, d, "cameras"), ["idx"], 300.0)
    return near.select("idx", F.round("metres", 3).alias("metres"))


def widened_search(spark: SparkSession, d: str) -> DataFrame:
    return S.widened(standin(spark, d, "cameras"), 39.05, -75.45).select("id", F.round("metres", 3).alias("metres"), "radius")


def faceted_places(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "cameras").withColumn("tags", F.concat_ws(";", "vendor", "kind"))
    return df.where(S.facets({"tags": ["Brand#11", "Brand#12"], "kind": ["economy", "small"]}) & F.lower("name").contains("r")).select("id")


def history_rank(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "points")
    return S.decayed(df, "track", F.col("speed"), F.col("idx").cast("double"), 50).select("track", F.round("rank", 6).alias("rank"))


def longer_history_rank(spark: SparkSession, d: str) -> DataFrame:
    """As history_rank, with the reference's limit of 1,500."""
    df = standin(spark, d, "points")
    return S.decayed(df, "track", F.col("speed"), F.col("idx").cast("double"), 1500).select("track", F.round("rank", 6).alias("rank"))


def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "cameras").groupBy("vendor").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), big(F.count_distinct("kind")).alias("n"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "cameras").withColumn("x", geo.tile_x(F.col("lon"), 15)).withColumn("y", geo.tile_y(F.col("lat"), 15))
    return df.select("id", "x", "y", geo.morton(F.col("x"), F.col("y")).alias("code"))


def tile_extents(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "cameras").withColumn("zoom", (F.col("id") % 3 + 12).cast("int"))
    x = F.coalesce(*[F.when(F.col("zoom") == z, geo.tile_x(F.col("lon"), z)) for z in (12, 13, 14)])
    wide = F.expr("shiftleft(x, 25 - zoom)")
    return df.withColumn("x", x).groupBy("vendor").agg(F.min(wide).alias("lo"), F.max(wide).alias("hi"))


def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes that overlap, each reported in the cell of the larger of their lower corners."""
    from fieldglass.operators.cameras import in_cells

    box = standin(spark, d, "cameras").select("id", *[(F.col(c) + F.lit(s)).alias(n) for c, s, n in (("lat", -0.0004, "y0"), ("lat", 0.0004, "y1"), ("lon", -0.0004, "x0"), ("lon", 0.0004, "x1"))])
    cells = in_cells(box, *(F.col(c) for c in ("y0", "y1", "x0", "x1")))
    other = cells.select("cy", "cx", *[F.col(c).alias(f"o_{c}") for c in ("id", "y0", "y1", "x0", "x1")])
    hit = (F.col("id") < F.col("o_id")) & (F.col("y0") <= F.col("o_y1")) & (F.col("o_y0") <= F.col("y1")) & (F.col("x0") <= F.col("o_x1")) & (F.col("o_x0") <= F.col("x1"))
    own = (geo.cell(F.greatest("y0", "o_y0"), 0.001) == F.col("cy")) & (geo.cell(F.greatest("x0", "o_x0"), 0.001) == F.col("cx"))
    return cells.join(other, ["cy", "cx"]).where(hit & own).select("id", "o_id")


def box_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(overlapping_boxes(spark, d), "id", "o_id").select("node", "component")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as nodes: one-way edges of small integer seconds; every third is watched."""
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    n = F.lit(97)
    out = df.select("src", F.explode(F.array(*[F.struct(((F.col("src") * m + k) % n).alias("dst"), F.lit(float(s)).alias("seconds")) for m, k, s in ((2, 1, 5), (3, 2, 7), (1, 1, 2))])).alias("e"))
    return out.select((F.col("src") % n).alias("src"), "e.dst", "e.seconds", ((F.col("src") + F.col("e.dst")) % 3 == 0).alias("watched")).distinct()


def routes(spark: SparkSession, d: str, multiplier: float = 1.0) -> DataFrame:
    e = edges(spark, d).select("src", "dst", G.edge_cost(F.col("seconds"), F.col("watched"), multiplier).alias("cost"))
    return G.least_costs(e, spark.range(0, 3).select(F.col("id").alias("node")), 1000.0)


def least_cost_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes(spark, d)


def avoiding_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes(spark, d, 0.1)


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts (even nodes) and suppliers (odd nodes) by their whole keys: an edge each way where a line has both; every third is watched."""
    df = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    df = df.select((p * 2).alias("a"), (s * 2 + 1).alias("b"), ((p * 7 + s * 3) % 9 + 2).cast("double").alias("seconds"), ((p + s) % 3 == 0).alias("watched"))
    return df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "seconds", "watched"))


def supply_routes(spark: SparkSession, d: str, multiplier: float = 1.0) -> DataFrame:
    e = supply_edges(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), G.edge_cost(F.col("seconds"), F.col("watched"), multiplier).alias("cost"))
    return G.least_costs(e, spark.range(1, 4).select((F.col("id") * 2).alias("node")), 30.0)


def avoiding_supply_routes(spark: SparkSession, d: str) -> DataFrame:
    return supply_routes(spark, d, 0.1)


def routing_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules over part attributes: the first that holds decides."""
    rules = [(F.col("p_size") > 40, F.lit(0.0)), (F.col("p_brand") == "Brand#11", F.lit(0.3)), (F.col("p_retailprice") >= 1500, F.lit(0.5)), (F.col("p_size").between(10, 20), F.lit(0.8))]
    return table(spark, d, "part").select("p_partkey", G.first_match(rules, F.lit(1.0)).alias("priority"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.concat((k % 24).cast("string"), F.lit(":30:15"))).when(k % 4 == 1, (k % 90).cast("string")).when(k % 4 == 2, F.concat((k % 7).cast("string"), F.lit(":05"))).otherwise(F.lit("x"))
    return table(spark, d, "orders").select("o_orderkey", text.interval_seconds(t).alias("seconds"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"))


def latest_merged(spark: SparkSession, d: str) -> DataFrame:
    """Latest object of each key, a new message overwriting valid fields only."""
    df = standin(spark, d, "points").withColumn("speed", F.when(F.col("idx") % 4 != 0, F.col("speed")))
    at = F.struct("ms", "idx")
    return df.groupBy("track").agg(F.max("ms").alias("ms"), F.max_by("lat", at).alias("lat"), F.max_by("speed", F.when(F.col("speed").isNotNull(), at)).alias("speed"))


def tiered_results(spark: SparkSession, d: str) -> DataFrame:
    return S.visibility_tiers(standin(spark, d, "cameras"), ["size", "id"]).select("id", big(F.col("level")).alias("level"))


def all_tiered_results(spark: SparkSession, d: str) -> DataFrame:
    return S.visible_levels(standin(spark, d, "cameras"), ["size"]).select("id", big(F.col("level")).alias("level"))


def page_of_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey").offset(200).limit(100)


def article_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of key sets."""
    a, b = table(spark, d, "nation").select("n_regionkey"), table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"))
    tag = lambda df, t: df.withColumn("op", F.lit(t))
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "both")).union(tag(b.subtract(a), "rest"))


QUERIES = {f.__name__: f for f in (
    term_frequencies, all_terms, ranked_lookup, nearest_camera, widened_search, faceted_places, history_rank, distinct_names, tiles, tile_extents, overlapping_boxes, box_components,
    least_cost_routes, avoiding_routes, routing_rules, intervals, page_links, latest_merged, tiered_results, page_of_items, article_sets,
    longer_history_rank, all_tiered_results, supply_routes, avoiding_supply_routes,
)}

DIST = lambda a, b: HAV.format(r=6372800, a=a, b=b, c="lat", d="lon")
EDGES = """WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey % 97 AS src, (s_suppkey * m + k) % 97 AS dst, s AS seconds, (s_suppkey + (s_suppkey * m + k) % 97) % 3 = 0 AS watched
 FROM supplier, (VALUES (2, 1, 5.0::DOUBLE), (3, 2, 7.0::DOUBLE), (1, 1, 2.0::DOUBLE)) v(m, k, s)), c AS (SELECT src, dst, min(seconds / CASE WHEN watched THEN {m}::DOUBLE ELSE 1.0::DOUBLE END) AS cost FROM e GROUP BY 1, 2),
 w AS (SELECT i AS source, i AS node, 0.0::DOUBLE AS cost, 0 AS n FROM range(0, 3) r(i) UNION SELECT source, dst, min(w.cost + c.cost), n + 1 FROM w JOIN c ON node = src WHERE n < 30 GROUP BY source, dst, n)
 SELECT source, node, min(cost) AS cost FROM w GROUP BY 1, 2"""
# Edges cost 2 at least, so no path up to 30 has more than 15.
SUPPLY = """WITH RECURSIVE l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), e AS (SELECT p * 2 AS a, s * 2 + 1 AS b, ((p * 7 + s * 3) % 9 + 2)::DOUBLE / CASE WHEN (p + s) % 3 = 0 THEN {m}::DOUBLE ELSE 1.0::DOUBLE END AS cost FROM l),
 c AS (SELECT a AS src, b AS dst, cost FROM e UNION ALL SELECT b, a, cost FROM e),
 w AS (SELECT 2 * i AS source, 2 * i AS node, 0.0::DOUBLE AS cost, 0 AS n FROM range(1, 4) r(i) UNION SELECT source, dst, min(w.cost + c.cost), n + 1 FROM w JOIN c ON node = src WHERE n < 15 AND w.cost + c.cost <= 30 GROUP BY source, dst, n)
 SELECT source, node, min(cost) AS cost FROM w GROUP BY 1, 2"""
BOXES = """, b AS (SELECT id, lat - 0.0004::DOUBLE AS y0, lat + 0.0004::DOUBLE AS y1, lon - 0.0004::DOUBLE AS x0, lon + 0.0004::DOUBLE AS x1 FROM cameras),
 o AS (SELECT a.id, c.id AS o_id FROM b a JOIN b c ON a.id < c.id AND a.y0 <= c.y1 AND c.y0 <= a.y1 AND a.x0 <= c.x1 AND c.x0 <= a.x1)"""
TX = lambda z: f"CAST(floor((lon + 180) / 360 * {1 << z}) AS BIGINT)"

ORACLE_SQL = {
    "term_frequencies": duck("cameras", ", t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) AS token FROM cameras) SELECT token, count(*) AS n FROM t GROUP BY 1"),
    "all_terms": duck("cameras", ", t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) AS token FROM cameras) SELECT id FROM t GROUP BY id HAVING bool_or(token LIKE 'sm%') AND bool_or(token LIKE 'ri%')"),
    "ranked_lookup": """WITH p AS (SELECT p_brand AS code, p_name || ' ' || p_partkey AS name FROM part) SELECT code, name, CAST(CASE WHEN lower(code) = 'brand#1' THEN 0 WHEN lower(code) LIKE 'brand#1%' THEN 1 ELSE 2 END AS BIGINT) AS rank
 FROM p WHERE contains(lower(code), 'brand#1') OR contains(lower(name), 'brand#1') ORDER BY rank, name, code LIMIT 50""",
    "nearest_camera": duck("cameras points", f", p AS (SELECT points.idx, {HAV.format(r=6372800, a='points.lat', b='points.lon', c='cameras.lat', d='cameras.lon')} AS metres FROM points JOIN cameras ON abs(points.lat - cameras.lat) < 0.003 AND abs(points.lon - cameras.lon) < 0.004) SELECT idx, round(min(metres), 3) AS metres FROM p WHERE metres <= 300 GROUP BY 1"),
    "widened_search": duck("cameras", f", p AS (SELECT id, {DIST('39.05::DOUBLE', '-75.45::DOUBLE').replace('-  -', '+ ')} AS metres FROM cameras), b AS (SELECT *, CASE WHEN metres <= 500 THEN 500 WHEN metres <= 1000 THEN 1000 WHEN metres <= 2000 THEN 2000 WHEN metres <= 5000 THEN 5000 WHEN metres <= 10000 THEN 10000 WHEN metres <= 20000 THEN 20000 WHEN metres <= 50000 THEN 50000 WHEN metres <= 100000 THEN 100000 END::DOUBLE AS radius FROM p) SELECT id, round(metres, 3) AS metres, radius FROM b WHERE radius = (SELECT min(radius) FROM b)"),
    "faceted_places": duck("cameras", "SELECT id FROM cameras WHERE vendor IN ('Brand#11', 'Brand#12') AND lower(kind) IN ('economy', 'small') AND contains(lower(name), 'r')"),
    "history_rank": duck("points", "SELECT track, round(sum(speed / greatest(idx, 1)::DOUBLE), 6) AS rank FROM points GROUP BY 1 ORDER BY round(sum(speed / greatest(idx, 1)::DOUBLE), 9) DESC, track LIMIT 50"),
    "distinct_names": duck("cameras", "SELECT vendor, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(DISTINCT kind) AS n FROM cameras GROUP BY 1"),
    "tiles": duck("cameras", f", t AS (SELECT id, {TX(15)} AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768) AS BIGINT) AS y FROM cameras) SELECT id, x, y, CAST(list_sum(list_transform(range(0, 16), lambda i: (((x >> i) & 1) << (2 * i)) + (((y >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS code FROM t"),
    "tile_extents": duck("cameras", f", t AS (SELECT vendor, CASE id % 3 WHEN 0 THEN {TX(12)} << 13 WHEN 1 THEN {TX(13)} << 12 ELSE {TX(14)} << 11 END AS x FROM cameras) SELECT vendor, min(x) AS lo, max(x) AS hi FROM t GROUP BY 1"),
    "overlapping_boxes": duck("cameras", BOXES + " SELECT id, o_id FROM o"),
    "box_components": duck("cameras", BOXES + ", l AS (SELECT id AS a, o_id AS b FROM o UNION SELECT o_id, id FROM o), w AS (SELECT DISTINCT a AS node, a AS component FROM l UNION SELECT l.b, w.component FROM w JOIN l ON w.node = l.a WHERE w.component < l.b) SELECT node, min(component) AS component FROM w GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1),
    "least_cost_routes": EDGES.format(m="1.0"),
    "avoiding_routes": EDGES.format(m="0.1"),
    "supply_routes": SUPPLY.format(m="1.0"),
    "avoiding_supply_routes": SUPPLY.format(m="0.1"),
    "routing_rules": "SELECT p_partkey, CAST(CASE WHEN p_size > 40 THEN 0 WHEN p_brand = 'Brand#11' THEN 0.3 WHEN p_retailprice >= 1500 THEN 0.5 WHEN p_size BETWEEN 10 AND 20 THEN 0.8 ELSE 1 END AS DOUBLE) AS priority FROM part",
    "intervals": "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 24) * 3600 + 1815 WHEN 1 THEN (o_orderkey % 90) * 60 WHEN 2 THEN (o_orderkey % 7) * 3600 + 300 ELSE 0 END AS BIGINT) AS seconds FROM orders",
    "page_links": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages",
    "latest_merged": duck("points", ", p AS (SELECT track, ms, idx, lat, CASE WHEN idx % 4 <> 0 THEN speed END AS speed FROM points) SELECT track, max(ms) AS ms, arg_max(lat, ms * 100000000 + idx) AS lat, arg_max(speed, CASE WHEN speed IS NOT NULL THEN ms * 1000000 + idx END) AS speed FROM p GROUP BY 1").replace("ms * 100000000", "ms * 1000000"),
    "tiered_results": duck("cameras", ", k AS (SELECT id, row_number() OVER (ORDER BY size, id) AS k FROM cameras) SELECT id, CAST((k > 3)::INT + (k > 20)::INT + (k > 100)::INT AS BIGINT) AS level FROM k WHERE k <= 1000"),
    "longer_history_rank": duck("points", "SELECT track, round(sum(speed / greatest(idx, 1)::DOUBLE), 6) AS rank FROM points GROUP BY 1 ORDER BY round(sum(speed / greatest(idx, 1)::DOUBLE), 9) DESC, track LIMIT 1500"),
    "all_tiered_results": duck("cameras", """, g AS (SELECT size, row_number() OVER (ORDER BY size) AS i, sum(count(*)) OVER (ORDER BY size) - count(*) AS before FROM cameras GROUP BY size),
 w AS (SELECT 1::BIGINT AS i, 0::HUGEINT AS since, 0::BIGINT AS level UNION ALL
  SELECT g.i, CASE WHEN before - since >= [3, 20, 100][least(level, 2) + 1] THEN before ELSE since END, level + CASE WHEN before - since >= [3, 20, 100][least(level, 2) + 1] THEN 1 ELSE 0 END FROM w JOIN g ON g.i = w.i + 1)
 SELECT id, level FROM cameras JOIN g USING (size) JOIN w USING (i)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "page_of_items": "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 200",
    "article_sets": "SELECT n_regionkey, 'union' AS op FROM (SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region) UNION ALL SELECT n_regionkey, 'both' FROM (SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, 'rest' FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)",
}
