"""Registered study queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators import study as S
from fieldglass.operators.search import placed
from fieldglass.plans.standins import duck, standin, table

r4 = lambda c: F.round(c, 4)
big = lambda c: c.cast("long")


def od_flows(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "flows").where("workers >= 60").withColumn("workers", r4(F.col("workers")))


def od_flow_shares(spark: SparkSession, d: str) -> DataFrame:
    return S.flow_shares(standin(spark, d, "flows"), 60).select("h", "w", F.round("flow_share", 8).alias("flow_share"))


def od_with_ends(spark: SparkSession, d: str) -> DataFrame:
    """Flows whose two ends are known, with the demographics of the origin where there are any."""
    flows, people, firms = standin(spark, d, "flows"), table(spark, d, "customer"), table(spark, d, "supplier")
    known = flows.join(people.select(F.col("c_custkey").alias("h"), F.col("c_nationkey").alias("h_state")), "h").join(firms.select(F.col("s_suppkey").alias("w"), F.col("s_nationkey").alias("w_state")), "w")
    income = people.where("c_acctbal > 0").select(F.col("c_custkey").alias("h"), F.col("c_acctbal").alias("income"))
    out = known.join(income, "h", "left")
    return out.groupBy("h_state", "w_state").agg(big(F.count(F.lit(1))).alias("n"), big(F.count("income")).alias("with_income"), r4(F.sum("workers")).alias("workers"))


def exposure_shares(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("base_cameras")
    return standin(spark, d, "results").agg(*[F.round(S.share_at_least(c, t), 6).alias(f"at_least_{t}") for t in (1, 3, 5)])


def tail_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_rank(standin(spark, d, "results"), "base_cameras", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["state"])


def quartiles_by_state(spark: SparkSession, d: str) -> DataFrame:
    out = S.exclusive_quartiles(standin(spark, d, "results"), "base_km", ["state"])
    return out.select("state", "n", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")])


def rates_by_state(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "results")
    evaded = F.col("base_cameras") - F.col("avoid_cameras")
    return df.groupBy("state").agg(
        big(F.count(F.lit(1))).alias("n"), F.round(S.ratio_of_sums("base_cameras", "base_km"), 8).alias("per_km"), F.round(F.median("base_cameras"), 4).alias("median"),
        F.round(F.sum(F.when(evaded > 0, F.col("avoid_km") - F.col("base_km"))) / F.sum(F.when(evaded > 0, evaded)), 8).alias("km_per_evaded"),
    )


def quartile_contrast(spark: SparkSession, d: str) -> DataFrame:
    df = S.binned(standin(spark, d, "results"), "income", [], 8)
    return df.groupBy("quartile").agg(big(F.count(F.lit(1))).alias("k"), r4(F.avg("base_cameras")).alias("mean"), F.round(S.ratio_of_sums("base_cameras", "base_km"), 8).alias("rate"), r4(F.median("base_km")).alias("median_km"))


def quartiles_within_areas(spark: SparkSession, d: str) -> DataFrame:
    df = S.binned(standin(spark, d, "results"), "income", ["state"], 40)
    return df.groupBy("quartile").agg(big(F.count(F.lit(1))).alias("k"), big(F.count_distinct("state")).alias("areas"), r4(F.avg("base_cameras")).alias("mean"))


def vendor_totals(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).count()
    wide = wide.select("l_orderkey", *[F.coalesce(c, F.lit(0)).alias(f"base_{c}") for c in ("A", "N", "R")])
    rows = S.long_form(wide, ["l_orderkey"], "base_", "vendor", "hits")
    out = rows.groupBy("vendor").agg(big(F.sum("hits")).alias("hits"), F.round(S.share_at_least(F.col("hits"), 1), 6).alias("reached"))
    total = rows.agg(F.sum("hits").alias("total"))
    return out.join(F.broadcast(total)).select("vendor", "hits", "reached", F.round(F.col("hits") / F.col("total"), 8).alias("share"))


def radius_sweep(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("radius"), F.col("l_quantity").alias("hits")).where("radius <= 3")
    rows = S.keys_in_all(df, ["l_orderkey"], "radius", 3)
    return rows.groupBy("radius").agg(big(F.count(F.lit(1))).alias("n"), r4(F.avg("hits")).alias("mean"), r4(F.median("hits")).alias("median"), F.round(S.share_at_least(F.col("hits"), 25), 6).alias("reached"))


def histogram_and_fit(spark: SparkSession, d: str) -> DataFrame:
    df = standin(spark, d, "results")
    clipped = F.least(F.greatest(F.floor(F.col("base_km") / 20), F.lit(0)), F.lit(9))
    fit = df.agg(F.round(F.regr_slope("base_cameras", "base_km"), 6).alias("slope"), F.round(F.corr("base_cameras", "base_km"), 6).alias("corr"))
    return df.groupBy(clipped.cast("long").alias("bin")).agg(big(F.count(F.lit(1))).alias("n")).join(F.broadcast(fit))


def ecdf(spark: SparkSession, d: str) -> DataFrame:
    each = S.ranked(standin(spark, d, "results"), "base_cameras", [])
    return each.select("base_cameras", F.round(F.col("upto") / F.col("n"), 8).alias("share"))


def demographics(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").where("c_acctbal > 0")
    return df.select("c_custkey", F.round(F.lit(100.0) * F.coalesce(F.col("c_nationkey"), F.lit(0)) / F.col("c_acctbal"), 6).alias("pct"))


def resume_skip(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no result row has: what a resumed run would still do."""
    done = table(spark, d, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


def commute_sample(spark: SparkSession, d: str) -> DataFrame:
    flows = standin(spark, d, "flows").where("workers >= 60").select(F.concat_ws("-", "h", "w").alias("pair"), "workers")
    return S.weighted_draws(flows, "workers", "pair", 300, 100)


def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.md5(F.concat(F.lit("20260725:"), F.col("o_orderkey").cast("string"))).alias("place")).orderBy("place").limit(100)


def full_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Every order with its place in the seeded shuffle."""
    df = table(spark, d, "orders").select("o_orderkey", F.md5(F.concat(F.lit("20260725:"), F.col("o_orderkey").cast("string"))).alias("digest"))
    return placed(df, [F.col("digest"), F.col("o_orderkey")]).select("o_orderkey", "place")


def bootstrap_medians(spark: SparkSession, d: str) -> DataFrame:
    return S.bootstrap(standin(spark, d, "results"), ["state"], ["base_cameras"], S.medians)


def bootstrap_rates(spark: SparkSession, d: str) -> DataFrame:
    return S.bootstrap(standin(spark, d, "results"), ["state"], ["base_cameras", "base_km"], S.ratios)


QUERIES = {f.__name__: f for f in (
    od_flows, od_flow_shares, od_with_ends, exposure_shares, tail_percentiles, quartiles_by_state, rates_by_state, quartile_contrast, quartiles_within_areas,
    vendor_totals, radius_sweep, histogram_and_fit, ecdf, demographics, resume_skip, commute_sample, seeded_shuffle, full_shuffle, bootstrap_medians, bootstrap_rates,
)}

# Exclusive quartiles: linear interpolation at position k (n + 1) / 4 of the sorted values.
QUARTS = """, s AS (SELECT {g}, {v} AS v, row_number() OVER (PARTITION BY {g} ORDER BY {v}) AS rn, count(*) OVER (PARTITION BY {g}) AS n FROM results WHERE {v} IS NOT NULL),
 p AS (SELECT {g}, n, k, greatest(1, least(n - 1, CAST(floor(k * (n + 1) / 4.0) AS BIGINT))) AS lo FROM (SELECT DISTINCT {g}, n FROM s), (SELECT unnest([1, 2, 3]) AS k)),
 q AS (SELECT p.{g}, p.n, p.k, max(CASE WHEN rn = lo THEN v END) + (max(CASE WHEN rn = lo + 1 THEN v END) - max(CASE WHEN rn = lo THEN v END)) * (p.k * (p.n + 1) / 4.0 - p.lo) AS q
  FROM p JOIN s ON p.{g} = s.{g} GROUP BY p.{g}, p.n, p.k, p.lo),
 cuts AS (SELECT {g}, n, max(CASE WHEN k = 1 THEN q END) AS q1, max(CASE WHEN k = 2 THEN q END) AS q2, max(CASE WHEN k = 3 THEN q END) AS q3 FROM q GROUP BY {g}, n)"""
BIN = "CASE WHEN income <= q1 THEN 1 WHEN income <= q2 THEN 2 WHEN income <= q3 THEN 3 ELSE 4 END"

ORACLE_SQL = {
    "od_flows": duck("flows", "SELECT h, w, round(workers, 4) AS workers FROM flows WHERE workers >= 60"),
    "od_flow_shares": duck("flows", "SELECT h, w, round(workers / (SELECT sum(workers) FROM flows WHERE workers >= 60), 8) AS flow_share FROM flows WHERE workers >= 60"),
    "od_with_ends": duck("flows", """SELECT c.c_nationkey AS h_state, s_nationkey AS w_state, count(*) AS n, count(CASE WHEN c.c_acctbal > 0 THEN 1 END) AS with_income, round(sum(workers), 4) AS workers
 FROM flows JOIN customer c ON h = c.c_custkey JOIN supplier ON w = s_suppkey GROUP BY 1, 2"""),
    "exposure_shares": duck("results", "SELECT " + ", ".join(f"round(avg(CASE WHEN base_cameras >= {t} THEN 100.0::DOUBLE ELSE 0 END), 6) AS at_least_{t}" for t in (1, 3, 5)) + " FROM results"),
    "tail_percentiles": duck("results", ", l AS (SELECT state, list_sort(list(base_cameras)) AS v FROM results GROUP BY state) SELECT state, " + ", ".join(f"v[CAST(floor({p}::DOUBLE * len(v)) AS BIGINT) + 1] AS p{n}" for n, p in ((50, 0.5), (90, 0.9), (99, 0.99))) + " FROM l"),
    "quartiles_by_state": duck("results", QUARTS.format(g="state", v="base_km") + " SELECT state, CAST(n AS BIGINT) AS n, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM cuts"),
    "rates_by_state": duck("results", """SELECT state, count(*) AS n, round(sum(base_cameras)::DOUBLE / greatest(sum(base_km), 1e-9), 8) AS per_km, round(median(base_cameras)::DOUBLE, 4) AS median,
 round(sum(CASE WHEN base_cameras > avoid_cameras THEN avoid_km - base_km END) / sum(CASE WHEN base_cameras > avoid_cameras THEN base_cameras - avoid_cameras END)::DOUBLE, 8) AS km_per_evaded FROM results GROUP BY state"""),
    "quartile_contrast": duck("results", ", one AS (SELECT 1 AS g, * FROM results), " + QUARTS.format(g="g", v="income").replace("FROM results", "FROM one").lstrip(", ") + f""" SELECT {BIN} AS quartile, count(*) AS k, round(avg(base_cameras), 4) AS mean,
 round(sum(base_cameras)::DOUBLE / greatest(sum(base_km), 1e-9), 8) AS rate, round(median(base_km), 4) AS median_km FROM one JOIN cuts USING (g) WHERE n >= 8 GROUP BY 1"""),
    "quartiles_within_areas": duck("results", QUARTS.format(g="state", v="income") + f" SELECT {BIN} AS quartile, count(*) AS k, count(DISTINCT state) AS areas, round(avg(base_cameras), 4) AS mean FROM results JOIN cuts USING (state) WHERE n >= 40 GROUP BY 1"),
    "vendor_totals": """WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), v AS (SELECT unnest(['A', 'N', 'R']) AS vendor), x AS (SELECT vendor, l_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.l_orderkey AND l_returnflag = vendor) AS hits FROM o, v)
 SELECT vendor, CAST(sum(hits) AS BIGINT) AS hits, round(avg(CASE WHEN hits >= 1 THEN 100.0::DOUBLE ELSE 0 END), 6) AS reached, round(sum(hits)::DOUBLE / (SELECT sum(hits) FROM x)::DOUBLE, 8) AS share FROM x GROUP BY vendor""",
    "radius_sweep": """WITH k AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3)
 SELECT l_linenumber AS radius, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, round(avg(CASE WHEN l_quantity >= 25 THEN 100.0::DOUBLE ELSE 0 END), 6) AS reached
 FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey IN (SELECT l_orderkey FROM k) GROUP BY 1""",
    "histogram_and_fit": duck("results", """, f AS (SELECT round(regr_slope(base_cameras, base_km), 6) AS slope, round(corr(base_cameras, base_km), 6) AS corr FROM results)
 SELECT CAST(least(greatest(floor(base_km / 20), 0), 9) AS BIGINT) AS bin, count(*) AS n, any_value(slope) AS slope, any_value(corr) AS corr FROM results, f GROUP BY 1"""),
    "ecdf": duck("results", "SELECT base_cameras, round(sum(count(*)) OVER (ORDER BY base_cameras)::DOUBLE / sum(count(*)) OVER ()::DOUBLE, 8) AS share FROM results GROUP BY base_cameras"),
    "demographics": "SELECT c_custkey, round(100.0::DOUBLE * coalesce(c_nationkey, 0) / c_acctbal, 6) AS pct FROM customer WHERE c_acctbal > 0",
    "resume_skip": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)",
    "commute_sample": duck("flows", """, f AS (SELECT concat_ws('-', h, w) AS pair, workers FROM flows WHERE workers >= 60), r AS (SELECT pair, workers, sum(workers) OVER (ORDER BY pair) AS hi, sum(workers) OVER () AS total FROM f),
 s AS (SELECT i, (0.618034::DOUBLE * i) % 1.0::DOUBLE AS spot FROM range(1, 301) t(i)) SELECT pair, min(i) AS draw FROM s JOIN r ON spot >= (hi - workers) / total AND spot < hi / total GROUP BY pair ORDER BY draw LIMIT 100"""),
    "seeded_shuffle": "SELECT o_orderkey, md5('20260725:' || o_orderkey) AS place FROM orders ORDER BY place LIMIT 100",
    "full_shuffle": "SELECT o_orderkey, row_number() OVER (ORDER BY md5('20260725:' || o_orderkey), o_orderkey) AS place FROM orders",
}
