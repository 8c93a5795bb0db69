"""Text and place search: postings, term intersection, ranking, nearest places, facets."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.functions.text import search_tokens
from fieldglass.operators.staging import stage

MAX_TERMS = 6
# Radii in metres that a search widens through.
RADII = (500.0, 1000.0, 2000.0, 5000.0, 10_000.0, 20_000.0, 50_000.0, 100_000.0)

# Shares of the radius in which nearest() looks first.
NEAREST_SHARES = (1 / 16, 1 / 4)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """token, key."""
    return df.select(key, F.explode(search_tokens(F.col(text))).alias("token"))


def with_all_terms(posted: DataFrame, key: str, phrase: str) -> DataFrame:
    """Keys with a token that starts with each of the phrase's terms, at most six, rarest condition first.

    One pass: a term is a bit, and a key needs all bits; there is no join.
    """
    terms = list(dict.fromkeys(phrase.lower().split()))[:MAX_TERMS]
    found = [F.max(F.col("token").startswith(t).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)]
    first = F.lit(False)
    for t in terms:
        first = first | F.col("token").startswith(t)
    hits = posted.where(first).groupBy(key).agg(*found)
    for i in range(len(terms)):
        hits = hits.where(F.col(f"t{i}") == 1)
    return hits.select(key)


def ranked_lookup(df: DataFrame, code: str, name: str, needle: str, limit: int = 50) -> DataFrame:
    """Exact codes first, then codes that begin with the needle, then other matches; by name within each."""
    n = needle.lower()
    rank = F.when(F.lower(code) == n, 0).when(F.lower(code).startswith(n), 1).otherwise(2)
    hits = df.where(F.lower(code).contains(n) | F.lower(name).contains(n)).withColumn("rank", rank)
    return hits.orderBy("rank", name, code).limit(limit)


def within(points: DataFrame, places: DataFrame, key: list[str], radius_m: float) -> DataFrame:
    """key, place, metres of the nearest place within a radius of each point, by cells of the radius; the posted places are shuffled, never broadcast."""
    size = radius_m / geo.METRES_PER_DEGREE
    east = size * 2  # enough up to 60 degrees of latitude
    spots = places.select(F.col("id").alias("place"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    around = [F.struct((geo.cell(F.col("plat"), size) + i).alias("cy"), (geo.cell(F.col("plon"), east) + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spots = spots.select("*", F.explode(F.array(*around)).alias("c")).select("*", "c.cy", "c.cx").drop("c")
    here = points.withColumn("cy", geo.cell(F.col("lat"), size)).withColumn("cx", geo.cell(F.col("lon"), east))
    d = geo.haversine_6372800(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    near = here.join(spots.hint("merge"), ["cy", "cx"]).withColumn("metres", d).where(F.col("metres") <= radius_m)
    return near.groupBy(*key).agg(F.min(F.struct("metres", "place")).alias("n")).select(*key, "n.place", "n.metres")


def nearest(points: DataFrame, places: DataFrame, key: list[str], radius_m: float) -> DataFrame:
    """The nearest place within a radius of each point; ties go to the smaller id.

    A place found within a smaller radius is the nearest one, so only the points that find none
    look further; where places are dense, none is compared with all within the radius.
    """
    left, found = points.select(*dict.fromkeys([*key, "lat", "lon"])), []
    for share in NEAREST_SHARES:
        found.append(stage(within(left, places, key, radius_m * share), "nearest"))
        done = found[-1].select(*[F.col(k).alias(f"{k}_done") for k in key])
        left = left.join(done.hint("merge"), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_done")) for k in key]), "left_anti")
    return reduce(DataFrame.unionByName, [*found, within(left, places, key, radius_m)])


def widened(places: DataFrame, lat: float, lon: float, radii: tuple[float, ...] = RADII) -> DataFrame:
    """Places within the smallest radius that holds any, nearest first; one pass instead of repeated searches."""
    d = geo.haversine_6372800(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    bucket = F.coalesce(*[F.when(F.col("metres") <= r, F.lit(r)) for r in radii])
    hits = places.withColumn("metres", d).withColumn("radius", bucket).where("radius is not null")
    least = hits.agg(F.min("radius").alias("least"))
    return hits.join(F.broadcast(least)).where("radius = least").drop("least").orderBy("metres", "id")


def facets(values: dict[str, list[str]]) -> Column:
    """OR within a category, AND across; a column may hold several values with ';'."""
    out = F.lit(True)
    for c, wanted in values.items():
        out = out & F.coalesce(F.arrays_overlap(F.split(F.lower(c), r"\s*;\s*"), F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))
    return out


def decayed(df: DataFrame, by: str, value: Column, age: Column, keep: int) -> DataFrame:
    """History rank: value by age, summed; the best `keep`."""
    return df.groupBy(by).agg(F.sum(value / F.greatest(age, F.lit(1.0))).alias("rank")).orderBy(F.round("rank", 9).desc(), by).limit(keep)


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Every row with its place in the order, from 1; the order tells rows apart. Ranges are sorted each on its own and offset by the rows before them."""
    parts = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "placed")
    sizes = sorted(tuple(r) for r in parts.groupBy(F.shiftright("at_", 33).alias("part_")).count().collect())
    before = list(accumulate([n for _, n in sizes], initial=0))
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part_ long, before_ long")
    rows = parts.join(F.broadcast(offsets), F.shiftright("at_", 33) == F.col("part_"))
    return rows.withColumn("place", F.col("before_") + F.col("at_") - F.shiftleft("part_", 33) + 1).drop("at_", "part_", "before_")


def visibility_tiers(df: DataFrame, order: list[str], steps: tuple[int, ...] = (3, 20, 100)) -> DataFrame:
    """The first rows of the order with a level: one more after each step. The order's ranking is a top-k; visible_levels has all rows."""
    top = df.orderBy(*order).limit(max(steps) * 10)
    k = F.row_number().over(Window.orderBy(*order))
    level = F.lit(0)
    for s in steps:
        level = level + (k > s).cast("int")
    return top.withColumn("level", level)


def visible_levels(df: DataFrame, key: list[str], limits: tuple[int, ...] = (3, 20, 100)) -> DataFrame:
    """Level of every row, in the order of a coarse key: where the key changes and the level has its limit of rows, the next begins; the last limit repeats.

    Only counts by distinct key come to the driver, one partition at a time.
    """
    levels, level, held = [], 0, 0
    for *k, n in df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_")).orderBy(*key).toLocalIterator():
        if held >= limits[min(level, len(limits) - 1)]:
            level, held = level + 1, 0
        held += n
        levels.append((*k, level))
    names = [f"key_{i}" for i in range(len(key))]
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, key, strict=True))
    of = df.sparkSession.createDataFrame(levels, f"{schema}, level int")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for n, c in zip(names, key, strict=True)])
    return df.join(of, same).drop(*names)
