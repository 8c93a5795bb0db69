"""Track library: filters, sort keys, grouping; places: acceptance, ranking, nearest along a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import geo
from fieldglass.operators.cameras import passed_cells


def range_enabled(low: float, high: float, least: float, most: float) -> bool:
    """A range filter that spans the catalogue's range does nothing; an empty range is not valid."""
    return high > low and (low > least or high < most)


def in_dates(created: Column, start_ms: int, end_ms: int) -> Column:
    """Created between two times, both included; an unknown time (below 10 ms) is not."""
    return F.coalesce((created >= 10) & created.between(start_ms, end_ms), F.lit(False))


def has_text(value: Column, needle: str) -> Column:
    """Contains the trimmed needle, whatever the case and the accents; an empty needle is in everything."""
    n = needle.strip()
    return F.coalesce(F.contains(F.collate(value, "UNICODE_CI_AI"), F.collate(F.lit(n), "UNICODE_CI_AI")), F.lit(not n))


def has_all(flags: dict[str, bool]) -> Column:
    """All of the switched-on flags hold; null does not."""
    out = F.lit(True)
    for c, wanted in flags.items():
        out = out & F.coalesce(F.col(c), F.lit(False)) if wanted else out
    return out


#: Sort modes of tracks and what they look at; dates are named after the reading direction, not the order of numbers.
SORT_MODES = (
    "nearest", "last_modified", "name_ascending", "name_descending", "value_ascending", "value_descending",
    "date_ascending", "date_descending", "distance_ascending", "distance_descending", "duration_ascending", "duration_descending",
)


def sort_keys(mode: str) -> list[Column]:
    """Order of a mode over the columns metres_away, modified, name, value, created, distance, duration, id.

    Unknown values (null, or a date below 10 ms) come last either way; ties go by name, then id.
    date_ascending lists the newest first, as users of the library know it.
    """
    known = F.when(F.col("created") >= 10, F.col("created"))
    column = {"nearest": F.col("metres_away"), "last_modified": F.col("modified"), "name": F.col("name"), "value": F.col("value"), "date": known, "distance": F.col("distance"), "duration": F.col("duration")}
    what, _, way = mode.rpartition("_") if mode not in ("nearest", "last_modified") else (mode, "", "ascending" if mode == "nearest" else "descending")
    down = (way == "descending") != (what == "date")
    first = column[what].desc_nulls_last() if down else column[what].asc_nulls_last()
    return [first, F.col("name"), F.col("id")]


def accepted_types(places: DataFrame, types: DataFrame, known: list[str], other: str = "other") -> DataFrame:
    """Places of a listed (category, subtype); a null subtype lists a whole category, an unknown category counts as `other`."""
    category = F.when(F.col("category").isin(known), F.col("category")).otherwise(F.lit(other))
    tagged = places.withColumn("category_", category)
    exact = types.where("subtype is not null").select(F.col("category").alias("c"), F.col("subtype").alias("s"))
    whole = types.where("subtype is null").select(F.col("category").alias("c2")).distinct()
    hit = tagged.join(F.broadcast(whole), F.col("category_") == F.col("c2"), "left")
    hit = hit.join(F.broadcast(exact.distinct()), (F.col("category_") == F.col("c")) & (F.col("subtype") == F.col("s")), "left")
    return hit.where("c2 is not null or c is not null").drop("c", "s", "c2", "category_")


def along_path(places: DataFrame, legs: DataFrame, metres: float) -> DataFrame:
    """id, leg, off: for each place within some metres of a leg (leg, y1, x1, y2, x2) the nearest leg and its distance; ties go to the first leg.

    Legs are posted in the cells that they pass, widened by the distance; places in their own.
    """
    size = max(metres / geo.METRES_PER_DEGREE * 2, 1e-4)
    cells = passed_cells(legs, "x1", "y1", "x2", "y2", size, size)
    here = places.withColumn("cy", geo.cell(F.col("lat"), size)).withColumn("cx", geo.cell(F.col("lon"), size))
    off = geo.orthogonal_metres(*(F.col(c) for c in ("lat", "lon", "y1", "x1", "y2", "x2")))
    near = here.join(cells, ["cy", "cx"]).withColumn("off", off).where(F.col("off") <= metres)
    return near.groupBy("id").agg(F.min(F.struct("off", "leg")).alias("n")).select("id", "n.leg", "n.off")


def class_lengths(segments: DataFrame, route: str, order: str, kind: str, metres: str) -> tuple[DataFrame, DataFrame]:
    """Runs of one class in order (route, island, kind, metres), and the metres of each class of a route."""
    w = Window.partitionBy(route).orderBy(order)
    changed = ~F.col(kind).eqNullSafe(F.lag(kind).over(w)) & F.lag(order).over(w).isNotNull()
    runs = segments.withColumn("new_", changed.cast("long")).withColumn("island", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(route, "island").agg(F.first(kind).alias(kind), F.sum(metres).alias(metres), F.count(F.lit(1)).alias("n"))
    return runs, runs.groupBy(route, kind).agg(F.sum(metres).alias(metres), F.count(F.lit(1)).alias("runs"))


def vessel_approach(df: DataFrame) -> DataFrame:
    """hours and miles of the closest approach of a vessel to another, on a plane around the first; null where courses do not close in.

    Columns lat, lon, cog (degrees), sog (knots), and the other's with `o_`. Minutes of latitude are miles.
    """
    k = F.cos(F.radians("lat"))
    dx, dy = (F.col("o_lon") - F.col("lon")) * 60 * k, (F.col("o_lat") - F.col("lat")) * 60
    v = lambda p: (F.col(f"{p}sog") * F.sin(F.radians(f"{p}cog")), F.col(f"{p}sog") * F.cos(F.radians(f"{p}cog")))
    (ax, ay), (bx, by) = v(""), v("o_")
    vx, vy = bx - ax, by - ay
    speed2 = vx * vx + vy * vy
    hours = -(dx * vx + dy * vy) / F.when(speed2 >= 1e-10, speed2)
    df = df.withColumn("hours", F.when(hours >= 0, hours))
    ex, ey = dx + vx * F.col("hours"), dy + vy * F.col("hours")
    return df.withColumn("miles", F.sqrt(ex * ex + ey * ey))


# How two bytes of a vehicle's answer become a number.
VEHICLE = {
    "rpm": lambda a, b: F.floor((a * 256 + b) / 4), "runtime": lambda a, b: a * 256 + b, "speed": lambda a, b: a, "temperature": lambda a, b: a - 40,
    "fuel_pressure": lambda a, b: a * 3, "percent": lambda a, b: a * F.lit(100.0) / F.lit(255.0), "voltage": lambda a, b: (a * 256 + b) / F.lit(1000.0), "fuel_rate": lambda a, b: (a * 256 + b) / F.lit(20.0),
}


def vehicle_value(kind: Column, a: Column, b: Column) -> Column:
    """The decoded answer of a command, null for an unknown one."""
    out = None
    for name, f in VEHICLE.items():
        out = F.when(kind == name, f(a, b).cast("double")) if out is None else out.when(kind == name, f(a, b).cast("double"))
    return out
