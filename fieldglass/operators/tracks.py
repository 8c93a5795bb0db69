"""Tracks: legs, analysis, splits, sessions, smoothing, elevation, simplification."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions import geo

ELEVATION_THRESHOLD_M = 7.0
SESSION_MS, TRACK_MS = 6 * 60_000, 2 * 3_600_000


def legs(points: DataFrame, track: str = "track", order: str = "idx") -> DataFrame:
    """Points with the metres and seconds since the previous one and the metres so far; the first has none."""
    w = Window.partitionBy(track).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    out = points.withColumn("metres", geo.haversine_6372800(before("lat"), before("lon"), F.col("lat"), F.col("lon")))
    out = out.withColumn("seconds", F.when((F.col("ms") > 0) & (before("ms") > 0), F.floor(F.greatest(F.lit(0), F.col("ms") - before("ms")) / 1000)))
    return out.withColumn("run", F.sum(F.coalesce("metres", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def analysis(with_legs: DataFrame, track: str = "track") -> DataFrame:
    """One row a track: distance, moving time and distance, speeds, elevations, bounds, time span.

    Moving: positive speed, both times known, and a leg longer than a ten-thousandth of its
    milliseconds. An average of nothing is -1.
    """
    moving = (F.col("speed") > 0) & F.col("seconds").isNotNull() & (F.col("metres") > F.col("seconds") * 1000 / F.lit(10000.0))
    known = F.when(F.col("ms") > 0, F.col("ms"))
    return with_legs.groupBy(track).agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.coalesce("metres", F.lit(0.0))).alias("distance"),
        F.sum(F.when(moving, F.col("metres")).otherwise(0.0)).alias("moving_distance"), F.sum(F.when(moving, F.col("seconds")).otherwise(0)).alias("moving_seconds"),
        F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"), F.coalesce(F.avg(F.when(F.col("speed") > 0, F.col("speed"))), F.lit(-1.0)).alias("avg_speed"),
        F.min("ele").alias("min_ele"), F.max("ele").alias("max_ele"), F.avg("ele").alias("avg_ele"),
        F.min("lat").alias("bottom"), F.max("lat").alias("top"), F.min("lon").alias("left"), F.max("lon").alias("right"),
        ((F.max(known) - F.min(known)) / 1000).cast("long").alias("time_span"),
    )


def sessions(points: DataFrame, track: str = "track", gap_ms: int = SESSION_MS, factor: int = 10, track_gap_ms: int = TRACK_MS) -> DataFrame:
    """Number of session and of track of each point.

    A session ends at a gap of six minutes that is also ten times the gap before it, and at
    every gap that ends a track.
    """
    w = Window.partitionBy(track).orderBy("ms", "idx")
    out = points.withColumn("gap", F.col("ms") - F.lag("ms").over(w))
    out = out.withColumn("gap_before", F.lag("gap").over(w))
    new_track = F.coalesce(F.col("gap") >= track_gap_ms, F.lit(False))
    new = new_track | F.coalesce((F.col("gap") >= gap_ms) & (F.col("gap") >= factor * F.col("gap_before")), F.lit(False))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("session", F.sum(new.cast("long")).over(upto)).withColumn("part", F.sum(new_track.cast("long")).over(upto)).drop("gap", "gap_before")


def islands(df: DataFrame, by: list[str], order: list[str], changed: Column) -> DataFrame:
    """`island`: the number of changes so far; `changed` may look at lag columns over the same window."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("new_", F.coalesce(changed, F.lit(False)).cast("long")).withColumn("island", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def split_by_distance(with_legs: DataFrame, limit: float, track: str = "track", order: str = "idx") -> DataFrame:
    """One row for each stretch of `limit` metres; a leg that spans several cuts is shared out among them."""
    w = Window.partitionBy(track).orderBy(order)
    start = F.coalesce(F.lag("run").over(w), F.lit(0.0))
    rows = with_legs.withColumn("from_", start).where("run > from_")
    k = F.explode(F.sequence(F.floor(F.col("from_") / limit), F.floor(F.col("run") / limit)))
    rows = rows.select(track, "from_", "run", "seconds", k.alias("part"))
    share = F.least("run", (F.col("part") + 1) * F.lit(limit)) - F.greatest("from_", F.col("part") * F.lit(limit))
    rows = rows.withColumn("metres", share).where("metres > 0")
    return rows.groupBy(track, "part").agg(F.sum("metres").alias("metres"), F.sum(F.col("seconds") * F.col("metres") / (F.col("run") - F.col("from_"))).alias("seconds"))


def gps_filtered(points: DataFrame, speed: tuple[float, float] | None = None, ele: tuple[float, float] | None = None, hdop: float | None = None) -> DataFrame:
    """Points within the given ranges; a missing value passes."""
    for name, bounds in (("speed", speed), ("ele", ele)):
        if bounds:
            points = points.where(F.col(name).isNull() | F.isnan(name) | F.col(name).between(*bounds))
    return points.where(F.col("hdop").isNull() | (F.col("hdop") <= hdop)) if hdop is not None else points


def filled(points: DataFrame, value: str, track: str = "track", order: str = "run") -> DataFrame:
    """Gaps of a value filled by distance between the known neighbours, edges by the nearest one."""
    w = Window.partitionBy(track).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = lambda c: F.when(F.col(value).isNotNull(), F.col(c))
    v0, v1 = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)
    d0, d1 = F.last(known(order), ignorenulls=True).over(back), F.first(known(order), ignorenulls=True).over(ahead)
    between = v0 + (v1 - v0) * (F.col(order) - d0) / F.nullif(d1 - d0, F.lit(0.0))
    return points.withColumn("filled", F.coalesce(F.col(value), between, v0, v1))


def per_track(points: DataFrame, scan: Callable[[pd.DataFrame], pd.DataFrame], schema: str, track: str = "track") -> DataFrame:
    """An ordered scan of each track in pandas, for what no window function can say."""
    return points.groupBy(track).applyInPandas(scan, schema)


def smoothed(points: DataFrame, metres: float) -> DataFrame:
    """Points further than `metres` along the track from the last point accepted; first and last always stay."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        keep, since = [], 0.0
        for i, step in enumerate(pdf["metres"].fillna(0.0)):
            since += step
            keep.append(i in (0, len(pdf) - 1) or since > metres)
            if keep[-1]:
                since = 0.0
        return pdf.loc[keep, ["track", "idx"]]

    return per_track(points.select("track", "idx", "metres"), scan, "track long, idx long")


def extrema(values: np.ndarray, run: np.ndarray, threshold: float) -> list[int]:
    """Indices that Douglas-Peucker keeps on (run, value) with a vertical threshold; iterative, so long tracks are safe."""
    keep, stack = {0, len(values) - 1}, [(0, len(values) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        inner = np.arange(a + 1, b)
        width = run[b] - run[a]
        line = values[a] + (values[b] - values[a]) * ((run[inner] - run[a]) / width if width > 0 else 0.0)
        off = np.abs(values[inner] - line)
        at = int(off.argmax())
        if off[at] > threshold:
            m = a + 1 + at
            keep.add(m)
            stack += [(a, m), (m, b)]
    return sorted(keep)


def elevation_changes(points: DataFrame, threshold: float = ELEVATION_THRESHOLD_M) -> DataFrame:
    """Metres up and down between the extrema of each track; nothing below four points."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["ele"]).sort_values("idx")
        if len(pdf) < 4:
            return pd.DataFrame({"track": [], "up": [], "down": []})
        v = pdf["ele"].to_numpy(float)
        d = np.diff(v[extrema(v, pdf["run"].to_numpy(float), threshold)])
        return pd.DataFrame({"track": [pdf["track"].iloc[0]], "up": [d[d > 0].sum()], "down": [-d[d < 0].sum()]})

    return per_track(points.select("track", "idx", "ele", "run"), scan, "track long, up double, down double")


def simplified(points: DataFrame, epsilon: float) -> DataFrame:
    """Points that Douglas-Peucker keeps on (lon, lat), in degrees."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, y = pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
        keep, stack = {0, len(x) - 1}, [(0, len(x) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            dx, dy = x[b] - x[a], y[b] - y[a]
            size = np.hypot(dx, dy)
            px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            off = np.abs(dx * py - dy * px) / size if size > 0 else np.hypot(px, py)
            at = int(off.argmax())
            if off[at] > epsilon:
                keep.add(a + 1 + at)
                stack += [(a, a + 1 + at), (a + 1 + at, b)]
        return pdf.iloc[sorted(keep)][["track", "idx"]]

    return per_track(points.select("track", "idx", "lat", "lon"), scan, "track long, idx long")


def in_range(value: Column, low: float, high: float, least: float, most: float) -> Column:
    """The library's range filter: within [low, high], with open ends where a bound lies at the catalogue's end; null fails."""
    return F.coalesce(value.between(low, high) | ((value < least) & F.lit(low == least)) | ((value > most) & F.lit(high == most)), F.lit(False))


def in_list(value: Column, chosen: list[str]) -> Column:
    return F.coalesce(value, F.lit("")).isin(chosen) if chosen else F.lit(False)


def in_folders(value: Column, chosen: list[str]) -> Column:
    """String prefix, so that folder a also matches ab."""
    out = F.lit(False)
    for c in chosen:
        out = out | F.coalesce(value, F.lit("")).startswith(c)
    return out


def folder_totals(items: DataFrame, folder: str, sums: list[str]) -> DataFrame:
    """Totals of each folder with all its sub-folders."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = items.select("*", F.explode(above).alias("of"))
    return rows.groupBy("of").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])

