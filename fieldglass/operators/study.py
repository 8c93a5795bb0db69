"""Study statistics: flows, thresholds, quantiles, quartile contrasts, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOTSTRAP_DRAWS, ALPHA, SEED = 2000, 0.05, 20260725


def flow_shares(flows: DataFrame, least: float) -> DataFrame:
    """Flows of at least `least` workers and each one's share of the workers left."""
    kept = flows.where(F.col("workers") >= least)
    total = kept.agg(F.sum("workers").alias("total"))
    return kept.join(F.broadcast(total)).withColumn("flow_share", F.col("workers") / F.col("total")).drop("total")


def share_at_least(value: Column, threshold: float) -> Column:
    """Percentage of rows that reach a threshold."""
    return F.avg(F.when(value >= threshold, F.lit(100.0)).otherwise(F.lit(0.0)))


def ranked(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each distinct value with the number of rows up to it (`upto`), of it (`times`) and in its group (`n`).

    The sort runs over distinct values after a partial count, so repeated values never meet
    in one task as rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy(*by).orderBy(value)
    return counts.withColumn("upto", F.sum("times").over(order)).withColumn("n", F.sum("times").over(Window.partitionBy(*by)))


def at_rank(rank: Column, value: str) -> Column:
    """The value of a 1-based rank, as an aggregate over ranked()."""
    return F.min(F.when(F.col("upto") >= rank, F.col(value)))


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """sorted[floor(p * n)], 0-based."""
    each = ranked(df, value, by)
    return each.groupBy(*by).agg(*[at_rank(F.floor(F.lit(p) * F.col("n")) + 1, value).alias(name) for name, p in shares.items()])


def exclusive_quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """q1, q2, q3 at position k (n + 1) / 4 with linear interpolation, and n; null quartiles below two rows."""
    each = ranked(df, value, by)
    aggs: list[Column] = [F.max("n").alias("n")]
    for k in (1, 2, 3):
        low = F.least(F.greatest(F.floor(F.lit(k) * (F.col("n") + 1) / 4), F.lit(1)), F.col("n") - 1)
        weight = F.max(F.lit(k) * (F.col("n") + 1) / F.lit(4.0) - low)
        a, b = at_rank(low, value), at_rank(low + 1, value)
        aggs.append(F.when(F.max("n") >= 2, a + (b - a) * weight).alias(f"q{k}"))
    return each.groupBy(*by).agg(*aggs)


def quartile_bin(value: Column) -> Column:
    """1 to 4 by `<=` against the columns q1, q2 and q3."""
    return F.when(value <= F.col("q1"), 1).when(value <= F.col("q2"), 2).when(value <= F.col("q3"), 3).otherwise(4)


def binned(df: DataFrame, value: str, by: list[str], least: int) -> DataFrame:
    """Rows with their quartile, cut within each group of at least `least` rows; others drop out."""
    cuts = exclusive_quartiles(df, value, by).where(F.col("n") >= least)
    joined = df.join(cuts, by) if by else df.join(F.broadcast(cuts))
    return joined.where(F.col(value).isNotNull()).withColumn("quartile", quartile_bin(F.col(value)))


def ratio_of_sums(top: str, bottom: str) -> Column:
    return F.sum(top).cast("double") / F.greatest(F.sum(bottom).cast("double"), F.lit(1e-9))


def long_form(df: DataFrame, keys: list[str], prefix: str, name: str, value: str) -> DataFrame:
    """Columns of a prefix as rows; which there are is found from the schema."""
    found = [c for c in df.columns if c.startswith(prefix)]
    pairs = ", ".join(f"'{c[len(prefix):]}', `{c}`" for c in found)
    return df.selectExpr(*keys, f"stack({len(found)}, {pairs}) AS ({name}, {value})")


def keys_in_all(df: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """Rows whose key occurs under all n names."""
    full = df.groupBy(*keys).agg(F.count_distinct(name).alias("k")).where(F.col("k") == n).drop("k")
    return df.join(full, keys, "left_semi")


def weighted_draws(df: DataFrame, weight: str, key: str, draws: int, wanted: int) -> DataFrame:
    """Draws with replacement in proportion to a weight, distinct, the first `wanted` in order of draw.

    Draw i falls at the fraction i * 0.618034 mod 1 of the total weight; a range join on the
    running weight would be quadratic, so each row counts the draws in its own interval.
    """
    order = Window.orderBy(key)
    run = df.withColumn("hi", F.sum(weight).over(order)).withColumn("total", F.sum(weight).over(Window.partitionBy()))
    at = (F.lit(0.618034) * F.col("i")) % F.lit(1.0)
    spots = df.sparkSession.range(1, draws + 1).select(F.col("id").alias("i")).withColumn("at", at)
    buckets = 1024
    run = run.withColumn("from_", (F.col("hi") - F.col(weight)) / F.col("total")).withColumn("to_", F.col("hi") / F.col("total"))
    run = run.withColumn("b", F.explode(F.sequence(F.floor(F.col("from_") * buckets), F.least(F.floor(F.col("to_") * buckets), F.lit(buckets - 1)))))
    hit = spots.withColumn("b", F.floor(F.col("at") * buckets)).join(run, "b").where((F.col("at") >= F.col("from_")) & (F.col("at") < F.col("to_")))
    firsts = hit.groupBy(key).agg(F.min("i").alias("draw"))
    return firsts.orderBy("draw").limit(wanted)


def bootstrap(df: DataFrame, by: list[str], columns: list[str], statistic: Callable[[np.ndarray], np.ndarray], draws: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """by, estimate, low, high: percentile interval of a statistic of resampled rows.

    statistic takes an array (resamples, rows, columns) and gives one value a resample. Each
    group has its own seed, so the interval does not depend on partitioning. Draws come in
    chunks of four million numbers.
    """
    names = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[columns].to_numpy(float)
        x = x[np.lexsort(x.T)]
        rng = np.random.default_rng([SEED, *(int.from_bytes(str(k).encode()[:6], "big") for k in key)])
        point = float(statistic(x[None])[0])
        if len(x) == 1:
            return pd.DataFrame([[*key, point, point, point]])
        step = max(1, 4_000_000 // len(x))
        got = np.sort(np.concatenate([statistic(x[rng.integers(0, len(x), (min(step, draws - i), len(x)))]) for i in range(0, draws, step)]))
        return pd.DataFrame([[*key, point, got[int(ALPHA / 2 * draws)], got[int((1 - ALPHA / 2) * draws) - 1]]])

    return df.select(*by, *columns).groupBy(*by).applyInPandas(run, f"{names}, estimate double, low double, high double")


def medians(x: np.ndarray) -> np.ndarray:
    return np.median(x[..., 0], axis=1)


def ratios(x: np.ndarray) -> np.ndarray:
    return x[..., 0].sum(axis=1) / np.maximum(x[..., 1].sum(axis=1), 1e-9)


