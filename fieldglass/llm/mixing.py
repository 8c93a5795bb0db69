"""Operator 6: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token budget. Whole epochs of a source come first; what is left of the
budget is filled by the documents with the smallest exponential keys -ln(u)/weight, u a
hash of the id, so a document of double weight is twice as likely to come early and every
run chooses alike. Prefix sums over the sorted keys find the cut. They are taken over two
levels of key buckets, so that no task ever holds more than a source's share of one of
16.7 million buckets, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import short_batches, stage, word_count

WEIGHTS = (3, 1, 2)
BUDGET_SHARE, MAX_EPOCHS = 1.5, 2.0
MIN_QUALITY = 0.05
BUCKETS = 4096


def default_quality(text: Column) -> Column:
    """1 less the share of markup and symbol characters, at least MIN_QUALITY."""
    n = F.length(text).cast("double")
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("double")
    return F.when(n > 0, F.greatest(F.lit(MIN_QUALITY), F.lit(1.0) - symbols / n)).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, quality: Column, seed: str) -> Column:
    """-ln(u)/quality with u in (0, 1) from 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)
    return -F.log(u) / quality


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: the budget shared by weight, none above `most` times its size.

    In order of cap per weight, a source is capped while its cap lies below the level that
    the budget left would give; what caps free raises the level for the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    first = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.row_number().over(order).alias("k"), "level"))
    per = per.withColumn("first", first).withColumn("level", F.min("first").over(everything)["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def crossing(rows: DataFrame, bucket: str, base: str) -> DataFrame:
    """Per source the bucket in which the prefix sum reaches the budget, and the sum before it."""
    sums = rows.groupBy("source", "left", base, bucket).agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy(bucket)
    sums = sums.withColumn("upto", F.col(base) + F.sum("n").over(order))
    hit = (F.col("upto") - F.col("n") < F.col("left")) & (F.col("left") <= F.col("upto"))
    return sums.where(hit).select("source", "left", F.col(bucket).alias(f"cut_{bucket}"), (F.col("upto") - F.col("n")).alias(f"after_{bucket}"))


def mixed(
    docs: DataFrame,
    keep: list[str],
    weights: tuple[int, ...] = WEIGHTS,
    share: float = BUDGET_SHARE,
    most: float = MAX_EPOCHS,
    quality: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """`row` (a struct of the columns `keep`), size, source_size, target, copies and taken."""
    short_batches(docs.sparkSession)
    quality = F.coalesce(default_quality(F.col("text")) if quality is None else quality, F.lit(1.0))
    key = F.col("key")
    sized = docs.select(
        F.struct(*keep).alias("row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        sampling_key(F.col("doc_id"), quality, seed).alias("key"),
    )
    spread = (F.lit(1.0) - F.exp(-key)) * F.lit(float(BUCKETS))
    sized = sized.withColumn("b1", F.least(F.floor(spread), F.lit(BUCKETS - 1)).cast("int"))
    sized = sized.withColumn("b2", F.floor((spread - F.col("b1")) * F.lit(float(BUCKETS))).cast("int"))
    slim = stage(sized.drop("row") if keep != ["doc_id"] else sized, "mix")

    per = targets(slim, weights, share, most)
    size = F.col("source_size").cast("double")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    per = stage(per.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * size), "mix-sources")
    asked = per.where("left > 0").select(F.col("source").alias("s"), "left", F.lit(0).cast("long").alias("none"))
    same = F.col("source").eqNullSafe(F.col("s"))
    rows = slim.join(asked, same).drop("s")
    one = crossing(rows, "b1", "none").withColumnRenamed("source", "s")
    inside = slim.join(one, same & (F.col("b1") == F.col("cut_b1"))).drop("s")
    two = crossing(inside, "b2", "after_b1")
    two = stage(
        one.join(two.select(F.col("source").alias("s2"), "cut_b2", "after_b2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "mix-cuts"
    )
    leaf = slim.join(two, same & (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")))
    rank = F.struct("key", "doc_id", "size")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("after_b2") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / F.lit(2.0)
    cut = leaf.withColumn("middle", middle).where("middle <= left").groupBy("source").agg(F.max(rank).alias("cut"))
    cuts = two.join(cut.withColumnRenamed("source", "s3"), F.col("s").eqNullSafe(F.col("s3")), "left")
    per = per.withColumnRenamed("source", "s4").join(cuts.drop("s3", "left"), F.col("s4").eqNullSafe(F.col("s")), "left").drop("s")
    per = stage(per, "mix-targets")

    out = (sized if keep != ["doc_id"] else slim).join(per, F.col("source").eqNullSafe(F.col("s4")))
    last = F.coalesce(rank <= F.col("cut"), F.lit(False))
    chosen = (F.col("b1") < F.col("cut_b1")) | (
        (F.col("b1") == F.col("cut_b1")) & ((F.col("b2") < F.col("cut_b2")) | ((F.col("b2") == F.col("cut_b2")) & last))
    )
    copies = F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, keep: list[str] | None = None, **settings: object) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source) with size, source_size, target, copies and taken.

    keep: columns carried along, doc_id alone by default (`mixed` carries columns of any name);
    settings: those of `mixed`. A null text has size 0; a null source is a source, last in
    order; ties of a key (repeated ids) fall to the same side of the cut only if their sizes
    are equal too. A text of any length counts whole, and stays on one side of the cut. An
    empty table gives no rows.
    """
    return mixed(docs, keep or ["doc_id"], **settings).select("row.*", "size", "source_size", "target", "copies", "taken")
