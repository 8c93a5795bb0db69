"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but
the last return the columns of documents, whatever further columns those have: results travel
beside the row, not among its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import decontamination, line_dedup, minhash_dedup, mixing, quality_rules
from fieldglass.llm.common import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them."""
    return quality_rules.judged(docs, docs.columns).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go from the texts; every document stays, and n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    out = line_dedup.removed(docs, rest)
    column = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNull(), F.col("row.n_chars") if "n_chars" in rest else F.lit(None)).otherwise(F.length("text").cast("long"))}
    return out.select([column.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of smallest id (a null one last), then of a hash.

    Rows equal in every column are copies too. Documents without words are in no group and stay.
    """
    found = stage(minhash_dedup.classified(docs), "classified")
    group = found.where("component is not null").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "component").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("row_hash", F.xxhash64("row"))
    same = lambda a, b: F.col("of").eqNullSafe(F.col(a)) & (F.col("text_hash") == F.col(b))
    slim = rows.select("of", "text_hash", "row_hash").join(group, same("id_", "hash_")).drop("id_", "hash_")
    place = F.struct(F.col("of").isNull().alias("unknown"), "of", "text_hash", "row_hash")
    first = slim.groupBy("component", place.alias("place")).agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.min(F.struct("place", "n")).alias("f"))
    first = stage(first.select(F.col("f.place.of").alias("id_"), F.col("f.place.text_hash").alias("hash_"), F.col("f.place.row_hash").alias("row_"), F.col("f.n").alias("n")), "first")

    # Rows without words stay whatever they hold, and have no group, so no id and hash is in both tables.
    empty = found.where("component is null").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.lit(None).cast("long").alias("row_")).distinct()
    stay = first.where("n = 1").drop("n").unionByName(empty)
    out = rows.join(stay, same("id_", "hash_") & (F.col("row_").isNull() | (F.col("row_hash") == F.col("row_"))), "left_semi").select("row.*")
    several = first.where("n > 1")
    if several.isEmpty():
        return out
    repeated = rows.join(several, same("id_", "hash_") & (F.col("row_hash") == F.col("row_")), "left_semi")
    return out.unionByName(repeated.dropDuplicates(["of", "text_hash", "row_hash"]).select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminated(docs, benchmark, docs.columns).where("not contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each; a result that clashes with a column of documents gets underscores."""
    out = mixing.mixed(docs, docs.columns).where("copies > 0")
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    results: list[Column] = [F.col(c).alias(free(c)) for c in ("size", "source_size", "target", "copies", "taken")]
    return out.select("row.*", *results)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: SQL cannot express the stages; tests hold each of them, and the whole, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
