"""Operator 7: language identification by compression.

For each language a zstandard raw-content dictionary holds a bounded sample of its labelled
text. A text is compressed, piece by piece, with the dictionary of every language; the
language whose output is smallest is predicted. `accepted` tells whether its margin over the
runner-up is wide enough.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import short_batches

#: The bounded sample: documents and characters per language in a dictionary. Documents are taken whole.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 128_000
#: Documents of so many characters come first: shorter ones say little, a longer one would fill the sample alone.
TYPICAL_CHARS = (200, 4000)
#: Letters that are compressed at once; a text is cut into as many pieces as it needs.
PIECE_CHARS = 4096
#: A match finder that sees matches of 3 bytes.
LEVEL, MIN_MATCH = 5, 3
#: Relative margin in compressed size under which a prediction is not accepted.
MIN_MARGIN = 0.02
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def normalized(text: str) -> str:
    """Lower-case words of letters; case, digits and symbols say nothing about a language here."""
    return " ".join(LETTERS.findall(text.lower()))


def fit(docs: DataFrame, training: Column) -> dict[str, bytes]:
    """Dictionaries by language from `docs` (doc_id, text, lang) where `training` holds (null does not).

    Per language the documents of smallest hashed id among those of TYPICAL_CHARS, then the
    shortest of the longer ones, then the longest of the shorter ones, whole, until
    SAMPLE_DOCS or SAMPLE_CHARS are reached; the first is taken whatever its size. That many
    a language reach the driver and, as dictionaries, the executors: what is broadcast grows with
    the number of languages, not with the documents. The languages come in order of their
    number of documents, most frequent first, which decides ties. Null langs and null texts teach nothing,
    nor does a language of which no sampled text has a letter; ids may be null or repeated.
    """
    texts = docs.where(F.coalesce(training, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts = texts.select("lang", "doc_id", F.col("text").alias("t"), F.length("text").alias("size"))
    short, long = F.col("size") < TYPICAL_CHARS[0], F.col("size") > TYPICAL_CHARS[1]
    by_size = F.struct(F.when(short, 2).when(long, 1).otherwise(0), F.when(short, -F.col("size")).when(long, F.col("size")).otherwise(0), F.xxhash64("doc_id", "t"))
    drawn = texts.select("lang", by_size.alias("place"), "size", "doc_id")
    order = Window.partitionBy("lang").orderBy("place")
    drawn = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS)
    # Only sizes are ranked; the texts of those drawn follow.
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    drawn = drawn.withColumn("upto", upto).where((F.col("k") == 1) | (F.col("upto") <= SAMPLE_CHARS))
    drawn = drawn.select(F.col("lang").alias("l"), F.col("place").alias("p"), "k")
    sample = texts.withColumn("place", by_size).join(F.broadcast(drawn), (F.col("lang") == F.col("l")) & (F.col("place") == F.col("p")))
    found: dict[str, dict[int, str]] = {}
    for row in sample.select("lang", "k", "t").distinct().collect():
        found.setdefault(row["lang"], {})[row["k"]] = normalized(row["t"])
    often = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    joined = {lang: " ".join(t for _, t in sorted(found[lang].items())).encode() for lang in sorted(found, key=lambda x: (-often[x], x))}
    # A dictionary has 8 bytes at least; a few letters are repeated to fill them.
    return {lang: data if len(data) >= 8 else (data + b" ") * 8 for lang, data in joined.items() if data.strip()}


class Compressors:
    """One compressor a language, without any header beside the frame's."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.each = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, letters: str) -> list[int]:
        pieces = [letters[i : i + PIECE_CHARS].encode() for i in range(0, len(letters), PIECE_CHARS)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.each]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and acceptance; the more frequent language wins a tie."""
        letters = normalized(text or "")
        if not letters or not self.langs:
            return UNKNOWN, 0.0, False
        sizes = self.sizes(letters)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        # A softmax over relative sizes: equal sizes share the score evenly.
        score = 1.0 / sum(math.exp(-40.0 * (s - sizes[best]) / sizes[best]) for s in sizes)
        return self.langs[best], score, margin >= MIN_MARGIN


def predicted(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[Column]) -> DataFrame:
    """`row` (a struct of the columns `keep`), lang_pred, score and accepted."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(dictionaries)
    given = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(shared.value)
        for batch in batches:
            found = [compressors.predict(t) for t in batch.column(1).to_pylist()]
            langs, scores, accepted = ([f[i] for f in found] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["row", "lang_pred", "score", "accepted"]
            )

    return given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[Column] | None = None) -> DataFrame:
    """`keep` (doc_id by default), lang_pred, score and accepted for each row of `docs`.

    Only the whole text is looked at, however long. Null texts and texts without a letter are
    `und` with score 0; so is every text when no language was learned. Row by row, so null and
    repeated ids do not matter; `predicted` carries columns of any name.
    """
    return predicted(docs, dictionaries, keep or [F.col("doc_id")]).select("row.*", "lang_pred", "score", "accepted")
