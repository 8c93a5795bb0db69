"""Operator 3: quality rules by distribution divergence, in DataFrame functions only.

Counting rules fail short and repetitive texts. Of the rest, a document is kept if the
Jensen-Shannon distance of its character classes and of its common words to the nearest
language reference stays below a threshold. That of the characters does not judge texts
under a minimum length; that of the words judges every text, and is larger for short ones,
as sampling noise is. The references are the summed histograms, by language, of every
document that passes the counting rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import SPACE, short_batches, stage

# Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in a is that for it on was with be as by are this at from or an have not but",
    "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont",
    "el los del las por con una su para al lo como más pero sus y o este sí porque esta entre cuando muy no",
)
CLASSES = ("lower", "upper", "digit", "space", "ascii_other", "non_ascii")
#: Rules on counts.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Threshold on the class distance (0 to 1) and the length from which it holds.
MAX_CLASS_DISTANCE, MIN_CLASS_CHARS = 0.27, 200
#: Threshold on the word distance of texts of FULL_WORDS words and more; for n fewer, its square is WORD_NOISE (1/n - 1/FULL_WORDS) larger.
MAX_WORD_DISTANCE, FULL_WORDS, WORD_NOISE = 0.30, 200, 2.0
#: Words that a language needs, over all documents, to serve as a reference.
MIN_REFERENCE_WORDS = 1000


def vocabulary(lists: tuple[str, ...] = COMMON_WORDS) -> list[str]:
    return sorted({w for line in lists for w in line.split()})


def text_counts(docs: DataFrame, words: list[str], keep: list[str]) -> DataFrame:
    """The counts of each text: base columns, character classes, and runs of common words.

    Each step is a projection of its own so that the split text is evaluated once.
    """
    bare = F.trim(F.col("text"), F.lit(SPACE))
    df = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("bare", bare)
    df = df.withColumn(
        "w", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[ \t\n\x0B\f\r]+"))
    )
    df = df.withColumn("joined", F.array_join("w", ""))
    df = df.withColumn("rest", F.regexp_replace("joined", "[a-z]+", ""))
    df = df.withColumn("rest2", F.regexp_replace("rest", "[A-Z]+", ""))
    df = df.withColumn("rest3", F.regexp_replace("rest2", "[0-9]+", ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0))
    # 3-word windows, sorted with their positions: equal neighbours are repeats.
    df = df.withColumn("n", F.size("w"))
    grams = F.transform(
        F.slice(F.col("w"), F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))),
        lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)),
    )
    df = df.withColumn("grams", grams)
    none = F.array().cast("array<struct<g:string,i:int>>")
    df = df.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("grams")) == F.size("grams"), none).otherwise(
            F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        ),
    )
    again = F.filter(
        "sorted",
        lambda x, i: F.coalesce(x["g"] == F.get("sorted", i - 1)["g"], F.lit(False))
        | F.coalesce(x["g"] == F.get("sorted", i + 1)["g"], F.lit(False)),
    )
    df = df.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))))
    # Common words, sorted: a run's length is the word's count.
    common = F.sort_array(F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(words)))
    df = df.withColumn("common", common)
    starts = F.filter(
        F.transform("common", lambda x, i: F.when(F.coalesce(x == F.get("common", i - 1), F.lit(False)), -1).otherwise(i)),
        lambda i: i >= 0,
    )
    df = df.withColumn("starts", starts)
    runs = F.transform(
        "starts",
        lambda s, i: F.struct(
            F.get("common", s).alias("word"),
            (F.coalesce(F.get("starts", i + 1), F.size("common")) - s).cast("long").alias("n"),
        ),
    )
    length = lambda c: F.length(c).cast("long")
    ascii_other = length(F.regexp_replace("rest3", r"[\x00-\x7F]+", ""))
    return df.select(
        *keep,
        F.col("n").cast("long").alias("n_words"),
        length("joined").alias("word_chars"),
        F.regexp_count("joined", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        length("text").alias("n_chars"),
        F.array(
            length("joined") - length("rest"),
            length("rest") - length("rest2"),
            length("rest2") - length("rest3"),
            length("text") - length("joined"),
            length("rest3") - ascii_other,
            ascii_other,
        ).alias("classes"),
        runs.alias("runs"),
    )


def half_terms(p: Column, q: Column) -> Column:
    """p log2(p/m) + q log2(q/m) with m the mean, for p + q > 0; 0 log 0 is 0."""
    m = (p + q) / F.lit(2.0)
    one = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return one(p) + one(q)


def distance(total: Column) -> Column:
    """The distance from the sum of half terms."""
    return F.sqrt(F.greatest(F.lit(0.0), total / F.lit(2.0)))


def class_distance(reference: list[float]) -> Column:
    """Jensen-Shannon distance of the character classes to a reference."""
    share = lambda i: F.get("classes", F.lit(i)).cast("double") / F.col("n_chars").cast("double")
    terms = [half_terms(share(i), F.lit(float(q))) for i, q in enumerate(reference)]
    return F.when(F.col("n_chars") == 0, F.lit(1.0)).otherwise(distance(reduce(lambda a, b: a + b, terms)))


def word_distance(reference: dict[str, float]) -> Column:
    """Jensen-Shannon distance of the common words, and all others as one, to a reference.

    Words that a text lacks add their share of the reference, so only its own are visited.
    """
    shares = F.create_map(*[F.lit(x) for pair in sorted(reference.items()) for x in pair])
    n = F.col("n_words").cast("double")
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("k"))

    def step(a: Column, r: Column) -> Column:
        q = F.coalesce(F.element_at(shares, r["word"]), F.lit(0.0))
        return F.struct(
            (a["t"] + half_terms(r["n"].cast("double") / n, q)).alias("t"), (a["q"] + q).alias("q"), (a["k"] + r["n"]).alias("k")
        )

    def finish(a: Column) -> Column:
        seen = F.lit(float(sum(reference.values())))
        other = half_terms((F.col("n_words") - a["k"]).cast("double") / n, F.lit(1.0) - seen)
        return a["t"] + other + F.greatest(F.lit(0.0), seen - a["q"])

    return F.when(F.col("n_words") == 0, F.lit(1.0)).otherwise(distance(F.aggregate("runs", zero, step, finish)))


def references(counts: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """By language, the shares of classes and of common words over all documents that pass the counting rules.

    Languages times the words of a fixed list: what comes to the driver does not grow with the documents.
    """
    good = counts.where(~F.col("base_failed") & F.col("lang").isNotNull())
    sums = good.groupBy("lang").agg(
        F.sum("n_words").alias("words"), F.sum("n_chars").alias("chars"),
        *[F.sum(F.get("classes", F.lit(i))).alias(c) for i, c in enumerate(CLASSES)],
    ).where(F.col("words") >= MIN_REFERENCE_WORDS)
    of_words: dict[str, dict[str, int]] = {}
    each = good.select("lang", F.explode("runs").alias("r")).groupBy("lang", "r.word").agg(F.sum("r.n").alias("n"))
    for row in each.collect():
        of_words.setdefault(row["lang"], {})[row["word"]] = row["n"]
    return {
        r["lang"]: ([r[c] / r["chars"] for c in CLASSES], {w: n / r["words"] for w, n in of_words.get(r["lang"], {}).items()})
        for r in sums.collect()
    }


def judged(docs: DataFrame, keep: list[str], common: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """`row` (a struct of the columns `keep`) and the results of judge()."""
    short_batches(docs.sparkSession)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("text"), lang.alias("lang_"), F.struct(*keep).alias("row"))
    counts = text_counts(base, vocabulary(common), ["row", F.col("lang_").alias("lang")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = stage(counts.withColumn("base_failed", failed), "quality")
    known = references(counts)
    far = F.lit(0.0)
    by_class = F.least(*[class_distance(c) for c, _ in known.values()], F.lit(1.0)) if known else far
    by_word = F.least(*[word_distance(w) for _, w in known.values() if w], F.lit(1.0)) if any(w for _, w in known.values()) else far
    out = counts.withColumn("class_distance", by_class).withColumn("word_distance", by_word)
    noise = F.when((F.col("n_words") > 0) & (F.col("n_words") < FULL_WORDS), F.lit(WORD_NOISE) / F.col("n_words") - F.lit(WORD_NOISE / FULL_WORDS)).otherwise(F.lit(0.0))
    odd = ((F.col("n_chars") >= MIN_CLASS_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        F.col("word_distance") > F.sqrt(F.lit(MAX_WORD_DISTANCE**2) + noise)
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~odd).select("row", *RESULTS)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def judge(docs: DataFrame, keep: list[str] | None = None, common: tuple[str, ...] = COMMON_WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): counts, base_failed, distances, kept.

    keep: columns carried along, doc_id alone by default (`judged` carries columns of any name).
    Null and empty texts have zero counts and fail. A null lang takes part as any text, but in
    no reference; without any reference (an empty or tiny table) only the counting rules decide.
    Repeated ids and rows are judged row by row, so ties do not arise: a document at a threshold
    is kept. A text of any length is read whole, in one task. Columns whose names clash with the
    results' are not looked at. The plan grows with the languages that have references.
    """
    return judged(docs, keep or ["doc_id"], common).select("row.*", *RESULTS)
