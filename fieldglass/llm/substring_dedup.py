"""Operator 10: removal of repeated 20-word windows behind a count-min prefilter.

Each window is filed under its anchor, the smallest-hashed run of five words in it; equal
windows have equal anchors. Partition sketches of the anchors are merged, so their counts
are estimates from above of the windows' counts. A second pass groups exactly only the windows
whose anchor is estimated repeated: first whole stretches of windows that share an anchor,
then, where the stretches of an anchor differ, their single windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import sketch
from fieldglass.llm.common import join_hot, minimizers, mix, multipliers, short_batches, stage, unstage, windows, word_hashes

WINDOW_WORDS, ANCHOR_WORDS = 20, 5
#: Anchors to expect of a byte of text.
ANCHORS_PER_BYTE = 1 / 48


def window_hashes(five: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n windows of 20 words from those of five words."""
    a, b, c, d = multipliers(4, 20)
    ten = mix(five[: n + 10] * a + five[5 : n + 15] * b)
    return mix(ten[:n] * c + ten[10 : n + 10] * d)


def stretches(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, and first and last window start, of each stretch; and the hashes of five words."""
    words = word_hashes(text or b"")
    n = len(words) - WINDOW_WORDS + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty((2, 0), np.int64), np.empty(0, np.uint64)
    five = windows(words, ANCHOR_WORDS, 5)
    at = minimizers(five, WINDOW_WORDS - ANCHOR_WORDS + 1)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cuts])
    return five[at[first]], np.stack([first, np.concatenate([cuts, [n]]) - 1]), five


def identity(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text_hash tell documents apart; rows equal in both are one document."""
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"), *more)


def prints() -> Callable[[bytes | None], np.ndarray]:
    return lambda text: stretches(text)[0]


def candidates(docs: DataFrame, capacity: int) -> DataFrame:
    """A row for each stretch whose anchor is estimated repeated."""
    texts = identity(docs)
    table, tester, release = sketch.prefiltered(texts, prints, F.xxhash64("doc_id", "text_hash"), ANCHORS_PER_BYTE, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tester()
        for batch in batches:
            row, anchor, start, key, wins = [], [], [], [], []
            for i, (text, hits) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                f, ends, five = stretches(text)
                if not len(f):
                    continue
                hit = np.flatnonzero(test(f, hits))
                if not len(hit):
                    continue
                w = window_hashes(five, int(ends[1, -1]) + 1).view(np.int64)
                for j in hit:
                    s, e = int(ends[0, j]), int(ends[1, j])
                    row.append(i)
                    start.append(s)
                    wins.append(w[s : e + 1])
                    key.append(xxhash.xxh3_64_intdigest(wins[-1].tobytes()) - (1 << 63))
                anchor.append(f[hit].view(np.int64))
            if row:
                take = pa.array(row)
                offsets = np.concatenate([[0], np.cumsum([len(w) for w in wins])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(anchor)), pa.array(key, pa.int64()),
                        pa.array(start, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(wins))),
                    ],
                    names=["doc_id", "text_hash", "anchor", "key", "start", "windows"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, anchor long, key long, start int, windows array<long>"
    out = stage(table.mapInArrow(run, schema), "stretches")
    release()
    return out


def removed_starts(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, starts: the starts of windows that also start earlier, as ranges (start, n) and lists."""
    place = F.struct("doc_id", "text_hash", "start")
    kinds = found.groupBy("anchor", "key").agg(F.min(place).alias("first"), F.first("windows").alias("windows"), F.count(F.lit(1)).alias("n"))
    kinds = stage(kinds, "kinds")
    several = stage(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "several")
    single = join_hot(kinds, several, ["anchor"], "kinds").select("anchor", "key", "first", F.posexplode("windows").alias("j", "window"))
    here = F.struct("first.doc_id", "first.text_hash", (F.col("first.start") + F.col("j")).alias("start"))
    single = stage(single.select("anchor", "key", "j", "window", here.alias("here")), "windows")
    earliest = stage(single.groupBy("anchor", "window").agg(F.min("here").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "earliest")
    late = join_hot(single, earliest, ["anchor", "window"], "n").where("least < here")
    late = stage(late.groupBy("anchor", "key").agg(F.collect_list("j").alias("late")), "late")
    # Of a stretch that occurs once and has no late window nothing goes.
    matter = stage(kinds.join(late, ["anchor", "key"], "left").where("n > 1 or late is not null").select("anchor", "key", "first", "late", F.col("n").alias("times")), "matter")
    joined = join_hot(found.select("doc_id", "text_hash", "anchor", "key", "start", F.size("windows").alias("n")), matter, ["anchor", "key"], "times")
    is_first = place == F.col("first")
    ranges = F.when(~is_first, F.array(F.struct(F.col("start").alias("s"), F.col("n").alias("n")))).otherwise(
        F.transform(F.coalesce("late", F.array().cast("array<int>")), lambda j: F.struct((F.col("start") + j).alias("s"), F.lit(1).alias("n")))
    )
    joined = joined.withColumn("ranges", ranges).where(F.size("ranges") > 0)
    out = stage(joined.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    unstage(kinds, several, single, earliest, late, matter)
    return out


def remove_repeats(docs: DataFrame, capacity: int = sketch.CAPACITY) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words kept, joined by a space) for each row of `docs` (doc_id, text).

    A word goes if a window of 20 words over it also starts earlier: in a smaller doc_id (null
    is the smallest), or in the same document at an earlier start. Rows equal in id and text
    are one document and get the same result; rows equal in id alone are ordered by a hash of
    their text. Null and empty texts have no words; a text of any length is read whole, in one
    task. Other columns are ignored. capacity: anchors up to which the sketch is broadcast; it
    does not change results.
    """
    short_batches(docs.sparkSession)
    gone = removed_starts(candidates(docs, capacity))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "ranges")
    rows = identity(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int32)
                    s, n = np.array([(r["s"], r["n"]) for r in ranges], np.int64).T
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + WINDOW_WORDS - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    out = rows.select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
