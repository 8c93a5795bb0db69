"""Operator 2: removal of repeated multi-line chunks with content-defined boundaries.

A rolling hash over the hashes of lines with words chooses where chunks end, so a line that is
inserted or removed moves only the boundaries near it. Neighbouring chunks share the line
between them: every two neighbouring lines lie in exactly one chunk. Chunks that hold a line
pair which the merged sketch estimates repeated are grouped by the SHA-256 of their bytes, and
of each group all but the first occurrence go as a whole. What is left, one occurrence of each
distinct chunk, is compared pair by pair, which extends a repeated passage into the chunks at
its ends, or finds one that is shorter than a chunk. The first occurrence of every line stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import sketch
from fieldglass.llm.common import join_hot, short_batches, stage, windows

#: Lines that the rolling hash sees, and lines between boundaries on average.
ROLL_LINES, MEAN_LINES = 3, 4
#: Line pairs to expect of a byte of text.
PAIRS_PER_BYTE = 1 / 60


def worded(lines: list[bytes]) -> list[int]:
    """Numbers of the lines that hold a word."""
    return [i for i, x in enumerate(lines) if x and not x.isspace()]


def chunks(lines: list[bytes], at: list[int]) -> list[tuple[int, int]]:
    """Chunks of the lines numbered `at`, as ranges (i, j) of positions in `at`: from line at[i] to line at[j], both included.

    A boundary follows where the hash over ROLL_LINES lines falls so; the last line ends a chunk.
    """
    if len(at) < 2:
        return []
    h = np.fromiter((xxhash.xxh3_64_intdigest(lines[i]) for i in at), np.uint64, len(at))
    ends = np.flatnonzero(windows(h, ROLL_LINES, 3) % np.uint64(MEAN_LINES) == 0) + ROLL_LINES - 1
    cuts = [0, *(e for e in ends.tolist() if e < len(at) - 1), len(at) - 1]
    return list(zip(cuts, cuts[1:], strict=False))


def pair_bytes(lines: list[bytes], at: list[int]) -> list[bytes]:
    """Each two neighbouring lines with a word, with the blank lines between them."""
    return [b"\n".join(lines[a : b + 1]) for a, b in zip(at, at[1:], strict=False)]


def prints() -> Callable[[bytes | None], np.ndarray]:
    def of(text: bytes | None) -> np.ndarray:
        lines = (text or b"").split(b"\n")
        return np.array([xxhash.xxh3_64_intdigest(p) for p in pair_bytes(lines, worded(lines))], np.uint64)

    return of


def repeated_lines(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, gone (ranges of lines), whole (chunks that go as a whole) of the texts that lose lines."""
    place = F.struct("doc_id", "text_hash", "start")
    kinds = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), F.first("pairs").alias("pairs"))
    kinds = stage(kinds, "kinds")
    pairs = kinds.select("digest", F.struct("first.doc_id", "first.text_hash", "first.start").alias("chunk"), F.explode("pairs").alias("p"))
    pairs = stage(pairs.select("digest", F.col("p.s").alias("s"), F.col("p.n").alias("n"), F.col("p.pair").alias("pair"), F.struct("chunk.doc_id", "chunk.text_hash", (F.col("chunk.start") + F.col("p.s")).alias("start")).alias("here")), "line-pairs")
    earliest = stage(pairs.groupBy("pair").agg(F.min("here").alias("least"), F.count(F.lit(1)).alias("times_")).where("times_ > 1"), "earliest")
    late = join_hot(pairs, earliest, ["pair"], "times_").where("least < here")
    late = stage(late.groupBy("digest").agg(F.collect_list(F.struct("s", "n")).alias("late")), "late")
    matter = stage(kinds.join(late, "digest", "left").where("times > 1 or late is not null").select("digest", "times", "first", "late"), "matter")
    rows = join_hot(found.select("doc_id", "text_hash", "start", "n", "digest"), matter, ["digest"], "times")
    copy = place != F.col("first")
    whole = F.array(F.struct(F.col("start").alias("s"), "n"))
    part = F.transform("late", lambda p: F.struct((p["s"] + F.col("start")).alias("s"), p["n"].alias("n")))
    rows = rows.withColumn("gone", F.when(copy, whole).otherwise(part)).where("gone is not null")
    return rows.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def removed(docs: DataFrame, keep: list[str], capacity: int = sketch.CAPACITY) -> DataFrame:
    """`row` (a struct of the columns `keep`), text, n_lines, n_chunks, n_removed_chunks, n_removed_lines."""
    short_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    table, tester, release = sketch.prefiltered(texts, prints, F.xxhash64("doc_id", "text_hash"), PAIRS_PER_BYTE, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tester()
        for batch in batches:
            row, start, size, digest, pairs = [], [], [], [], []
            for i, (text, hits) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                lines = (text or b"").split(b"\n")
                at = worded(lines)
                data = pair_bytes(lines, at)
                if not data:
                    continue
                maybe = test(np.array([xxhash.xxh3_64_intdigest(p) for p in data], np.uint64), hits)
                for a, b in chunks(lines, at):
                    if maybe[a:b].any():
                        row.append(i)
                        start.append(at[a])
                        size.append(at[b] - at[a] + 1)
                        digest.append(hashlib.sha256(b"\n".join(lines[at[a] : at[b] + 1])).digest())
                        pairs.append([{"s": at[j] - at[a], "n": at[j + 1] - at[j] + 1, "pair": hashlib.sha256(data[j]).digest()} for j in range(a, b) if maybe[j]])
            if row:
                take = pa.array(row)
                kind = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("pair", pa.binary())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(pairs, kind)],
                    names=["doc_id", "text_hash", "start", "n", "digest", "pairs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stage(table.mapInArrow(run, f"doc_id {kind}, text_hash long, start int, n int, digest binary, pairs array<struct<s:int,n:int,pair:binary>>"), "chunks")
    release()
    gone = repeated_lines(found)
    rows = docs.select(F.struct(*keep).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is None:
                    out.append((None, 0, 0, 0, 0))
                    continue
                lines = text.split(b"\n")
                at = worded(lines)
                each, n, cut, whole = chunks(lines, at), len(lines), 0, 0
                if parts:
                    goes = np.zeros(n, bool)
                    for p in parts:
                        goes[p["s"] : p["s"] + p["n"]] = True
                    cut, whole = int(goes.sum()), sum(1 for a, b in each if goes[at[a] : at[b] + 1].all())
                    text = b"\n".join(x for x, g in zip(lines, goes.tolist(), strict=True) if not g)
                out.append((text, n, len(each), whole, cut))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["row", "text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines"],
            )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text binary, n_lines long, n_chunks long, n_removed_chunks long, n_removed_lines long"
    out = rows.select("row", "text", "gone").mapInArrow(apply, schema)
    return out.withColumn("text", F.col("text").cast("string"))


def remove_repeated_chunks(docs: DataFrame, keep: list[str] | None = None, capacity: int = sketch.CAPACITY) -> DataFrame:
    """One row per row of `docs` (doc_id, text): keep, text, n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    keep: columns carried along, doc_id alone by default (without text, which is replaced, and
    without the names of the counts; `removed` carries columns of any name). n_chunks counts the
    content-defined chunks, n_removed_chunks those of which no line stays. The first
    occurrence, by smallest doc_id (null first), then a hash of the text, then position, stays.
    Rows equal in id and text are one document and get the same result. A null text stays null;
    an empty one is one empty line and stays; a text of any length is read whole, in one task.
    capacity: values up to which the sketch is broadcast; it does not change results.
    """
    return removed(docs, keep or ["doc_id"], capacity).select("row.*", "text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
