"""Operator 5: suffix-array removal of bytes in 400-byte strings that also start elsewhere.

Each 400-byte window is filed under its anchor, the smallest-hashed run of 128 bytes in it;
equal windows have equal anchors, so the shards that anchors deal out share no window. A
count-min sketch of the anchors keeps what may repeat. A stretch of windows under one anchor
that occurs twice as a whole is repeated as a whole; where the stretches of an anchor differ,
a shard's suffix array (induced sorting) and permuted common prefixes tell which of
their windows occur twice.

An anchor of very many differing stretches is dealt out again by a longer one. A window holds
272 bytes beside its anchor, r of them before it, and equal windows have equal r. So it has
either the 136 bytes before the anchor or the 136 after it, and is filed under the anchor
grown by those; what is left open halves each time, until equal anchors mean equal windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import sketch
from fieldglass.llm.common import join_hot, minimizers, mix, multipliers, short_batches, stage, unstage
from fieldglass.llm.suffix_array import repeated_starts

WIDTH, ANCHOR_BYTES = 400, 128
#: Bytes of differing stretches in one suffix array.
SHARD_BYTES = 1 << 20
#: An anchor with more differing stretches is not gathered in one shard, but grown and dealt out again.
MAX_STRETCHES = 1024
#: Bytes of a window beside its anchor.
OPEN_BYTES = WIDTH - ANCHOR_BYTES
#: Anchors to expect of a byte of text.
ANCHORS_PER_BYTE = 1 / 100
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of `width` bytes, put together from runs of powers of two."""
    base = int(multipliers(1, 50)[0])
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    run, size = TABLE[data], 1
    out, have = None, 0
    while True:
        if width & size:
            n = len(data) - have - size + 1
            out = run.copy() if out is None else out[:n] * power(size) + run[have : have + n]
            have += size
        if have == width:
            return mix(out)
        n = len(run) - size
        run = run[:n] * power(size) + run[size : size + n]
        size *= 2


def stretches(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window start, number of windows and place of the anchor of each stretch."""
    n = len(text or b"") - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    grams = rolling(np.frombuffer(text, np.uint8), ANCHOR_BYTES)
    at = minimizers(grams, OPEN_BYTES + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return grams[at[first]], first, np.diff(np.append(first, n)), at[first]


def prints() -> Callable[[bytes | None], np.ndarray]:
    return lambda text: stretches(text)[0]


def candidates(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, text_hash, anchor, key, start, n, place, bytes: each stretch whose anchor is estimated repeated; place: of the anchor in the bytes."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    table, tester, release = sketch.prefiltered(texts, prints, F.xxhash64("doc_id", "text_hash"), ANCHORS_PER_BYTE, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = tester()
        for batch in batches:
            row, anchor, key, start, size, place, data = [], [], [], [], [], [], []
            for i, (text, hits) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                f, s, n, at = stretches(text)
                if not len(f):
                    continue
                for j in np.flatnonzero(test(f, hits)).tolist():
                    part = text[s[j] : s[j] + n[j] + WIDTH - 1]
                    row.append(i)
                    anchor.append(f[j])
                    key.append(xxhash.xxh3_64_intdigest(part) - (1 << 63))
                    start.append(s[j])
                    size.append(n[j])
                    place.append(at[j] - s[j])
                    data.append(part)
            if row:
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(np.array(anchor).view(np.int64)), pa.array(key, pa.int64()),
                        pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(data, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "anchor", "key", "start", "n", "place", "bytes"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = stage(table.mapInArrow(run, f"doc_id {kind}, text_hash long, anchor long, key long, start long, n int, place int, bytes binary"), "stretches")
    release()
    return out


def runs(at: np.ndarray) -> list[dict[str, int]]:
    """Ranges (s, n) of consecutive numbers."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    return [{"s": int(p[0]), "n": len(p)} for p in np.split(at, cuts)]


RANGES = pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64())]))


def sharded(kinds: DataFrame) -> DataFrame:
    """anchor, key, ranges by suffix arrays; the stretches of an anchor meet in one shard."""

    def found(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ranges = [runs(s) for s in repeated_starts([b for *_, b in rows], WIDTH)]
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, *_ in rows], pa.int64()), pa.array([k for _, k, _ in rows], pa.int64()), pa.array(ranges, RANGES)], names=["anchor", "key", "ranges"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                    yield found(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield found(rows)

    dealt = kinds.select("anchor", "key", "bytes").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, key long, ranges array<struct<s:long,n:long>>").where(F.size("ranges") > 0)


PARTS = "root_anchor long, root_key long, shift long, asked boolean, times long, before int, after int, anchor long, key long, n int, place int, bytes binary"


def grown(parts: DataFrame) -> DataFrame:
    """Each part of a stretch cut in two: the windows with more bytes before the anchor, and those with more after it.

    before and after: bytes that the anchor has grown by; a window starts place - j bytes before the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                half = (OPEN_BYTES - r["before"] - r["after"]) // 2
                # Windows j < cut have more than `half` of the open bytes before the anchor.
                cut = min(max(r["place"] - r["before"] - half, 0), r["n"])
                for lo, hi, before, after in ((0, cut, r["before"] + half + 1, r["after"]), (cut, r["n"], r["before"], OPEN_BYTES - r["before"] - half)):
                    if lo < hi:
                        data, place = r["bytes"][lo : hi + WIDTH - 1], r["place"] - lo
                        fixed = data[place - before : place + ANCHOR_BYTES + after]
                        anchor = xxhash.xxh3_64_intdigest(fixed, seed=before) - (1 << 63)
                        key = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                        out.append(r | {"shift": r["shift"] + lo, "before": before, "after": after, "anchor": anchor, "key": key, "n": hi - lo, "place": place, "bytes": data})
            if out:
                yield pa.RecordBatch.from_pylist([{c: o[c] for c in names} for o in out], schema=batch.schema)

    return parts.mapInArrow(run, PARTS)


def answers(parts: DataFrame) -> DataFrame:
    """root_anchor, root_key, ranges (from the root's first window) of the asked parts, whose stretches meet under `anchor`.

    parts: PARTS. A part that occurs twice is repeated as a whole; the others of an anchor are
    compared in a shard, or grown if they are too many. Each round halves what is open of a
    window, so there are ten at most.
    """
    found = []
    while True:
        kinds = stage(parts.groupBy("anchor", "key").agg(F.sum("times").alias("times"), F.first("bytes").alias("bytes")), "kinds")
        several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
        several = stage(several, "several")
        ranges = stage(sharded(join_hot(kinds, several.where(F.col("kinds") <= MAX_STRETCHES), ["anchor"], "kinds")), "ranges")
        asked = parts.where("asked").select("root_anchor", "root_key", "shift", "anchor", "key", F.col("n").cast("long").alias("n"))
        whole = asked.join(kinds.where("times > 1").select("anchor", "key"), ["anchor", "key"])
        found.append(whole.select("root_anchor", "root_key", F.array(F.struct(F.col("shift").alias("s"), "n")).alias("ranges")))
        inside = asked.join(ranges.join(kinds.where("times = 1").select("anchor", "key"), ["anchor", "key"]), ["anchor", "key"])
        found.append(inside.select("root_anchor", "root_key", F.transform("ranges", lambda r: F.struct((r["s"] + F.col("shift")).alias("s"), r["n"].alias("n"))).alias("ranges")))
        hot = several.where(F.col("kinds") > MAX_STRETCHES)
        if hot.isEmpty():
            break
        parts = stage(grown(join_hot(parts, hot, ["anchor"], "kinds").select(*[c.split()[0] for c in PARTS.split(", ")])), "parts")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("root_anchor", "root_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def removed_starts(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, ranges: the window starts that are repeated, as ranges (s, n)."""
    kinds = found.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("place").alias("place"), F.first("bytes").alias("bytes"))
    kinds = stage(kinds, "kinds")
    several = stage(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1"), "several")
    # Stretches that all occur twice are repeated as they are; no array is needed. One that occurs twice needs no answer.
    few, many = several.where(F.col("kinds") <= MAX_STRETCHES), several.where(F.col("kinds") > MAX_STRETCHES)
    ranges = sharded(join_hot(kinds, few, ["anchor"], "kinds"))
    if not many.isEmpty():
        zero = F.lit(0)
        parts = join_hot(kinds, many, ["anchor"], "kinds").select(
            F.col("anchor").alias("root_anchor"), F.col("key").alias("root_key"), zero.cast("long").alias("shift"), F.expr("times = 1").alias("asked"), "times",
            zero.alias("before"), zero.alias("after"), "anchor", "key", "n", "place", "bytes",
        )
        more = answers(stage(grown(parts), "parts"))
        ranges = ranges.unionByName(more.select(F.col("root_anchor").alias("anchor"), F.col("root_key").alias("key"), "ranges"))
    ranges = stage(ranges, "ranges")
    matter = stage(kinds.select("anchor", "key", "times").join(ranges, ["anchor", "key"], "left").where("times > 1 or ranges is not null"), "matter")
    rows = join_hot(found.select("doc_id", "text_hash", "anchor", "key", "start", "n"), matter, ["anchor", "key"], "times")
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("n").cast("long").alias("n")))
    part = F.transform("ranges", lambda r: F.struct((r["s"] + F.col("start")).alias("s"), r["n"].alias("n")))
    rows = rows.withColumn("ranges", F.when(F.col("times") > 1, whole).otherwise(part))
    out = stage(rows.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "gone")
    unstage(kinds, several, ranges, matter)
    return out


def remove_repeated_bytes(docs: DataFrame, capacity: int = sketch.CAPACITY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for each row of `docs` (doc_id, text).

    A byte goes if a 400-byte string over it also starts anywhere else, in this document or
    another; all occurrences go. Each row is a document of its own, so rows that repeat
    remove each other. Null and empty texts are empty; a text of any length is read whole, in one
    task. Other columns are ignored. capacity: anchors up to which the sketch is broadcast; it
    does not change results.
    """
    short_batches(docs.sparkSession)
    gone = removed_starts(candidates(docs, capacity)).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "ranges")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text or b""
                if not ranges:
                    out.append((len(data), 0, 0, data))
                    continue
                edge = np.zeros(len(data) + 1, np.int32)
                s, n = np.array([(r["s"], r["n"]) for r in ranges], np.int64).T
                np.add.at(edge, s, 1)
                np.add.at(edge, s + n + WIDTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
