"""A count-min sketch built by partitions and merged, asked whether a value may be repeated.

Counters saturate at 2. The estimate never falls below the true count, so no repeated value is
lost. Where the values expected fit, the merged sketch is one table of bits that is broadcast.
Beyond that it is split by ranges of a hash, as many as the values need: values go to their
range, are counted and tested there, and the answers go back to the texts by a key. The share
of unrepeated values let through thus stays flat however large the input is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import mix, multipliers, stage, unstage

#: Two rows of 2**27 counters at most: 32 MB of bits in all where they are broadcast.
DEPTH, WIDTH_BITS = 2, 27
#: Counters in a block; a task merges one block at a time.
BLOCK_BITS = 18
#: Values gathered before a partial sketch is sent on.
FLUSH = 1 << 19
SCHEMA = "block int, counters binary"
#: Values up to which the broadcast bits let less than 5 % of the unrepeated ones through.
CAPACITY = 1 << 25
#: Values in one range beyond that.
RANGE_VALUES = 1 << 20


def width_for(expected: int) -> int:
    """Counters of a row, as a power of two: four for each value expected, within bounds."""
    return min(WIDTH_BITS, max(BLOCK_BITS, math.ceil(math.log2(4 * max(1, expected)))))


def slots(values: np.ndarray, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """The counter of each value in each row, rows one after the other."""
    factors = multipliers(DEPTH, 10)
    return np.concatenate([(mix(values * f) >> np.uint64(64 - width_bits)) + np.uint64(d << width_bits) for d, f in enumerate(factors)])


def partial(values: Iterable[np.ndarray], width_bits: int = WIDTH_BITS) -> Iterator[pa.RecordBatch]:
    """Sparse partial sketches: per block the counters seen, with a top bit for two or more."""
    waiting: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        at, n = np.unique(slots(np.concatenate(waiting), width_bits), return_counts=True)
        packed = (at & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32) | np.where(n > 1, np.uint32(1 << 31), np.uint32(0))
        block = (at >> np.uint64(BLOCK_BITS)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(block)) + 1
        parts = np.split(packed, cuts)
        return pa.RecordBatch.from_arrays(
            [pa.array(block[np.concatenate([[0], cuts])]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counters"]
        )

    for v in values:
        waiting.append(v)
        size += len(v)
        if size >= FLUSH:
            yield flush()
            waiting, size = [], 0
    if size:
        yield flush()


def repeated_bits(partials: DataFrame, width_bits: int = WIDTH_BITS) -> bytes:
    """Merge partial sketches, block by block in sorted order; the bits of all rows, DEPTH * 2**width_bits / 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, twice = -1, np.zeros(0, bool), np.zeros(0, bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], names=["block", "counters"])

        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != block:
                    if block >= 0:
                        yield done()
                    block, seen, twice = b, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
                packed = np.frombuffer(data, np.uint32)
                at = packed & np.uint32((1 << BLOCK_BITS) - 1)
                twice[at] |= seen[at] | (packed >> np.uint32(31)).astype(bool)
                seen[at] = True
        if block >= 0:
            yield done()

    bits = np.zeros(DEPTH << (width_bits - 3), np.uint8)
    # Read straight from the shuffle, partition by partition, the blocks would be merged in one task after the other.
    merged = stage(partials.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(run, SCHEMA), "blocks")
    for row in merged.toLocalIterator():
        at = row["block"] << (BLOCK_BITS - 3)
        bits[at : at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(zlib.decompress(row["counters"]), np.uint8)
    unstage(merged)
    return bits.tobytes()


def maybe_repeated(values: np.ndarray, bits: np.ndarray, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """Whether the estimate of each value is two or more."""
    at = slots(values, width_bits)
    hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1)
    return hit.reshape(DEPTH, len(values)).all(axis=0)


def spread(batches: Iterator[pa.RecordBatch], prints: Callable[[bytes | None], np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """range, value, key, at, known of each print of each (key, text).

    A value that repeats among those gathered is known to: its places go out as answers (range
    -1), and the range gets the value once, marked. A value that fills a third of a table
    thus reaches its range once per gathering, not once per row.
    """
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        v, k, o = (np.concatenate(x) for x in zip(*waiting, strict=True))
        order = np.argsort(v, kind="stable")
        v, k, o = v[order], k[order], o[order]
        first = np.concatenate([[True], v[1:] != v[:-1]])
        many = ~first | np.concatenate([~first[1:], [False]])
        zone = (mix(v) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(v), np.int32)
        out = [np.concatenate([c[many], c[first]]) for c in (np.where(many, -1, zone).astype(np.int32), v.view(np.int64), k, o)]
        out[0][int(many.sum()) :] = zone[first]
        known = np.concatenate([np.zeros(int(many.sum()), bool), many[first]])
        return pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(known)], names=["range", "value", "key", "at", "known"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = prints(text)
            if len(v):
                waiting.append((v, np.full(len(v), key, np.int64), np.arange(len(v), dtype=np.int32)))
                size += len(v)
        if size >= FLUSH:
            yield flush()
            waiting, size = [], 0
    if size:
        yield flush()


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, at of the values whose estimate is two or more, range by range in sorted order; answers known before pass through."""
    zone, held = None, []

    def done() -> pa.RecordBatch:
        v, k, o, known = (np.concatenate(x) for x in zip(*held, strict=True))
        v = v.view(np.uint64)
        if zone == -1:
            hit = np.ones(len(v), bool)
        else:
            width = max(8, math.ceil(math.log2(4 * len(v))))
            at = slots(v, width).astype(np.int64)
            n = np.bincount(at, minlength=DEPTH << width) + np.bincount(at[np.tile(known, DEPTH)], minlength=DEPTH << width)
            hit = (n[at].reshape(DEPTH, len(v)) >= 2).all(axis=0) & ~known
        return pa.RecordBatch.from_arrays([pa.array(k[hit]), pa.array(o[hit])], names=["key", "at"])

    for batch in batches:
        z = batch.column(0).to_numpy()
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(z)) + 1, [len(z)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                # Answers known before (-1) need no counting and are passed on piece by piece.
                if held and (z[a] != zone or zone == -1):
                    yield done()
                    held = []
                zone = int(z[a])
                held.append([c[a:b] for c in columns])
    if held:
        yield done()


Tester = Callable[[np.ndarray, list[int] | None], np.ndarray]


def by_bits(bits: Broadcast, width: int) -> Tester:
    maybe = np.frombuffer(bits.value, np.uint8)
    return lambda values, hits: maybe_repeated(values, maybe, width)


def by_answers() -> Tester:
    def test(values: np.ndarray, hits: list[int] | None) -> np.ndarray:
        out = np.zeros(len(values), bool)
        at = np.array(hits or [], np.int64)
        out[at[at < len(values)]] = True
        return out

    return test


def prefiltered(
    texts: DataFrame, prints: Callable[[], Callable[[bytes | None], np.ndarray]], key: Column, per_byte: float, capacity: int = CAPACITY
) -> tuple[DataFrame, Callable[[], Tester], Callable[[], None]]:
    """`texts` with a last column `hits_`; what makes, on a worker, a function of (prints of a text, its hits_) to a mask of those that may be repeated; and what frees the bits once the table is read.

    prints: makes, once per worker, a function from a text to its values. key: identifies a
    text; where two share it, both get the answers of either. per_byte: values to expect of a
    byte of text.
    """
    spark = texts.sparkSession
    expected = int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * per_byte)
    if expected <= capacity:
        width = width_for(expected)

        def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = prints()
            yield from partial((of(t) for b in batches for t in b.column(0).to_pylist()), width)

        bits = spark.sparkContext.broadcast(repeated_bits(texts.select("text").mapInArrow(partials, SCHEMA), width))
        return texts.withColumn("hits_", F.lit(None).cast("array<int>")), lambda: by_bits(bits, width), bits.destroy
    range_bits = max(0, math.ceil(math.log2(expected / min(RANGE_VALUES, capacity))))

    def spreading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from spread(batches, prints(), range_bits)

    values = texts.select(key.alias("key"), "text").mapInArrow(spreading, "range int, value long, key long, at int, known boolean")
    # Answers known before are dealt by their key, the rest by range.
    dealt = values.repartition(F.when(F.col("range") < 0, F.xxhash64("key")).otherwise(F.xxhash64("range"))).sortWithinPartitions("range")
    hits = dealt.mapInArrow(answered, "key long, at int").groupBy("key").agg(F.collect_set("at").alias("hits_"))
    keyed = texts.withColumn("key_", key)
    return keyed.join(hits, F.col("key_") == F.col("key"), "left").drop("key", "key_"), by_answers, lambda: None
