"""Shared pieces of the training-data operators.

Words are maximal runs of bytes other than space and \\x09-\\x0D, which is
exactly what ``bytes.split()`` yields on UTF-8 text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators.staging import scratch_path, shared_dir, stage, unstage  # noqa: F401

#: Whitespace that separates words.
SPACE = " \t\n\x0b\f\r"
#: Rows per Arrow batch: texts reach 100 kB and more, so batches stay short.
BATCH_ROWS = 256
#: Distinct words remembered by one Python worker.
MEMO_WORDS = 200_000
#: A key is hot beyond a share of all rows: one part in this many of a shuffle partition's.
HOT_SHARE = 4


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few rows per Arrow batch. The setting stays in the session, since plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner equi-join of `big` with `small`, a staged table of one row per key that says how many rows of `big` have it.

    Keys of more rows than a fraction of a partition's even share would land in one task each.
    There are at most HOT_SHARE of them per shuffle partition, so their rows of `small` are
    broadcast and the rows of `big` stay where they are; all other keys are shuffled.
    """
    total = small.agg(F.sum(times)).first()[0] or 0
    bound = max(256, total // (HOT_SHARE * int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot, cold = small.where(F.col(times) > bound), small.where(F.col(times) <= bound)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return big.join(F.broadcast(hot), keys).unionByName(rest)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; stays in the JVM."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(
        text.isNull() | (F.length(bare) == 0), F.lit(0)
    ).otherwise(F.size(F.split(bare, r"[ \t\n\x0B\f\r]+"))).cast("long")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache
def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers of a seed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Bytes of text hashed at once.
TEXT_PIECE = 1 << 20
A_SPACE = re.compile(rb"[ \t\n\x0b\f\r]")
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE.encode(), np.uint8))
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier, and of its inverse, modulo 2**64."""
    base = int(multipliers(1, 60)[0]) | 3
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * TEXT_PIECE, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))


def long_word(word: bytes) -> np.ndarray:
    """The hash of a word that is longer than the tables of powers."""
    base, total = int(powers()[0][1]), 0
    for at in range(0, len(word), TEXT_PIECE):
        data = np.frombuffer(word, np.uint8, min(TEXT_PIECE, len(word) - at), at)
        total += int((BYTE_HASH[data] * powers()[0][: len(data)]).sum()) * pow(base, at, 1 << 64)
    return mix(np.array([(total + len(word)) % (1 << 64)], np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, as text.split() gives them, in a few vector operations a byte."""
    if len(text) > 2 * TEXT_PIECE:
        out, at = [], 0
        while at < len(text):
            found = A_SPACE.search(text, at + TEXT_PIECE)
            end = found.start() if found else len(text)
            piece = [text[at:end]] if end - at <= 2 * TEXT_PIECE else text[at:end].split()
            out += [word_hashes(x) if len(x) <= 2 * TEXT_PIECE else long_word(x) for x in piece]
            at = end
        return np.concatenate(out)
    data = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], IS_SPACE[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data] * up[: len(data)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes, a polynomial of them; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    (m,) = multipliers(1, seed)
    out = h[:n] + np.uint64(seed)
    for j in range(1, width):
        out *= m
        out += h[j : j + n]
    return mix(out)


#: Bits that hold a position beside a truncated hash, and windows handled at once.
POSITION_BITS = 24
PIECE = 1 << 23


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the index of its smallest, leftmost on ties.

    Block minima from both sides (van Herk): a few vector operations per element. The
    choice depends only on what the window holds, so equal windows choose alike.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if n > PIECE:
        parts = range(0, n, PIECE)
        return np.concatenate([minimizers(h[i : i + PIECE + width - 1], width) + i for i in parts])
    blocks = -(-len(h) // width)
    low_bits = np.uint64((1 << POSITION_BITS) - 1)
    keys = np.full(blocks * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    keys[: len(h)] = (h & ~low_bits) | np.arange(len(h), dtype=np.uint64)
    grid = keys.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & low_bits).astype(np.int64)
